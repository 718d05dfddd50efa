"""Exact top-k search by block-at-a-time pruning.

A block is a range of vectors with, for each dimension, the largest and the least value in it. For a
query, a block's bound is the sum over dimensions of the query's value times the one of the two that
makes it larger. Blocks are visited from the highest bound down; each is scored through its forward
index (its vectors), until the bounds fall below the k-th score so far. Before blocks are cut, vectors
are ordered by the nearest of a few of them, and a first pass over a sample of the vectors gives each
query a score that its k-th cannot fall below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read

#: Vectors in a block; queries scored together; queries in one broadcast (more are taken in several passes).
BLOCK, TOGETHER, QUERIES = 512, 256, 20_000
#: Vectors that are ordered together and cut into blocks; pivots of that order; vectors in the sample of the first pass.
PART, PIVOTS, SAMPLE = 16 * BLOCK, 32, 8192
SCALE = 256


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) as an array of longs; without null or non-finite vectors and components."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return vectors.filter(fine).select(F.col(key).alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e)).alias("v"))


def matrix(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: the row numbers and the vectors."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    return {int(d): ((rows := np.flatnonzero(sizes == d)), flat[(at[rows][:, None] + np.arange(d)).astype(np.int64)]) for d in np.unique(sizes)}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; floats where they are exact, since their product is quicker."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


class Best:
    """The k best (score, least id) of each query so far, of those that reach its ``floor``."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        n = len(floor)
        self.floor = floor
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.count = np.zeros(n, np.int64)
        self.scored = self.blocks = 0

    def bar(self, rows: np.ndarray) -> np.ndarray:
        """The score that a candidate must reach."""
        return np.where(self.count[rows] == self.score.shape[1], np.maximum(self.floor[rows], self.score[rows, -1]), self.floor[rows])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        fit = scores >= self.floor[rows, None]
        some = fit.any(1)
        rows, scores, fit = rows[some], scores[some], fit[some]
        score = np.concatenate([self.score[rows], np.where(fit, scores, np.iinfo(np.int64).min)], 1)
        ident = np.concatenate([self.id[rows], np.where(fit, ids[None, :], np.iinfo(np.int64).max)], 1)
        order = np.lexsort((ident, -np.maximum(score, -(2**62))), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ident, order, 1)
        self.count[rows] = np.minimum(self.count[rows] + fit.sum(1), k)


def search_blocks(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Add to the best candidates of each query those among the vectors, block after block."""
    if len(vectors) > BLOCK:
        near = products(vectors, vectors[:: -(-len(vectors) // PIVOTS)])
        order = np.lexsort((near.max(1), near.argmax(1)))
        ids, vectors = ids[order], vectors[order]
    n = -(-len(ids) // BLOCK)
    at = np.arange(n) * BLOCK
    top, low = np.maximum.reduceat(vectors, at, axis=0), np.minimum.reduceat(vectors, at, axis=0)
    for a in range(0, len(queries), TOGETHER):
        q = queries[a : a + TOGETHER]
        rows = np.arange(a, a + len(q))
        bound = products(np.maximum(q, 0), top) + products(np.minimum(q, 0), low)
        order = np.argsort(-bound, axis=1, kind="stable")
        best.blocks += n * len(q)
        for step in range(n):
            block = order[:, step]
            live = bound[rows - a, block] >= best.bar(rows)
            if not live.any():
                break
            best.scored += int(live.sum())
            for b in np.unique(block[live]):
                mine = np.flatnonzero(live & (block == b))
                lo, hi = b * BLOCK, min(len(ids), (b + 1) * BLOCK)
                best.add(rows[mine], products(q[mine], vectors[lo:hi]), ids[lo:hi])


def best_of(ready: DataFrame, held, k: int) -> DataFrame:
    """(ask, vec_id, score): what each task finds for the queries of ``held``, at most ``k`` rows a query.

    ``held``: a broadcast dict from vector length to (numbers of queries, vectors, floors).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(floor, k) for d, (_, _, floor) in held.value.items()}

        def search(part: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(part).combine_chunks()
            ids = table.column(0).to_numpy().astype(np.int64)
            for d, (rows, m) in matrix(table.column(1).chunk(0)).items():
                if d in best:
                    search_blocks(held.value[d][1], ids[rows], m, best[d])

        part: list[pa.RecordBatch] = []
        for batch in batches:
            part += [batch] if len(batch) else []
            if sum(map(len, part)) >= PART:
                search(part)
                part = []
        if part:
            search(part)
        for d, found in best.items():
            real = np.arange(k)[None, :] < found.count[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held.value[d][0], found.count)), pa.array(found.id[real]), pa.array(found.score[real])], ["ask", "vec_id", "score"])

    return arrow_map(ready, run, "ask long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, most_queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds its k highest inner products.

    Candidates are all rows but the query's own; ties go to the lesser id, and fewer than k candidates give
    fewer rows. Vectors that are null or hold null or non-finite components take no part; vectors of
    different lengths aren't compared; the inner product of empty vectors is 0. Null ids take no part. Rows
    that repeat an id are queries and candidates each, also of one another: a query id has k rows for each.
    Queries are broadcast ``most_queries`` at a time and meet all vectors in blocks; each task returns k + 1
    rows a query at most, since the query's own row is among its candidates until the end.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter(F.col(key).isNotNull())
    ready = integers(vectors, key, vector, scale)
    asked = materialize(integers(vectors.filter(is_query), key, vector, scale).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")))
    n, all_rows = asked.count(), ready.count()
    sample = ready.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, all_rows))) + 1)
    passes = max(1, -(-n // most_queries))
    results = None
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes)) == p) if passes > 1 else asked
        table = part.toArrow()
        if not len(table):
            continue
        groups = matrix(table.column("v").combine_chunks())
        floor = np.full(len(table), np.iinfo(np.int64).min)
        itself = np.zeros(len(table), np.int64)
        for rows, m in groups.values():
            itself[rows] = (m * m).sum(1)
        held = spark.sparkContext.broadcast({d: (rows, m, floor[rows]) for d, (rows, m) in groups.items()})
        last = Window.partitionBy("ask").orderBy(F.desc("score"))
        seen = best_of(sample, held, k + 1).withColumn("i", F.row_number().over(last)).filter(F.col("i") == k + 1).select("ask", "score").toArrow()
        floor[seen.column("ask").to_numpy()] = seen.column("score").to_numpy()
        held = spark.sparkContext.broadcast({d: (rows, m, floor[rows]) for d, (rows, m) in groups.items()})
        own = pa.table({"ask": np.arange(len(table)), "query_id": table.column("vec_id"), "copies": table.column("copies"), "self": itself})
        found = best_of(ready, held, k + 1).join(F.broadcast(spark.createDataFrame(own)), "ask")
        found = found.withColumn("ask", F.xxhash64(F.lit(p), "ask"))
        results = found if results is None else results.union(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("i", F.row_number().over(place)).filter(F.col("i") <= k + 1)
    own_row = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
    gone = F.min(F.when(own_row, F.col("i"))).over(Window.partitionBy("query_id", "ask"))
    ranked = ranked.withColumn("gone", F.coalesce(gone, F.lit(k + 1))).filter(F.col("i") != F.col("gone"))
    rank = (F.col("i") - (F.col("i") > F.col("gone")).cast("int")).alias("rank")
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return ranked.select("query_id", rank, "vec_id", "score", each.alias("copy")).drop("copy")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
