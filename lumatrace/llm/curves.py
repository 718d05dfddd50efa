"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected to a few dimensions, several times by different rotations, shifted, and given its
place on a Hilbert curve. Spark sorts each curve by range partitions, so that every vector has a position on
every curve, and cuts it into slices. A query meets the slices around its own position on each curve, the
candidates of all curves merge, and inner products of the original vectors rank them.

How wide the windows are is fitted: a bounded sample of the queries is answered exactly against all vectors, in
one pass. Queries whose k-th score in the narrow windows is as high as that of sampled queries that were
answered well are done. The others get the windows that cover the sample's true neighbours best for the least
number of candidates: fewer curves with wide windows, or more with narrow ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, hash_sample, materialize, numbered, read

#: Curves; dimensions of a curve and bits of each; the part of its square that a shift may take.
CURVES, AXES, BITS, SHIFT = 4, 8, 7, 0.5
#: Positions in a slice of the narrow windows (one's own slice and both beside it) and of the wide ones, and values
#: of vectors in one slice: of long vectors fewer stand in it.
NARROW, WIDE, VALUES = 512, 8192, 1 << 20
#: Queries that are answered exactly to fit the windows; vectors that fit the curves' squares; the recall that is fitted.
SAMPLE, SQUARE, RECALL = 256, 4096, 0.95
SEED = 11


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells``, whose columns have ``bits`` bits.

    From the highest bit down, a set bit in a column turns the lower bits of the first column over, and a clear
    one swaps them with its own; the Gray code of what results is the place, bits of all columns in turn.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for row in x:
            up = (row >> bit & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(up, low, swap)
            row ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | (row >> bit & 1)
    return place


def rotation(curve: int, d: int) -> np.ndarray:
    """Directions of a curve for vectors of length d, orthogonal as far as there are as many; the same for every task."""
    rng = np.random.default_rng([SEED, curve, d])
    return np.linalg.qr(rng.standard_normal((d, d)))[0][:, :AXES]


class Squares:
    """For each vector length the range that a sample of vectors takes along each direction of each curve."""

    def __init__(self, sample: list[list[float]]) -> None:
        self.at: dict[int, list[tuple]] = {}
        for d in {len(v) for v in sample}:
            m = np.array([v for v in sample if len(v) == d], float)
            self.at[d] = []
            for curve in range(CURVES):
                along = m @ rotation(curve, d)
                low, high = np.quantile(along, 0.01, axis=0), np.quantile(along, 0.99, axis=0)
                shift = np.random.default_rng([SEED, curve, d, 1]).random(low.shape) * SHIFT
                self.at[d].append((low, np.maximum(high - low, 1e-12), shift))

    def places(self, m: np.ndarray, curve: int) -> np.ndarray:
        """Of vectors of one length on a curve; what lies outside the square goes to its edge. Lengths that the sample lacks have a square of their own, the same in all tasks."""
        d = m.shape[1]
        along = m @ rotation(curve, d)
        if d not in self.at:
            along = along / (1 + np.abs(along))
        low, wide, shift = self.at[d][curve] if d in self.at else (-1.0, 2.0, 0.0)
        inside = np.clip((along - low) / wide, 0, 1) * (1 - SHIFT) + shift
        return hilbert(np.minimum((inside * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def rows_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and the n + 1 offsets of its rows."""
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(float), offsets - offsets[0]


def by_length(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: row numbers and the vectors."""
    flat, at = rows_of(lists)
    sizes = np.diff(at)
    return {int(d): ((rows := np.flatnonzero(sizes == d)), flat[at[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def different(vectors: DataFrame, is_query: Column, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(vid, v, ids, asked): each different vector with its k + 1 least ids; and (query_id, v) of the queries' rows.

    More of a vector's ids can be in no answer, so the window keeps k + 1 of them in each task before it shuffles.
    """
    x = F.col(vector)
    size = lambda e: F.abs(e.cast("double"))
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (size(e) < float("inf")), F.lit(False))) & F.exists(x, lambda e: size(e) > 0)
    ready = vectors.filter(F.col(key).isNotNull() & x.isNotNull()).filter(fine).select(F.col(key).cast("long").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    least = Window.partitionBy("v").orderBy("id")
    ids = ready.withColumn("i", F.row_number().over(least)).filter(F.col("i") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    queries = ready.filter("asked").select(F.col("id").alias("query_id"), "v")
    marked = ids.join(queries.select("v").distinct().withColumn("asked", F.lit(True)), "v", "left")
    return materialize(marked.select(F.monotonically_increasing_id().alias("vid"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))), queries


def on_curves(items: DataFrame, squares: Squares) -> DataFrame:
    """(curve, length, place, vid, v, ids, asked): each vector once on each curve."""
    held = items.sparkSession.sparkContext.broadcast(squares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = by_length(batch.column(1))
            for curve in range(CURVES):
                length, place = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
                for d, (rows, m) in groups.items():
                    length[rows], place[rows] = d, held.value.places(m, curve)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), curve, np.int32)), pa.array(length), pa.array(place), *batch.columns], ["curve", "length", "place", *batch.schema.names])

    return arrow_map(items, run, f"curve int, length int, place long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in items.schema)}")


def packed(placed: DataFrame, size: int, floor: bool = False) -> DataFrame:
    """(curve, slice, rows): ``size`` positions of a curve in one row."""
    inside = F.struct("vid", "v", "ids", *(["floor"] if floor else []))
    return placed.groupBy("curve", F.expr(f"position div {size}").alias("slice")).agg(F.collect_list(inside).alias("rows"))


def meet(asked: DataFrame, slices: DataFrame, reach: int, k: int) -> DataFrame:
    """(qvid, vid, score, ids): for each query the best of every slice at most ``reach`` slices from its own.

    Rows of both sides are whole slices, so the join has a row for two slices and not for two vectors. A slice
    gives a query at most the k + 1 best, and none below the query's ``floor``.
    """
    near = asked.select("curve", F.explode(F.sequence(F.col("slice") - reach, F.col("slice") + reach)).alias("slice"), F.col("rows").alias("queries"))
    both = near.join(slices, ["curve", "slice"]).select("queries", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(len(batch)):
                q, x = (batch.column(c).slice(one, 1).flatten() for c in (0, 1))
                names = [q.type.field(i).name for i in range(q.type.num_fields)]
                vid, ids, qvid = x.field("vid").to_numpy(), x.field("ids"), q.field("vid").to_numpy()
                floor = q.field("floor").to_numpy() if "floor" in names else np.full(len(qvid), -np.inf)
                others = by_length(x.field("v"))
                for d, (mine, m) in by_length(q.field("v")).items():
                    if d not in others:
                        continue
                    theirs, n = others[d]
                    scores = m @ n.T
                    scores[scores < floor[mine][:, None] - 1e-9] = -np.inf
                    if len(theirs) > k + 1:
                        top = np.argpartition(-scores, k, axis=1)[:, : k + 1]
                    else:
                        top = np.broadcast_to(np.arange(len(theirs)), scores.shape)
                    at, col = np.nonzero(np.take_along_axis(scores, top, 1) > -np.inf)
                    col = top[at, col]
                    exact = (m[at] * n[col]).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(qvid[mine[at]]), pa.array(vid[theirs[col]]), pa.array(exact), ids.take(pa.array(theirs[col]))], ["qvid", "vid", "score", "ids"])

    return arrow_map(both, run, "qvid long, vid long, score double, ids array<long>")


def best(found: DataFrame, k: int) -> DataFrame:
    """Each query's best vectors, of different curves once, as many as hold k + 1 ids; ``floor``: the least score that counts."""
    one = found.groupBy("qvid", "vid").agg(F.max("score").alias("score"), F.any_value("ids").alias("ids"))
    order = Window.partitionBy("qvid").orderBy(F.desc("score"), "vid")
    limited = one.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1)  # a vector has one id at least
    sums = limited.withColumn("ids_so_far", F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # vectors that tie with the last one stay, since a tie goes to the lesser id
    last = F.min(F.when(F.col("ids_so_far") >= k + 1, F.struct(F.col("i"), F.col("score")))).over(Window.partitionBy("qvid"))
    cut = sums.withColumn("last", last).withColumn("floor", F.coalesce(F.col("last.score"), F.lit(float("-inf"))))
    return cut.filter(F.col("score") >= F.col("floor")).select("qvid", "vid", "score", "ids", "floor")


def exact(items: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """``best`` of a bounded sample of queries among all vectors, in one pass over them."""
    table = sample.select("vid", "v").toArrow()
    asked = {d: (table.column("vid").to_numpy()[rows], m) for d, (rows, m) in by_length(table.column("v").combine_chunks()).items()} if len(table) else {}
    held = items.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            vid = batch.column(0).to_numpy()
            for d, (rows, n) in by_length(batch.column(1)).items():
                if d in held.value:
                    qvid, m = held.value[d]
                    score, who = m @ n.T, np.broadcast_to(vid[rows], (len(m), len(rows)))
                    if d in kept:
                        score, who = np.concatenate([kept[d][0], score], 1), np.concatenate([kept[d][1], who], 1)
                    top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                    kept[d] = np.take_along_axis(score, top, 1), np.take_along_axis(who, top, 1)
        for d, (score, who) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held.value[d][0], score.shape[1])), pa.array(who.ravel()), pa.array(score.ravel())], ["qvid", "vid", "score"])

    found = arrow_map(items.select("vid", "v"), run, "qvid long, vid long, score double")
    order = Window.partitionBy("qvid").orderBy(F.desc("score"), "vid")
    return found.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1)


def fitted(truth: dict[int, set[int]], narrow: dict[int, tuple[float, set[int]]], places: dict[int, np.ndarray], n: int, recall: float) -> tuple[float, int, int]:
    """(bar, curves, window): queries whose floor reaches ``bar`` are done; the others get ``window`` positions on the first ``curves``.

    ``bar`` is the lowest at which the sampled queries from it upwards have the wanted mean recall.
    """
    order = sorted(truth, key=lambda q: -narrow.get(q, (-np.inf,))[0])
    shares = np.array([len(narrow.get(q, (0, set()))[1] & truth[q]) / max(1, len(truth[q])) for q in order])
    good = np.flatnonzero(np.cumsum(shares) >= recall * np.arange(1, len(shares) + 1)) if len(shares) else []
    bar = narrow.get(order[good[-1]], (np.inf,))[0] if len(good) else np.inf
    wide = [q for q in order if narrow.get(q, (-np.inf,))[0] < bar]
    if not wide:
        return bar, 1, n
    apart = np.array([np.abs(places[v] - places[q]) for q in wide for v in truth[q]])
    choices = []
    for curves in range(1, CURVES + 1):
        window = int(np.quantile(apart[:, :curves].min(1), recall, method="higher"))
        choices.append((curves * min(n, 2 * window + 1), curves, window))
    return (bar, *min(choices)[1:])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, about its k nearest by inner product.

    Candidates are all rows but the query's own; ties go to the lesser id. Vectors that are null, zero or hold
    null or non-finite components take no part, nor do null ids; vectors of different lengths aren't compared.
    Rows that repeat an id are queries and candidates each, also of one another. Equal vectors are searched once.
    ``recall`` is what the windows are fitted to on the sample; all vectors are on all curves.
    """
    spark = vectors.sparkSession
    items, queries = different(vectors, is_query, key, vector, k)
    n, longest = items.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    wide, slim = (max(16, min(size, VALUES // (longest or 1))) for size in (WIDE, NARROW))
    squares = Squares([r.v for r in hash_sample(items, F.col("vid"), n, SQUARE).select("v").collect()])
    place = ["curve", "length", "place", "vid"]
    placed = numbered(on_curves(items, squares), [F.col(c) for c in place], "at").withColumn("position", F.col("at") - F.col("curve") * n)
    asked = placed.filter("asked")
    narrow = materialize(best(meet(packed(asked, slim), packed(placed, slim), 1, k), k))

    sample = materialize(hash_sample(items.filter("asked"), F.col("vid"), items.filter("asked").count(), SAMPLE))
    truth: dict[int, set[int]] = {}
    for r in best(exact(items, sample, k).join(items.select("vid", "ids"), "vid"), k).collect():  # about k + 1 rows for each sampled query
        truth.setdefault(r.qvid, set()).add(r.vid)
    seen = {q: (-np.inf, set()) for q in truth}
    for r in narrow.join(F.broadcast(sample.select(F.col("vid").alias("qvid"))), "qvid").select("qvid", "vid", "floor").collect():
        seen[r.qvid] = r.floor, seen[r.qvid][1] | {r.vid}
    wanted = spark.createDataFrame([(v,) for v in set(truth).union(*truth.values())], "vid long")
    places: dict[int, np.ndarray] = {}
    for r in placed.join(F.broadcast(wanted), "vid").select("vid", "curve", "position").collect():
        places.setdefault(r.vid, np.zeros(CURVES, np.int64))[r.curve] = r.position
    bar, curves, window = fitted(truth, seen, places, n, recall)

    floors = narrow.groupBy(F.col("qvid").alias("vid")).agg(F.max("floor").alias("floor")).filter(F.col("floor") < bar)
    open_ = asked.filter(F.col("curve") < curves).join(floors, "vid")
    more = meet(packed(open_, wide, True), packed(placed.filter(F.col("curve") < curves), wide), -(-window // wide), k)
    answers = best(narrow.drop("floor").unionByName(more), k)

    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id"), (F.col("qvid") == F.col("vid")).alias("own")))
    lists = answers.groupBy("qvid").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("list"))
    of_vector = lists.join(items.select(F.col("vid").alias("qvid"), "v"), "qvid").drop("qvid")
    itself = F.array_position(F.transform("list", lambda e: e["own"] & (e["id"] == F.col("query_id"))), F.lit(True))
    others = queries.join(of_vector, "v").withColumn("self", itself)
    left = others.select("query_id", F.posexplode(F.slice(F.filter("list", lambda e, i: i + 1 != F.col("self")), 1, k)).alias("i", "e"))
    return left.select("query_id", (F.col("i") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.minus")).alias("score"))


def op11_curves(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
