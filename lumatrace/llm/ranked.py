"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

Documents are dealt in shards. A shard holds, for each term, its documents in order of falling impact. For a
query the lists of its terms are read side by side, deeper and deeper. A document's lower score is the sum of
the impacts read for it; its upper score adds, for each list in which it was not met yet, the impact at which
that list's reading stands. Reading goes on until no document that was never met and none that was met only in
part can reach the k-th lower score: then membership, ties and scores are settled. A shard's k best are among
its own lists, so Spark merges at most k rows of each shard and query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, blobs, materialize, read

#: A term is a maximal run of these characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of query text in one broadcast (more queries take several passes); documents and postings in a shard.
QUERY_BYTES, SHARD_DOCS, SHARD_POSTINGS = 8 << 20, 16_384, 4_000_000
#: Entries of each list that the first read takes; each later one takes twice as many.
FIRST_READ = 256
#: Bytes of a text that are split at once.
PIECE = 1 << 20
_TERM, _GAP = re.compile(TERM), re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def terms_of(text: bytes) -> Iterator[list[str]]:
    """The terms of a text, a piece at a time; pieces end where no term is."""
    low, at = text.translate(LOWER), 0
    while at < len(low):
        gap = _GAP.search(low, at + PIECE)
        end = gap.start() if gap else len(low)
        yield _TERM.findall(low[at:end].decode("utf-8", "replace"))
        at = end


def query_blocks(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """Queries as (key, different terms), about QUERY_BYTES of text at a time; rows that repeat a key are one query."""
    clean = queries.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).distinct()
    size = clean.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-size // QUERY_BYTES)
    ready = materialize(clean) if passes > 1 else clean
    for p in range(passes):
        found: dict = {}
        for row in ready.filter(F.pmod(F.xxhash64("k"), F.lit(passes)) == p).toLocalIterator():
            found.setdefault(row.k, set()).update(term for part in terms_of(row.t.encode()) for term in part)
        yield sorted(((k, sorted(terms)) for k, terms in found.items()), key=lambda x: (x[0] is None, x[0]))


def counted(docs: DataFrame, key: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(doc, n, terms, tfs) of each row: its number of terms, and those of the vocabulary as numbers, with their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(held.value)}.get
        for batch in batches:
            data, at = blobs(batch.column(1))
            sizes, terms, tfs = [], [], []
            for a, b in zip(at, at[1:]):
                n, seen = 0, Counter()
                for part in terms_of(data[a:b].tobytes()):
                    n += len(part)
                    seen.update(map(number, part))
                seen.pop(None, None)
                sizes.append(n)
                terms.append(np.fromiter(seen.keys(), np.int32, len(seen)))
                tfs.append(np.fromiter(seen.values(), np.int64, len(seen)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc", "n", "terms", "tfs"])

    return arrow_map(docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text")), run, f"doc {kind}, n long, terms array<int>, tfs array<long>")


class Shard:
    """The impact-sorted lists of some documents. ``order``: documents by key, so that ties go by number."""

    def __init__(self, of: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_docs: int) -> None:
        fit = impact > 0
        of, terms, impact = of[fit], terms[fit], impact[fit]
        order = np.lexsort((of, -impact, terms))
        self.doc, self.impact, self.n_docs = of[order], impact[order], n_docs
        self.terms, begin = np.unique(terms[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.read = 0

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents, highest first, ties to the lesser number; of all with a score above 0 if fewer."""
        at = np.searchsorted(self.terms, terms)
        lists = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        begin, end = self.begin[lists], self.begin[lists + 1] if len(lists) else self.begin[lists]
        lower = np.zeros(self.n_docs, np.int64)
        met = np.zeros((len(lists), self.n_docs), bool)
        stand, step = begin.copy(), FIRST_READ
        while len(lists):
            for i in np.flatnonzero(stand < end):
                upto = min(stand[i] + step, end[i])
                docs = self.doc[stand[i] : upto]
                lower[docs] += self.impact[stand[i] : upto]
                met[i, docs] = True
                self.read += int(upto - stand[i])
                stand[i] = upto
            left = np.where(stand < end, self.impact[np.minimum(stand, len(self.impact) - 1)], 0)  # no unread entry is above this
            some = np.flatnonzero(lower)
            if not left.any():
                break
            if len(some) >= k:
                kth = np.partition(lower[some], len(some) - k)[len(some) - k]
                if left.sum() < kth:
                    upper = lower[some] + left @ ~met[:, some]
                    rivals = upper >= kth
                    if (upper[rivals] == lower[some][rivals]).all():
                        break
            step *= 2
        some = np.flatnonzero(lower)
        if len(some) > k:
            kth = np.partition(lower[some], len(some) - k)[len(some) - k]
            some = some[lower[some] >= kth]
        found = some[np.lexsort((some, -lower[some]))][:k]
        return found, lower[found]


def best_of_shards(index: DataFrame, weights: np.ndarray, queries: list[np.ndarray], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(ask, doc, score): each shard's k best of each query. ``n_docs``: documents with terms, ``n_terms``: of all of them."""
    held = index.sparkSession.sparkContext.broadcast((weights, queries))
    kind = index.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = held.value

        def search(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(part).sort_by([("doc", "ascending")]).combine_chunks()  # null keys come last
            n = table.column("n").to_numpy()
            lists, tf = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks().flatten().to_numpy()
            of = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
            terms = lists.flatten().to_numpy()
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            shard = Shard(of, terms, weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of])), len(table))
            asks, docs, scores = [], [], []
            for ask, own in enumerate(asked):
                doc, score = shard.best(own, k)
                asks.append(np.full(len(doc), ask))
                docs.append(doc)
                scores.append(score)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(asks)), table.column("doc").combine_chunks().take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["ask", "doc", "score"])

        part: list[pa.RecordBatch] = []
        for batch in batches:
            part += [batch] if len(batch) else []
            if sum(map(len, part)) >= SHARD_DOCS or sum(len(b.column(2).flatten()) for b in part) >= SHARD_POSTINGS:
                yield search(part)
                part = []
        if part:
            yield search(part)

    return arrow_map(index.filter(F.size("terms") > 0), run, f"ask long, doc {kind}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", query: str = "item_id", text: str = "text") -> DataFrame:
    """(``query``, rank, ``doc``, score): the k rows of ``docs`` with the highest score above 0 for each query.

    The score is the sum over a query's different terms of w * ((10^9 tf) div (1000 tf + 8 m)), see TERM and
    ``best_of_shards``. Ties go to the lesser document, null last; repeated rows of a document are documents
    each; repeated rows of a query, also with different texts, are one query. Null and empty texts have no
    terms, and a query without known terms has no rows.
    """
    spark = docs.sparkSession
    results = None
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((query, queries), (doc, docs))}
    for block in query_blocks(queries, query, text):
        vocabulary = sorted({term for _, terms in block for term in terms})
        number = {term: i for i, term in enumerate(vocabulary)}
        index = materialize(counted(docs, doc, text, vocabulary))
        n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_terms:
            continue
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(1000 * F.log((F.lit(float(2 * n_docs + 2))) / (2 * F.col("df") + 1)))
        weights = np.zeros(len(vocabulary), np.int64)
        for row in held.select("term", weight.alias("w")).collect():  # one row a term of the block
            weights[row.term] = row.w
        found = best_of_shards(index, weights, [np.array([number[t] for t in terms], np.int32) for _, terms in block], n_docs, n_terms, k)
        keys = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], f"ask long, query {kinds[query]}")
        place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
        best = found.withColumn("rank", place).filter(F.col("rank") <= k).join(F.broadcast(keys), "ask")
        best = best.select(F.col("query").alias(query), "rank", F.col("doc").alias(doc), "score")
        results = best if results is None else results.union(best)
    if results is None:
        return spark.createDataFrame([], f"{query} {kinds[query]}, rank int, {doc} {kinds[doc]}, score long")
    return results


def op12_ranked(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term, total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
