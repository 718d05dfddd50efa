"""Benchmark decontamination by an FM-index per shard of training text.

A shard is the part of a partition that one vectorised step holds. Its alphabet is the vocabulary of
the benchmark; all other words are separators, and stretches of known words that are too short for
any window are left out of the index, since no window can occur in them. Backward search runs over
all windows at once, with ranks from a wavelet matrix; occurrences are located by walking to sampled
suffix positions; overlapping occurrences merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WRITTEN, arrow_map, blobs, chunks, discard, materialize, read

WINDOW = 10
#: Every so many positions the index keeps one suffix position.
SAMPLE = 8
#: Bytes of benchmark text in one broadcast; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20
#: Bytes of document text in one index.
SHARD_BYTES = 3 << 20
#: A-Z become a-z; bytes that are not in a word become spaces.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order of symbols >= 0 by prefix doubling; zeros are separators, each unlike any other."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    ends = np.flatnonzero(rank == 0)
    rank += len(ends)
    rank[ends] = np.arange(len(ends))
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        sorted_rank = rank[order]
        new = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step > n:
            return order
        then = np.zeros(n, np.int64)
        then[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + then
        order = np.argsort(rank, kind="stable")
        step *= 2


class FmIndex:
    """Counts and finds words' sequences in ``symbols``: runs of positive symbols, each run led by a 0."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        n = self.n = len(symbols)
        order = suffix_array(symbols)
        bwt = symbols[order - 1]  # before the first symbol stands the last one, in a circle
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        self.levels = max(1, int(sigma).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = bwt
        for k in range(self.levels - 1, -1, -1):
            bit = (level >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        starts = np.concatenate([[False], symbols[:-1] == 0])  # walks never cross a separator
        kept = (order % SAMPLE == 0) | starts[order] | (symbols[order] == 0)
        self.kept, self.samples = kept, order[kept]
        self.kept_rank = np.cumsum(kept) - 1

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the BWT before position ``at``."""
        low, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            right = ((symbol >> k) & 1).astype(bool)
            low = np.where(right, zeros + ones[low], low - ones[low])
            at = np.where(right, zeros + ones[at], at - ones[at])
        return at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges [lo, hi) of patterns of one length (a row each), by backward search."""
        symbol = patterns[:, -1]
        lo, hi = self.first[symbol].copy(), self.first[symbol + 1].copy()
        live = np.flatnonzero(lo < hi)
        for k in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[live, k]
            lo[live] = self.first[symbol] + self.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        hi[lo > hi] = lo[lo > hi]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: LF steps to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.kept[rows])
        while len(live):
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.kept[rows[live]]]
        return self.samples[self.kept_rank[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items: by length a row of word numbers for each, and the items that hold it."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        texts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, text in items:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.translate(TO_WORDS).split()], np.int32)
            if len(words):
                texts.setdefault(min(window, len(words)), []).append((number.get(name, -1), words))
        self.by_size: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # windows; where their items begin; items
        for size, found in sorted(texts.items()):
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(words, size) for _, words in found])
            item = np.repeat(np.array([i for i, _ in found], np.int32), [len(words) - size + 1 for _, words in found])
            order = np.lexsort((item, *rows.T[::-1]))
            rows, item = rows[order], item[order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
            other = new | np.concatenate([[True], item[1:] != item[:-1]])
            kept = other & (item >= 0)  # an item without a name hits but isn't named
            begin = np.concatenate([[0], np.cumsum(kept)])[np.append(np.flatnonzero(new), len(rows))]
            self.by_size.append((np.ascontiguousarray(rows[new]), begin, item[kept]))
        self.shortest = min((w.shape[1] for w, _, _ in self.by_size), default=1)

    def matches(self, symbols: np.ndarray, first_of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Begin and length of each occurrence in the word symbols, and the names of its items."""
        known = symbols > 0
        start = known & ~np.concatenate([[False], known[:-1]])
        start[first_of_text] = known[first_of_text]
        begins = np.flatnonzero(start)
        stop = ~known
        stop[first_of_text] = True
        stops = np.append(np.flatnonzero(stop), len(symbols))
        ends = stops[np.searchsorted(stops, begins, "right")]
        keep = ends - begins >= self.shortest
        begins, ends = begins[keep], ends[keep]
        if not len(begins) or not self.by_size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        sizes = ends - begins
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        place = np.repeat(begins - at[:-1] - 1, sizes + 1) + np.arange(at[-1])
        place[at[:-1]] = -1
        text = np.where(place < 0, 0, symbols[place])
        index = FmIndex(text, len(self.vocabulary))
        where, size, names = [], [], []
        for patterns, begin, items in self.by_size:
            lo, hi = index.search(patterns)
            hit = np.flatnonzero(hi > lo)
            counts = (hi - lo)[hit]
            rows = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(hit) else lo[hit], counts) + np.arange(counts.sum())
            where.append(place[index.locate(rows)])
            size.append(np.full(len(rows), patterns.shape[1]))
            owners = [[self.names[j] for j in items[begin[i] : begin[i + 1]]] for i in hit.tolist()]
            names += [owners[i] for i in np.repeat(np.arange(len(hit)), counts).tolist()]
        return np.concatenate(where), np.concatenate(size), names


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching [begin, end) rows become one; sorted."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > end[:-1]])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], end[np.append(at[1:], len(spans)) - 1]], 1)


ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("removal_spans", T.ArrayType(T.LongType()))])


def scan_block(docs: DataFrame, items: list, text: str, window: int) -> DataFrame:
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))
    schema = T.StructType([f for f in docs.schema if f.name not in ADDED.names] + ADDED.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, words_out, items_out, spans_out = [], [], [], []
            names = batch.schema.names
            column = batch.column(names.index(text))
            before = [batch.column(names.index(c)).to_pylist() if c in names else [[]] * len(column) for c in ("hit_words", "hit_items")]
            data, offsets = blobs(column)
            for lo, hi in chunks(offsets, SHARD_BYTES):
                joined = b" ".join([data[offsets[i] : offsets[i + 1]].data for i in range(lo, hi)])
                words = joined.translate(TO_WORDS)
                inside = np.concatenate([[False], np.frombuffer(words, np.uint8) != 32, [False]])
                turns = np.flatnonzero(inside[1:] != inside[:-1])
                begin, end = turns[::2], turns[1::2]
                symbols = np.fromiter(map(phrases.value.vocabulary.get, words.split(), repeat(0)), np.int64, len(begin))
                base = offsets[lo : hi + 1] - offsets[lo] + np.arange(hi - lo + 1)  # a space stands between texts
                first = np.searchsorted(begin, base)
                counts = np.diff(first)
                where, size, owners = phrases.value.matches(symbols, first[:-1][counts > 0])
                doc_of = np.searchsorted(first, where, "right") - 1
                spans = {}
                if len(where):
                    by_doc = np.argsort(doc_of, kind="stable")
                    for part in np.split(by_doc, np.flatnonzero(np.diff(doc_of[by_doc])) + 1):
                        d = int(doc_of[part[0]])
                        b = where[part] - first[d]
                        spans[d] = np.stack([b, b + size[part]], 1), {x for i in part.tolist() for x in owners[i]}
                for d in range(hi - lo):
                    old, old_items = before[0][lo + d] or [], before[1][lo + d] or []
                    if d not in spans and not old:
                        mine, found = np.zeros((0, 2), np.int64), set(old_items)
                    else:
                        new, found = spans.get(d, (np.zeros((0, 2), np.int64), set()))
                        mine, found = merged(np.concatenate([np.array(old, np.int64).reshape(-1, 2), new])), found | set(old_items)
                    n_words.append(int(counts[d]))
                    words_out.append(mine.ravel())
                    items_out.append(sorted(found))
                    spans_out.append(np.stack([begin[first[d] + mine[:, 0]], end[first[d] + mine[:, 1] - 1]], 1).ravel() - base[d] if len(mine) else np.zeros(0, np.int64))
            kept = [i for i, c in enumerate(names) if c not in ADDED.names]
            arrays = [pa.array(n_words, pa.int64()), pa.array(words_out, pa.list_(pa.int64())), pa.array(items_out, pa.list_(pa.string())), pa.array(spans_out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + arrays, [names[i] for i in kept] + ADDED.names)

    return arrow_map(docs, run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add to each document what it shares with the benchmark, without a shuffle.

    ``n_words``; ``hit_words``, merged word ranges as begin, end, begin, end ...; ``hit_items``, names
    of the items with an occurring window; ``removal_spans``, the ranges as UTF-8 byte offsets.
    A window is ``window`` consecutive item words; an item of fewer words is one window. Null and
    empty texts have no words, items without words have no windows, an item without a name hits but
    isn't named, repeated items count once, repeated documents are judged each. Columns of the added
    names are replaced. Benchmarks beyond ``block_bytes`` are taken in blocks, one pass each, so that
    what is broadcast is bounded. All but the last pass write only what they found, by the text's hash, and the last one joins it.
    """
    docs = docs.drop(*ADDED.names)
    first = len(WRITTEN)
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.col(item_text).cast("string").alias("body")).filter("body IS NOT NULL")
    items = materialize(items.distinct())  # equal rows would meet in one block, however many they are
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks)))
    held = lambda block: [(r["name"], r["body"].encode()) for r in items.filter(F.col("block") == block).select("name", "body").collect()]
    if blocks == 1:
        rows = held(0)
        discard(docs.sparkSession, WRITTEN[first:])
        return scan_block(docs, rows, text, window)
    keys = {"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text)}  # what a text shares depends on the text alone
    texts, found = docs.select(text).withColumns(keys), None
    for block in range(blocks - 1):
        hits = materialize(scan_block(texts, held(block), text, window).filter("size(hit_words) > 0").select(*keys, "hit_words", "hit_items").dropDuplicates([*keys]))
        found = hits if found is None else found.union(hits)
    last = held(blocks - 1)
    found = materialize(found.groupBy(*keys).agg(F.flatten(F.collect_list("hit_words")).alias("hit_words"), F.flatten(F.collect_list("hit_items")).alias("hit_items")))
    discard(docs.sparkSession, WRITTEN[first:-1])
    joined = docs.withColumns(keys).join(found, [*keys], "left").select(*docs.columns, "hit_words", "hit_items")
    return scan_block(joined, last, text, window)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("hit_words") - 1, F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.get("hit_words", i) - F.get("hit_words", i - 1))
    n_hit = F.when(F.size("hit_words") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks),
hit AS (SELECT DISTINCT doc_id, i, bw.k, id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM dw) x JOIN bw ON x.win = bw.win AND x.k = bw.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT id) AS n_items, sha256(string_agg(DISTINCT id, ',' ORDER BY id)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
