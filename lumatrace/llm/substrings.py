"""Exact substring deduplication by common-prefix intervals of an enhanced suffix array.

A suffix array of all texts doesn't fit anywhere, and needn't: a string of ``min_len`` bytes that
occurs twice has the same least 32-byte hash, its anchor, at the same place in both occurrences. So
each window of ``min_len`` bytes belongs to one anchor, neighbouring windows of one anchor form a
segment, and equal windows meet in the group of their anchor's hash.

- Segments that occur twice as a whole are found by their hash and never compared.
- Groups of up to ``GROUP`` different segments are laid out together; their suffix array with common
  prefix lengths is scanned with a stack, and each interval whose occurrences are preceded by
  different bytes is a maximal repeat, given with all its occurrences.
- Larger groups are dealt again by a grid that lies on the anchor: windows that begin in one cell
  share all but twice the cell's width, whose hash splits the group. Cells get finer until a group
  is small or a cell is one window, which its hash alone decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WRITTEN, arrow_map, blobs, chunks, discard, materialize, read, text_key

MIN_LEN = 400
#: Bytes that an anchor's hash covers.
GRAM = 32
#: Different segments in a group that goes to a suffix array.
GROUP = 192
#: Bytes under one suffix array.
ARRAY_BYTES = 1 << 19
#: Bytes whose anchors are found at a time; longer texts are taken in pieces.
PIECE = 1 << 20
#: Widths of the cells of the grids, finer and finer.
GRIDS = (48, 8, 1)
#: Fixed odd multipliers of the gram hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
PLACE = (1 << 24) - 1
#: A value with over a HEAVY-th of all occurrences is joined by broadcast; there are fewer than HEAVY such values.
HEAVY = 1000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position that has so many."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k, m in enumerate(MIX):
        h += words[8 * k : 8 * k + n]
        h *= np.uint64(m)
        h ^= h >> np.uint64(29)
    return h


def segments(data: np.ndarray, ends: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor place and anchor hash of each segment of texts that end at ``ends``."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < min_len:
        return none
    hashes = gram_hashes(data)
    width = min_len - GRAM + 1
    keys = (hashes & ~np.uint64(PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - min_len + 1
    anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(PLACE)).astype(np.int64)
    room = np.zeros(n, bool)
    begins = np.concatenate([[0], ends[:-1]])
    for b, e in zip(begins[ends - begins >= min_len].tolist(), ends[ends - begins >= min_len].tolist(), strict=True):
        room[b : e - min_len + 1] = True
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    first = np.flatnonzero(room & (new | ~np.concatenate([[False], room[:-1]])))
    last = np.flatnonzero(room & np.concatenate([new[1:] | ~room[1:], [True]]))
    return first, last - first + 1, anchor[first], hashes[anchor[first]].view(np.int64)


SEGMENT = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "tk", "base", "lo", "n", "anchor", "grp", "seg", "c")])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_segments(docs: DataFrame, min_len: int) -> DataFrame:
    """A row for each segment of (key, tk, body); places are bytes from the text's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = blobs(batch.column(2))
            keys = batch.column(0).to_pylist()
            tks = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in chunks(at, PIECE):
                whole = data[at[a] : at[b]]
                ends = at[a + 1 : b + 1] - at[a]
                for start in range(0, max(1, len(whole)), 8 * PIECE):  # only a text that stands alone has more than one piece
                    piece = np.ascontiguousarray(whole[start : start + 8 * PIECE + min_len - 1])
                    first, n, anchor, group = segments(piece, np.minimum(ends, len(piece)) if b - a > 1 else np.array([len(piece)]), min_len)
                    if not len(first):
                        continue
                    doc = np.searchsorted(ends, first, "right") if b - a > 1 else np.zeros(len(first), np.int64)
                    raw = piece.tobytes()
                    hashes = [signed(xxhash.xxh3_64_intdigest(raw[f : f + k + min_len - 1], seed)) for f, k, seed in zip(first.tolist(), n.tolist(), (anchor - first).tolist(), strict=True)]
                    base = np.concatenate([[0], ends])[doc] - start
                    key = [keys[a + d] for d in doc.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(tks[a + doc]), pa.array(np.zeros(len(first), np.int64)), pa.array(first - base), pa.array(n), pa.array(anchor - base), pa.array(group), pa.array(hashes, pa.int64()), pa.array(np.ones(len(first), np.int64))], SEGMENT.names)

    return arrow_map(docs.select("key", "tk", "body"), run, SEGMENT)


def grid_segments(texts: DataFrame, cell: int, min_len: int) -> DataFrame:
    """The segments of (key, tk, base, lo, n, anchor, grp, c, body) cut at a grid on the anchor; base becomes lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in SEGMENT.names]
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, tk, _, lo, n, anchor, group, c, body = r
                at = lo
                while at < lo + n:
                    column = (at - anchor) // cell
                    stop = min(lo + n, anchor + (column + 1) * cell)
                    core = anchor + (column + 1) * cell - 1 - lo
                    sub = signed(xxhash.xxh3_64_intdigest(body[core : core + min_len - cell + 1], (group + column * MIX[0]) & ((1 << 64) - 1)))
                    own = signed(xxhash.xxh3_64_intdigest(body[at - lo : stop - lo + min_len - 1], (anchor - at) & ((1 << 64) - 1)))
                    for x, v in zip(out, (key, tk, lo, at, stop - at, anchor, sub, own, c), strict=True):
                        x.append(v)
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], SEGMENT.names)

    return arrow_map(texts.select("key", "tk", "base", "lo", "n", "anchor", "grp", "c", "body"), run, SEGMENT)


def cut_texts(wanted: DataFrame, source: DataFrame, min_len: int) -> DataFrame:
    """Add ``body``, the bytes of each wanted segment, from the source's (key, tk, base, body)."""
    per_text = wanted.groupBy("key", "tk", "base").agg(F.collect_list(F.struct("lo", "n", "anchor", "grp", "c")).alias("parts"))
    held = source.select(*[F.col(c).alias(f"s_{c}") for c in ("key", "tk", "base", "body")])
    on = F.col("key").eqNullSafe(F.col("s_key")) & (F.col("tk") == F.col("s_tk")) & (F.col("base") == F.col("s_base"))
    schema = T.StructType([f for f in SEGMENT.fields if f.name != "seg"] + [T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tk, base, body = (batch.column(i) for i in range(4))
            parts = batch.column(4)
            data, at = blobs(body)
            fields = parts.flatten()
            lo, n, anchor, group, c = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            row = np.repeat(np.arange(len(parts)), np.diff(np.asarray(parts.offsets)))
            from_ = at[row] + lo - base.to_numpy(zero_copy_only=False)[row]
            take = pa.array(row)
            for a in range(0, len(row), 4096):
                z = min(len(row), a + 4096)
                cut = [data[f : f + k + min_len - 1].tobytes() for f, k in zip(from_[a:z].tolist(), n[a:z].tolist(), strict=True)]
                arrays = [key.take(take[a:z]), tk.take(take[a:z]), base.take(take[a:z])] + [pa.array(x[a:z]) for x in (lo, n, anchor, group, c)] + [pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return arrow_map(per_text.join(held, on).select("key", "tk", "base", F.col("s_body").alias("body"), "parts"), run, schema)


class EnhancedSuffixArray:
    """Suffixes of the pieces that have ``min_len`` bytes before their piece ends, in order, with common prefix lengths."""

    def __init__(self, pieces: list[bytes], min_len: int) -> None:
        self.min_len = min_len
        joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        ends = self.starts + sizes
        n = len(joined)
        symbols = joined.astype(np.int64) + 1
        symbols[ends] = 0
        self.symbols = symbols
        self.left = np.concatenate([[0], symbols[:-1]])  # 0: nothing stands before it in its piece
        room = np.repeat(ends, sizes + 1) - np.arange(n)
        wide = np.concatenate([symbols, np.zeros(8, np.int64)])
        key = np.zeros(n, np.int64)
        for t in range(7):
            key = (key << 9) | wide[t : t + n]
        self.ranks: list[tuple[int, np.ndarray]] = []
        depth, longest = 7, int(sizes.max(initial=0))
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1], dtype=np.int32)])
            self.ranks.append((depth, rank))
            if depth >= longest or int(rank.max(initial=0)) == n - 1:
                break
            then = np.zeros(n, np.int64)
            then[: n - depth] = rank[depth:].astype(np.int64) + 1
            key = rank.astype(np.int64) * (n + 1) + then
            depth *= 2
        self.suffixes = order[room[order] >= min_len]
        a, b = self.suffixes[:-1], self.suffixes[1:]
        most = np.minimum(room[a], room[b]) if len(a) else np.zeros(0, np.int64)
        self.common = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.ranks):
            x, y = a + self.common, b + self.common
            fit = (x < n) & (y < n)
            fit[fit] = rank[x[fit]] == rank[y[fit]]
            self.common[fit] += depth
        self.common = np.minimum(self.common + self._tail(a, b, n), most)

    def _tail(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Up to 6 equal symbols beyond what the ranks tell."""
        more, on = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for _ in range(6):
            x, y = a + self.common + more, b + self.common + more
            on &= (x < n) & (y < n)
            on[on] = self.symbols[x[on]] == self.symbols[y[on]]
            more += on
        return more

    def repeats(self) -> Iterator[tuple[int, np.ndarray]]:
        """Length and places of each maximal repeat of at least ``min_len`` bytes: all occurrences of it."""
        deep = self.common >= self.min_len
        begin = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]]))
        end = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]])) + 1
        for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
            left = self.left[self.suffixes[lo : hi + 1]]
            if left[0] and (left == left[0]).all():
                continue  # each occurrence is preceded by the same byte: no interval in here is maximal
            left, lcp = left.tolist(), [*self.common[lo:hi].tolist(), 0]
            stack: list[list[int]] = []  # [length, first suffix, byte before all of them or 0 if they differ]
            for i, length in enumerate(lcp):
                from_, before = i, left[i]
                while stack and stack[-1][0] > length:
                    top = stack.pop()
                    before = before if before == top[2] else 0
                    if not before:
                        yield top[0], self.suffixes[lo + top[1] : lo + i + 1]
                    from_ = top[1]
                if stack and stack[-1][0] == length:
                    stack[-1][2] = before if before == stack[-1][2] else 0
                elif length:
                    stack.append([length, from_, before])


def repeated(pieces: list[bytes], min_len: int) -> list[np.ndarray]:
    """For each piece the [begin, end) rows that maximal repeats cover, merged."""
    array = EnhancedSuffixArray(pieces, min_len)
    covered = np.zeros(len(array.symbols) + 1, np.int64)
    for length, places in array.repeats():
        np.add.at(covered, places, 1)
        np.add.at(covered, places + length, -1)
    inside = np.concatenate([[False], np.cumsum(covered)[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    at = np.searchsorted(turns[:, 0], np.append(array.starts, len(array.symbols)))
    return [turns[at[i] : at[i + 1]] - array.starts[i] for i in range(len(pieces))]


def array_spans(texts: DataFrame, min_len: int) -> DataFrame:
    """Spans (key, tk, begin, end) of segments that occur once, covered by what other segments of their group hold."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("grp", "key", "tk", "lo", "c", "body").repartition(parts, "grp").sortWithinPartitions("grp")

    def spans(held: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for (_, key, tk, lo, c, _), found in zip(held, repeated([r[5] for r in held], min_len), strict=True):
            for b, e in found.tolist() if c == 1 else ():
                for x, v in zip(out, (key, tk, lo + b, lo + e), strict=True):
                    x.append(v)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["key", "tk", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > ARRAY_BYTES and r[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield spans(held)

    return arrow_map(rows, run, "key long, tk long, begin long, end long")


def semi(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose ``on`` is in ``wanted`` (on, c), where ``c`` counts occurrences, without a task for a hot value.

    Values with over a HEAVY-th of all occurrences, fewer than HEAVY of them, are broadcast, so that their
    rows stay where they are; the rest is joined by a shuffle.
    """
    total = wanted.agg(F.sum("c")).first()[0] or 0
    heavy = F.broadcast(wanted.filter(F.col("c") * HEAVY > total).select(on))
    return rows.join(heavy, on, "left_semi").union(rows.join(heavy, on, "left_anti").join(wanted.filter(F.col("c") * HEAVY <= total).select(on), on, "left_semi"))


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """Spans (key, tk, begin, end), in bytes, of (key, tk, body) that ``min_len``-byte repeats cover; they may overlap."""
    spans, source, rows = [], docs.withColumn("base", F.lit(0).cast("long")), text_segments(docs, min_len)
    for cell in (*GRIDS, None):
        before = len(WRITTEN)
        rows = materialize(rows)
        twice = materialize(rows.groupBy("grp").agg(F.sum("c").alias("c")).filter("c > 1"))
        rows = materialize(semi(rows, twice, ["grp"]))
        discard(docs.sparkSession, WRITTEN[before:-1])
        kinds = materialize(rows.groupBy("grp", "seg").agg(F.sum("c").alias("c"), F.min(F.struct("key", "tk", "base", "lo", "n", "anchor")).alias("one")).select("grp", "seg", "c", "one.*"))
        whole = semi(rows.select("key", "tk", "lo", "n", "grp", "seg"), kinds.filter("c > 1").select("grp", "seg", "c"), ["grp", "seg"])
        spans.append(whole.select("key", "tk", F.col("lo").alias("begin"), (F.col("lo") + F.col("n") + (min_len - 1)).alias("end")))
        mixed = materialize(kinds.groupBy("grp").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("c") == 1).alias("single")).filter("kinds > 1 AND single > 0").select("grp", "kinds"))
        if cell is None or mixed.isEmpty():
            break
        texts = cut_texts(kinds.join(mixed.select("grp"), "grp", "left_semi"), source, min_len)
        large = materialize(mixed.filter(F.col("kinds") > GROUP).select("grp"))
        if large.isEmpty():
            spans.append(array_spans(texts, min_len))
            break
        texts = materialize(texts)
        spans.append(array_spans(texts.join(large, "grp", "left_anti"), min_len))
        source = materialize(texts.join(large, "grp", "left_semi"))
        rows = grid_segments(source, cell, min_len)
        source = source.select("key", "tk", F.col("lo").alias("base"), "body")
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    return out


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), text_key(text).alias("tk"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))


def with_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", min_len: int = MIN_LEN) -> DataFrame:
    """Add ``repeats`` to each row: begin and end, in UTF-8 bytes, of what ``min_len``-byte repeats cover, unmerged, in any order.

    A byte is covered by a string of ``min_len`` bytes that also starts elsewhere, in the same or in
    another row; overlapping occurrences count and texts aren't joined. Null is as empty: nothing
    repeats in it. Repeated rows are repeats of one another. Null keys are a value like any other.
    """
    found = repeated_spans(keyed(docs, text, key), min_len).groupBy(F.col("key").alias("__key"), F.col("tk").alias("__tk")).agg(F.collect_set(F.struct("begin", "end")).alias("repeats"))  # copies of a row give equal spans
    docs = docs.drop("repeats").withColumn("__own", text_key(text))
    on = docs[key].cast("long").eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__tk"))
    return docs.join(found, on, "left").drop("__key", "__tk", "__own")


def union_of(spans: np.ndarray) -> np.ndarray:
    """Merged [begin, end) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    at = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > end[:-1]]))
    return np.stack([spans[at, 0], end[np.append(at[1:], len(spans)) - 1]], 1)


def spans_by_row(column: pa.ListArray) -> Iterator[np.ndarray]:
    fields = column.flatten()
    both = np.stack([fields.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1) if len(fields) else np.zeros((0, 2), np.int64)
    sizes = np.where(np.asarray(column.is_null()), 0, np.diff(np.asarray(column.offsets)))
    for a, k in zip(np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist(), sizes.tolist(), strict=True):
        yield union_of(both[a : a + k]) if k else both[:0]


def without(body: np.ndarray, spans: np.ndarray, whole_characters: bool = False) -> bytes:
    """The bytes outside the spans; ``whole_characters``: spans shrink to whole UTF-8 characters first."""
    out, at = [], 0
    for b, e in spans.tolist():
        if whole_characters:
            while b < e and body[b] & 0xC0 == 0x80:
                b += 1
            while e > b and e < len(body) and body[e] & 0xC0 == 0x80:
                e -= 1
        out.append(body[at:b].tobytes())
        at = e
    out.append(body[at:].tobytes())
    return b"".join(out)


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = blobs(batch.column(1))
            out: list[list] = [[], [], [], []]
            for i, spans in enumerate(spans_by_row(batch.column(2))):
                body = data[at[i] : at[i + 1]]
                row = len(body), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(without(body, spans)).hexdigest()
                for x, v in zip(out, row, strict=True):
                    x.append(v)
            arrays = [pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_repeats(docs).select("doc_id", F.col("text").cast("binary"), "repeats")
    return arrow_map(found, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, text: str = "text", spans: str = "repeats") -> DataFrame:
    """``text`` without the byte spans (array of begin, end structs) of column ``spans``, shrunk to whole characters.

    Adds ``emptied``: something was cut and only white space is left. Null texts stay null.
    """
    fields = [T.StructField(text, T.StringType()) if f.name == text else f for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("emptied", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index(text)
            column = batch.column(at_text)
            data, at = blobs(column)
            texts, emptied = [], []
            missing = np.asarray(column.is_null())
            for i, found in enumerate(spans_by_row(batch.column(batch.schema.get_field_index(spans)))):
                kept = without(data[at[i] : at[i + 1]], found, True).decode("utf-8", "replace")
                texts.append(None if missing[i] else kept)
                emptied.append(len(found) > 0 and not kept.strip())
            arrays = [pa.array(texts, pa.string()) if i == at_text else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(emptied, pa.bool_())], [*batch.schema.names, "emptied"])

    return arrow_map(docs, run, schema)
