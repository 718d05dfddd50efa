"""Importance resampling of documents towards a target distribution of hashed word n-grams.

An untrained pre-tokeniser of the tokenizers library, a Regex Split, gives the words of a text, lower-cased in
A-Z only, with their offsets. Each window from one word's begin to another's end, of one to three words, is a
feature, and its CRC-32 the bucket. A bucket's gain is the logarithm of its share in the target over its share
in the documents; a document's weight is the sum of its features' gains, and the highest weights plus Gumbel
noise of the document's own hash are drawn: a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from .common import arrow_map, blobs, chunks, materialize, numbered, read

#: A word is a maximal run of these characters in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets; words in the longest window; words that a document needs to be drawn; the share that is drawn.
BUCKETS, LONGEST, LEAST, SHARE = 10_000, 3, 20, (5, 100)
#: Characters that the pre-tokeniser gets at once, cut where no word is.
PIECE = 1 << 11
#: Different stretches between spaces, and words, that a worker keeps; characters of the longest that it keeps.
KEPT, KEPT_LENGTH = 400_000, 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


class Shifts:
    """CRC-32 values carried over zero bytes: crc(a + b) is crc(a) carried over len(b), xor crc(b).

    Carrying over is linear in the bits, so for each length it is four tables of 256 values.
    """

    def __init__(self) -> None:
        byte = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.steps = [(bits >> np.uint32(8)) ^ byte[bits & np.uint32(255)]]  # images of the 32 bits over 2^k bytes
        self.short = np.stack([self.table(n) for n in range(256)]).ravel()

    @staticmethod
    def along(values: np.ndarray, images: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint32)
        for bit in range(32):
            out ^= np.where(values >> np.uint32(bit) & np.uint32(1), images[bit], np.uint32(0))
        return out

    def table(self, length: int) -> np.ndarray:
        images, k = np.uint32(1) << np.arange(32, dtype=np.uint32), 0
        while length >> k:
            while len(self.steps) <= k:
                self.steps.append(self.along(self.steps[-1], self.steps[-1]))
            if length >> k & 1:
                images = self.along(images, self.steps[k])
            k += 1
        values = np.arange(256, dtype=np.uint32)
        return np.concatenate([self.along(values << np.uint32(8 * part), images) for part in range(4)])

    def over(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC carried over its own number of bytes."""
        if lengths.max(initial=0) < 256:
            tables, base = self.short, lengths.astype(np.int64) << 10
        else:
            kinds, which = np.unique(lengths, return_inverse=True)
            tables, base = np.concatenate([self.table(int(n)) for n in kinds]), which.astype(np.int64) << 10
        out = np.zeros(len(crc), np.uint32)
        for part in range(4):
            out ^= tables[base + 256 * part + (crc >> np.uint32(8 * part) & np.uint32(255))]
        return out


class Words(dict):
    """The words' numbers for each stretch between spaces, and by number a word's CRC, that of it and a space, and its bytes.

    No word holds a space, so the words of a text are those of its stretches in turn; the pre-tokeniser gets
    each different stretch once, and long ones in pieces each time.
    """

    def __init__(self, split: pre_tokenizers.Split) -> None:
        super().__init__()
        self.split, self.numbers = split, {}
        self.crc, self.spaced, self.size = array("I"), array("I"), array("q")

    def number(self, word: str) -> int:
        if word not in self.numbers:
            raw = word.encode("utf-8", "replace")
            self.numbers[word] = len(self.crc)
            self.crc.append(zlib.crc32(raw))
            self.spaced.append(zlib.crc32(raw + b" "))
            self.size.append(len(raw))
        return self.numbers[word]

    def __missing__(self, stretch: str) -> list[int]:
        found = [self.number(piece[begin:end]) for piece in pieces(stretch) for _, (begin, end) in self.split.pre_tokenize_str(piece)]
        if len(stretch) <= KEPT_LENGTH:
            self[stretch] = found
        return found

    def of(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.__getitem__, text.split(" ")))


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut only at characters that are in no word."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def windows(crc: np.ndarray, spaced: np.ndarray, size: np.ndarray, row: np.ndarray, longest: int, shifts: Shifts) -> tuple[np.ndarray, np.ndarray]:
    """(row, CRC) of every window of 1 to ``longest`` words joined by one space, within each row."""
    rows, found, lead = [row], [crc], spaced
    for n in range(1, longest):
        if len(crc) <= n:
            break
        whole = row[n:] == row[:-n]
        lead = lead[: len(crc) - n]  # of the n words before, each with its space
        both = shifts.over(lead, size[n:]) ^ crc[n:]
        rows.append(row[n:][whole])
        found.append(both[whole])
        lead = shifts.over(lead, size[n:] + 1) ^ spaced[n:]
    return np.concatenate(rows), np.concatenate(found)


def features(docs: DataFrame, keep: list[str], text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(kept, n_words, n_features, steps): of each row ``keep`` as a struct and its features' buckets.

    ``steps``: the buckets in ascending order as differences of 16 bits, which the table's codec packs well.
    """
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    ready = docs.select(kept.alias("kept"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([ready.schema["kept"], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("steps", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        shifts, words = Shifts(), Words(split)
        for batch in batches:
            data, at = blobs(batch.column(1))
            for lo, hi in chunks(at):
                if max(len(words), len(words.numbers)) > KEPT:
                    words = Words(split)
                numbers, ends = array("q"), [0]
                for i in range(lo, hi):
                    numbers.extend(words.of(data[at[i] : at[i + 1]].tobytes().translate(LOWER).decode("utf-8", "replace")))
                    ends.append(len(numbers))
                counts = np.diff(ends)
                row = np.repeat(np.arange(hi - lo), counts)
                of = [np.frombuffer(values, kind)[np.frombuffer(numbers, np.int64)] if numbers else np.zeros(0, kind) for values, kind in ((words.crc, np.uint32), (words.spaced, np.uint32), (words.size, np.int64))]
                rows, crc = windows(*of, row, longest, shifts)
                order = np.sort(rows * (1 << 16) + crc % np.uint32(buckets))
                ends = np.searchsorted(order, np.arange(hi - lo + 1) << 16)
                bucket = (order & 0xFFFF).astype(np.uint16)
                steps = [np.diff(bucket[a:b], prepend=np.uint16(0)).tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(np.diff(ends)), pa.array(steps, pa.binary())], ["kept", "n_words", "n_features", "steps"])

    return arrow_map(ready, run, schema)


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features fall in each bucket, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for steps in batch.column(0):
                bucket = np.cumsum(np.frombuffer(steps.as_py(), np.uint16), dtype=np.int64)
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return arrow_map(found.select("steps"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); ``buckets`` numbers on the driver."""
    counts = [dict(x.collect()) for x in (source, target)]
    every = source.sparkSession.createDataFrame([(b, counts[0].get(b, 0), counts[1].get(b, 0)) for b in range(buckets)], "bucket int, s long, t long")
    total = [float(sum(c.values()) + buckets) for c in counts]
    ratio = (F.col("t") + 1).cast("double") * F.lit(total[0]) / ((F.col("s") + 1).cast("double") * F.lit(total[1]))
    return np.array([r.gain for r in every.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``found`` with ``weight``, the sum of the gains of a row's features, in place of its buckets."""
    held = found.sparkSession.sparkContext.broadcast(gain)
    schema = T.StructType([*found.drop("steps").schema.fields, T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(held.value[np.cumsum(np.frombuffer(s.as_py(), np.uint16), dtype=np.int64)].sum()) for s in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], schema.names)

    return arrow_map(found, run, schema)


def resample(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, least: int = LEAST, share: tuple[int, int] = SHARE, seed: str = "42") -> DataFrame:
    """Columns ``keep`` (by default ``key``) of every row of ``docs``, with n_words, n_features, weight, score and rank.

    ``rank`` numbers the drawn rows from 1, highest score first, ties to the lesser key; it is null in all
    others. Drawn are ``share`` of the rows with ``least`` words or more. Null and empty texts have no features
    and weight 0; a null key counts as empty text in the noise and comes first among ties. Each of repeated rows
    is drawn for itself. Columns of ``keep`` that have a result's name are replaced. An empty target gives every
    bucket a gain of its rarity alone.
    """
    if buckets > 1 << 16:
        raise ValueError("at most 65,536 buckets")
    results = ("n_words", "n_features", "weight", "score", "rank")
    keep = [c for c in (keep or [key]) if c not in results]
    found = materialize(features(docs, [*keep, *([] if key in keep else [key])], text, buckets, longest), "zstd")
    aim = features(target, [], text, buckets, longest)
    rows = weighed(found, gains(histogram(found, buckets), histogram(aim, buckets), buckets))
    name = F.col(f"kept.{key}")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = rows.withColumns({"score": F.col("weight") + noise, "fit": F.col("n_words") >= least, "row": F.monotonically_increasing_id()})
    # rows that can't be drawn stand behind all others, dealt by ``row`` as those with equal scores are
    placed = numbered(scored, [F.desc("fit"), F.when(F.col("fit"), F.col("score")).desc(), F.when(F.col("fit"), name).asc(), F.col("row").asc()], "place")
    drawn = placed.filter("fit").count() * share[0] // share[1]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    return placed.select(*[F.col(f"kept.{c}").alias(c) for c in keep], "n_words", "n_features", "weight", "score", rank)


def op13_resample(spark, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_FEATURES = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s"
#: CRC-32 byte by byte, over a table that its polynomial gives.
OP13_SQL = f"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
x AS MATERIALIZED (SELECT row, {_FEATURES} FROM d),
y AS MATERIALIZED (SELECT {_FEATURES} FROM (SELECT {_WORDS} AS w FROM benchmark)),
b AS (SELECT s, list_transform(range(0, CAST(length(hex(s)) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(s), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM (SELECT s FROM x UNION SELECT s FROM y)),
k AS MATERIALIZED (SELECT s, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket FROM b, tab),
hs AS (SELECT bucket, count(*) AS n FROM x JOIN k ON x.s = k.s GROUP BY bucket),
ht AS (SELECT bucket, count(*) AS n FROM y JOIN k ON y.s = k.s GROUP BY bucket),
g AS (SELECT r.bucket, CAST(floor(1000 * ln(CAST(coalesce(ht.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM x) + 10000) / (CAST(coalesce(hs.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM y) + 10000)))) AS BIGINT) AS gain
      FROM range(10000) r(bucket) LEFT JOIN hs ON hs.bucket = r.bucket LEFT JOIN ht ON ht.bucket = r.bucket),
w AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight, count(*) AS n FROM x JOIN k ON x.s = k.s JOIN g ON g.bucket = k.bucket GROUP BY row),
s AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN w ON w.row = d.row),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM s)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM s WHERE n_words >= 20) THEN place END AS rank FROM r
"""
