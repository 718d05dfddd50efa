"""Toxicity by compression distance.

Two dictionaries are trained by zstandard, one on ordinary text and one on toxic text, of which the
passages that set it apart count. Each window of a few words is compressed twice: with the ordinary dictionary and
with the toxic one laid behind the same ordinary text. What the toxic dictionary saves is the
window's distance; how many windows of a text exceed calibrated thresholds gives the text's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, arrow_map, blobs, chunks, hash_sample, materialize, read

#: Bounds of the training sample: toxic and ordinary rows, and characters of all rows of a class together.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 3000, 6000, 32_000_000
#: Words in a window; bytes of the dictionaries; letters of a contrast gram; least ratio of row shares.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, GRAM, RATIO = 8, 40 << 10, 8 << 10, 5, 24.0
#: Lengths of the segments that zstandard takes into a dictionary, and of the strings that it counts for them.
SEGMENT, COUNTED = 64, 6
#: Thresholds whose exceedances are counted, in bytes saved.
STEPS = (2, 3, 4, 5, 6)
#: Score from which a text is predicted toxic.
CUT = 0.7
#: Letters, digits and bytes of other scripts stay; the rest separates words. Lower-casing came before.
WORDS = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def spaced(text: str) -> bytes:
    """The words of ``text`` between spaces, with one at either end."""
    return b" " + text.lower().encode("utf-8", "replace").translate(WORDS) + b" "


def words_of(text: str) -> list[bytes]:
    return spaced(text).split()


def compressor(content: bytes) -> zstd.ZstdCompressor:
    """Bare frames: nothing but the compressed bytes adds to a length."""
    plain = zstd.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=plain)


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes that zstandard trains on the samples.

    Zstandard refuses fewer than about ten samples or some hundred bytes; then the dictionary is
    each different one, the commonest last.
    """
    try:
        return zstd.train_dictionary(size, samples, k=SEGMENT, d=COUNTED).as_bytes()
    except zstd.ZstdError:
        return b"".join(w for w, _ in reversed(Counter(samples).most_common()))[-size:]


class Toxicity:
    """A model: two dictionaries and a logistic calibration of the windows' distances."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self.weights = np.zeros(2 * len(STEPS) + 1)
        self.middle, self.spread = np.zeros(2 * len(STEPS)), np.ones(2 * len(STEPS))
        self._pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The text of each window, and how many bytes the toxic dictionary saves there."""
        if self._pair is None:
            self._pair = compressor(self.ordinary), compressor(self.ordinary + self.toxic)
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        if not counts.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = b" " + b" ".join([w for x in words for w in x]) + b" "
        space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        per_text = -(-counts // WINDOW)
        text = np.repeat(np.arange(len(texts)), per_text)
        within = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        first = (np.cumsum(counts) - counts)[text]
        a = space[first + within * WINDOW]
        z = space[first + np.minimum((within + 1) * WINDOW, counts[text])] + 1
        windows = zstd.BufferWithSegments(data, np.stack([a, z - a], 1).astype(np.uint64).tobytes())
        sizes = []
        for c in self._pair:
            out = c.multi_compress_to_buffer(windows)
            sizes.append(np.fromiter(map(len, (out[i] for i in range(len(out)))), np.int64, len(out)))
        return text, sizes[0] - sizes[1]

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each threshold the log count of windows beyond it, and their share."""
        text, saved = self.distances(texts)
        n = len(texts)
        total = np.maximum(np.bincount(text, minlength=n), 1)
        counts = np.stack([np.bincount(text[saved >= s], minlength=n) for s in STEPS], 1)
        return np.concatenate([np.log1p(counts), np.sqrt(counts / total[:, None])], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = (self.evidence(texts) - self.middle) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def calibrate(self, x: np.ndarray, labels: np.ndarray, n_toxic: int, n_ordinary: int) -> Toxicity:
        """Ridge logistic regression on the texts' evidence by Newton's method; classes weigh as in all labelled rows."""
        if not 0 < labels.sum() < len(labels):
            return self
        shares = np.where(labels == 1, n_toxic / labels.sum(), n_ordinary / (1 - labels).sum())
        shares = shares / shares.mean()
        self.middle, self.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        x = np.concatenate([(x - self.middle) / self.spread, np.ones((len(x), 1))], 1)
        w = self.weights
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (shares * (labels - p)) - 0.5 * np.append(w[:-1], 0)
            curve = (x * (shares * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.diag([1.0] * (len(w) - 1) + [1e-6])
            w = w + np.linalg.solve(curve, slope)
        self.weights = w
        return self


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of ``spaced`` bytes as numbers, and where each begins; a step takes CHUNK_BYTES.

    A gram is GRAM bytes of a word and the spaces around it, or all of a shorter word with both spaces.
    """
    for lo in range(0, len(data), CHUNK_BYTES):
        block = data[lo : lo + CHUNK_BYTES + GRAM - 1]
        space = block == 32
        codes, begins = [], []
        for size in range(3, GRAM + 1):
            n = max(0, len(block) - size + 1)
            stands = space[:n] & space[size - 1 : size - 1 + n] if size < GRAM else np.ones(n, bool)
            for k in range(1, size - 1):
                stands &= ~space[k : k + n]
            at = np.flatnonzero(stands)
            code = np.zeros(len(at), np.int64)
            for k in range(size):
                code = code << 8 | block[at + k]
            codes.append(code)
            begins.append(lo + at)
        yield np.concatenate(codes), np.concatenate(begins)


def gram_counts(rows: Iterable[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of (text, label) rows, and how many toxic and how many ordinary rows hold each."""
    held: tuple[list, list] = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text, label in rows:
        parts = [np.unique(codes) for codes, _ in grams(np.frombuffer(spaced(text), np.uint8))]
        held[label].append(np.unique(np.concatenate(parts)))
    good, bad = map(np.concatenate, held)
    every, at = np.unique(np.concatenate([bad, good]), return_inverse=True)
    return every, np.bincount(at[: len(bad)], minlength=len(every)), np.bincount(at[len(bad) :], minlength=len(every))


def set_apart(bad, good, n_toxic: int, n_ordinary: int):
    """Whether a gram of ``bad`` toxic and ``good`` ordinary rows has RATIO times its ordinary share in toxic rows."""
    return (bad >= 4) & (bad * (n_ordinary / max(1, n_toxic)) >= RATIO * (good + 1))


def samples(text: str, label: int, apart: np.ndarray) -> list[bytes]:
    """What a row gives its dictionary: an ordinary one all windows, a toxic one each word that holds a gram of ``apart`` (sorted)."""
    raw = spaced(text)
    data = np.frombuffer(raw, np.uint8)
    space = data == 32
    before, behind = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:]) + 2
    if label:
        if not len(apart):
            return []
        words = [np.searchsorted(before, at[apart.take(np.searchsorted(apart, codes), mode="clip") == codes], "right") - 1 for codes, at in grams(data)]
        first = last = np.unique(np.concatenate(words))
    else:
        first = np.arange(0, len(before), WINDOW)
        last = np.minimum(first + WINDOW, len(before)) - 1
    return [b" " + b" ".join(raw[a:z].split()) + b" " for a, z in zip(before[first].tolist(), behind[last].tolist(), strict=True)]


def with_dictionaries(plain: list[bytes], apart: list[bytes]) -> Toxicity:
    return Toxicity(trained(plain, ORDINARY_BYTES) if plain else b" " * 256, trained(apart, TOXIC_BYTES) if apart else b"")


def train(rows: list[tuple[str, int]], n_toxic: int, n_ordinary: int) -> Toxicity:
    """A model from a few (text, label) rows, without Spark; ``fit`` makes the same from a table.

    Two thirds train the dictionaries, one third calibrates. ``n_toxic`` and ``n_ordinary`` are the labelled rows
    of each class, of which ``rows`` is a sample.
    """
    learn = [r for i, r in enumerate(rows) if i % 3]
    check = [r for i, r in enumerate(rows) if i % 3 == 0]
    toxic = sum(y for _, y in learn)
    every, bad, good = gram_counts(learn)
    apart = every[set_apart(bad, good, toxic, len(learn) - toxic)]
    model = with_dictionaries(*([w for t, y in learn if y == k for w in samples(t, y, apart)] for k in (0, 1)))
    return model.calibrate(model.evidence([t for t, _ in check]), np.array([y for _, y in check], float), n_toxic, n_ordinary)


def by_chunk(rows: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` gives, as columns and their names, for lists of places, texts and labels of about CHUNK_BYTES of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(blobs(batch.column("t"))[1]):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(*make(*(part.column(c).to_pylist() for c in ("place", "t", "toxic"))))

    return arrow_map(rows.select("place", "t", "toxic"), run, schema)


def fit(sample: DataFrame, n_toxic: int, n_ordinary: int) -> Toxicity:
    """The model that ``train`` makes of the rows of ``sampled``, whose texts stay in tasks.

    Tasks count grams, make the dictionaries' samples and weigh the calibrating texts. The driver gets the grams that
    set toxic rows apart, the samples that zstandard takes, and a row of numbers for each calibrating text.
    """
    context = sample.sparkSession.sparkContext
    learn, check = sample.filter("place % 3 <> 0"), sample.filter("place % 3 = 0")
    sizes = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}

    def count(_, texts, labels):
        return [pa.array(x, pa.int64()) for x in gram_counts(zip(texts, labels, strict=True))], ["gram", "bad", "good"]

    counted = by_chunk(learn, count, "gram long, bad long, good long").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = counted.filter(set_apart(F.col("bad"), F.col("good"), sizes.get(1, 0), sizes.get(0, 0))).select("gram").toArrow()
    apart = context.broadcast(np.sort(found["gram"].to_numpy()))

    def sampled_of(places, texts, labels):
        made = [samples(t, y, apart.value) for t, y in zip(texts, labels, strict=True)]
        return [pa.array(places, pa.int64()), pa.array(labels, pa.int32()), pa.array(made, pa.list_(pa.binary()))], ["place", "toxic", "made"]

    made = by_chunk(learn, sampled_of, "place long, toxic int, made array<binary>").toArrow().sort_by("place")
    labels = made["toxic"].to_numpy()
    model = with_dictionaries(*(made["made"].filter(pa.array(labels == k)).combine_chunks().flatten().to_pylist() for k in (0, 1)))
    del made
    held = context.broadcast(model)

    def weigh(places, texts, labels):
        x = held.value.evidence(texts)
        return [pa.array(places, pa.int64()), pa.array(labels, pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["place", "toxic", "x"]

    weighed = by_chunk(check, weigh, "place long, toxic int, x array<double>").toArrow().sort_by("place")
    x = weighed["x"].combine_chunks().flatten().to_numpy().reshape(len(weighed), 2 * len(STEPS))
    return model.calibrate(x, weighed["toxic"].to_numpy().astype(float), n_toxic, n_ordinary)


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """At most TOXIC_ROWS and ORDINARY_ROWS labelled rows, by the least hash of doc_id, each with its whole text.

    The ids are chosen from ``labels`` before texts are read, so only the sample's texts travel. A doc_id
    that repeats counts once, with its least text. Where the texts of a class pass SAMPLE_CHARS together,
    rows that no longer fit stay out; no text is cut. ``place`` numbers the rows by doc_id.
    """
    known = labels.select("doc_id", "toxic").filter("toxic IN (0, 1) AND doc_id IS NOT NULL").distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for value, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        part = hash_sample(known.filter(F.col("toxic") == value), F.col("doc_id"), counts.get(value, 0), most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = materialize(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t")))
    sizes = found.select("doc_id", "toxic", F.length("t").alias("n"), F.xxhash64("doc_id").alias("hash")).collect()  # at most TOXIC_ROWS + ORDINARY_ROWS
    total, fits = Counter(), []
    for r in sorted(sizes, key=lambda r: (r["hash"], r["doc_id"])):
        if total[r["toxic"]] + r["n"] <= SAMPLE_CHARS:
            total[r["toxic"]] += r["n"]
            fits.append((r["doc_id"], r["toxic"]))
    schema = T.StructType([*found.select("doc_id", "toxic").schema, T.StructField("place", T.LongType())])
    kept = docs.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(sorted(fits))], schema)
    return found.join(F.broadcast(kept), ["doc_id", "toxic"]).select("place", "t", F.col("toxic").cast("int").alias("toxic")), counts.get(1, 0), counts.get(0, 0)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], int, int]:
    """The rows of ``sampled`` in the driver, as ``train`` takes them."""
    rows, n_toxic, n_ordinary = sampled(docs, labels)
    return [(t, y) for _, t, y in sorted(map(tuple, rows.collect()))], n_toxic, n_ordinary


def score(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to each row, without a shuffle; the model (48 KB) is broadcast.

    Every window of the whole text counts. Null, empty and wordless texts have no windows and get the
    score of a text without evidence. Repeated rows are scored each; columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = [held.value.scores([t or "" for t in column.slice(lo, hi - lo).to_pylist()]) for lo, hi in chunks(blobs(column)[1])]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= CUT).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return arrow_map(docs, run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*sampled(docs, read(spark, sf_dir, "labels").filter(~held_out())))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
