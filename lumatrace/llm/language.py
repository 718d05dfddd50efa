"""Language identification by a linear-chain conditional random field over words.

Words get scores from affixes, character n-grams and a lexicon, neighbouring words are tied by
learned transitions, and forward-backward gives each word's label probabilities, so that code-switched
text is labelled word by word. A document's label is the one with the highest expected share of
letters. A text is one chain: its words are taken in blocks, whose transfer matrices carry the state from
block to block.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, blobs, chunks, give_back, read

#: Bounds of the training sample: rows of one language, and characters of all of them together.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 2_000_000
#: Hash buckets of the features, words in the lexicon, words of one block.
BUCKET_BITS, LEXICON, CHAIN = 15, 4000, 64
BUCKETS = 1 << BUCKET_BITS
#: Values of transfer matrices, and of word scores, that are held at a time.
MATRICES, SCORES = 1 << 21, 1 << 21
#: Characters that are split into words at once.
PIECE = 1 << 20
#: Odd factors of the features' hash.
FACTOR, MIXER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Letters of a word; what is longer, as in scripts without spaces, is taken as several words.
WORD = 40
CACHE_WORDS = 150_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Letters and bytes of other scripts stay; everything else of ASCII separates words. Lower-casing came before.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def bucket(kind: int, *letters: np.ndarray) -> np.ndarray:
    """The bucket of a feature: its kind and up to three letters (0 for none)."""
    h = np.full(len(letters[0]), kind, np.uint64)
    for c in letters:
        h = h * np.uint64(FACTOR) + c.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(MIXER)
    return (LEXICON + 1 + (h >> np.uint64(64 - BUCKET_BITS))).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, word after word, and how many each has.

    A word has the lexicon's entry or a mark of its absence, prefixes and suffixes of 1 to 3, and n-grams of 2 and 3.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), np.uint32)
    end = np.cumsum(sizes)
    begin = end - sizes
    left = np.repeat(end, sizes) - np.arange(len(text))  # letters and marks from here to the word's end
    word = np.repeat(np.arange(len(words)), sizes)
    known = np.fromiter((lexicon.get(w, LEXICON) for w in words), np.int64, len(words))
    ids, owner = [known], [np.arange(len(words))]
    for k in (1, 2, 3):
        for kind, side in ((2, lambda j: begin + 1 + j), (3, lambda j: end - 2 - j)):
            letters = [np.where(sizes - 2 > j, text[np.clip(side(j), 0, len(text) - 1)], 0) for j in range(k)]
            ids.append(bucket(10 * kind, *letters, *[np.zeros(len(words), np.uint32)] * (3 - k)))
            owner.append(owner[0])
    for k in (2, 3):
        at = np.flatnonzero(left >= k)
        ids.append(bucket(k, *[text[at + j] for j in range(k)]))
        owner.append(word[at])
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(ids)[order], 7 + (sizes - 1) + (sizes - 2)


def split(text: str) -> list[bytes]:
    """Lower-case words in UTF-8; words of over WORD letters in consecutive pieces."""
    words = text.lower().encode("utf-8", "replace").translate(LETTERS).split()
    if words and max(map(len, words)) > WORD:
        return [p for w in words for p in ([w] if len(w) <= WORD else pieces(w))]
    return words


def pieces(word: bytes) -> list[bytes]:
    letters = word.decode("utf-8", "replace")
    return [letters[i : i + WORD].encode("utf-8") for i in range(0, len(letters), WORD)]


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in split(text)]


class Crf:
    """Weights (features x labels), transitions, and first-word scores."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]) -> None:
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((LEXICON + 1 + BUCKETS, k), np.float32)
        self.step = np.zeros((k, k))
        self.start = np.zeros(k)

    def scores(self, words: list[str]) -> np.ndarray:
        """The label scores of each word by itself: the mean of its features' weights, times 4."""
        flat, sizes = features(words, self.lexicon)
        sums = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) if len(flat) else np.zeros((0, len(self.labels)), np.float32)
        return 4 * sums / sizes[:, None]

    def carried(self, block, n: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reaches each of n blocks from the words before it and from those behind it, in the order of the texts.

        ``block`` gives for some blocks their word scores (blocks x words x labels, as factors) and which words are
        real; ``first`` and ``last`` mark the blocks that begin and end a text. A block's transfer matrix is the product of
        its words' transitions, and the states are carried along these. MATRICES values of such matrices are held
        at a time: where there are more, they are made again on the way back.
        """
        k = len(self.labels)
        move, start = np.exp(self.step), np.exp(self.start)
        before, behind, out = np.tile(start, (n, 1)), np.full((n, k), 1 / k), np.full((n, k), 1 / k)
        some, most = np.flatnonzero(~(first & last)), max(1, MATRICES // (k * k))
        groups = [some[a : a + most] for a in range(0, len(some), most)]

        def transfers(part: np.ndarray) -> np.ndarray:
            local, live = block(part)
            now = np.where(first[part, None, None], start, move) * local[:, 0][:, None, :]
            for t in range(1, local.shape[1]):
                new = (now @ move) * local[:, t][:, None, :]
                now = np.where(live[:, t][:, None, None], new / new.max((1, 2), keepdims=True), now)
            return now

        def steps(part: np.ndarray) -> list[np.ndarray]:
            """Numbers within the group: the first blocks of all texts, then the second ones, and so on."""
            head = first[part].copy()
            head[0] = True
            place = np.arange(len(part)) - np.maximum.accumulate(np.where(head, np.arange(len(part)), 0))
            order = np.argsort(place, kind="stable")
            return np.split(order, np.searchsorted(place[order], np.arange(1, place.max() + 1)))

        for part in groups:
            transfer = transfers(part)
            for at in steps(part):
                at = at[~last[part[at]]]
                blocks = part[at]
                into = np.where(first[blocks, None], 1 / k, out[blocks - 1])
                state = np.einsum("nk,nkj->nj", into, transfer[at])
                out[blocks] = state / state.sum(1, keepdims=True)  # the state behind a block's last word
                before[blocks + 1] = out[blocks] @ move
        for part in reversed(groups):
            if len(groups) > 1:
                transfer = transfers(part)
            for at in reversed(steps(part)):
                at = at[~first[part[at]]]
                blocks = part[at]
                state = np.einsum("nkj,nj->nk", transfer[at], behind[blocks])
                behind[blocks - 1] = state / state.sum(1, keepdims=True)
        return before, behind

    def marginals(self, scores: np.ndarray, live: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, beyond: np.ndarray | None = None):
        """Forward-backward over chains x words x labels; ``live`` marks real words, at each chain's begin.

        Returns the label probabilities, and with ``pairs`` the expected transitions too. ``before`` and
        ``beyond``: what ``carried`` says of chains that are blocks of longer ones; a block that goes on is full.
        """
        n, size, k = scores.shape
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        local[~live] = 1.0
        move = np.exp(self.step)
        ahead, behind = np.empty((size, n, k)), np.empty((size, n, k))
        now = local[:, 0] * (np.exp(self.start) if before is None else before)
        ahead[0] = now / now.sum(1, keepdims=True)
        for t in range(1, size):
            now = (ahead[t - 1] @ move) * local[:, t]
            now /= now.sum(1, keepdims=True)
            ahead[t] = np.where(live[:, t, None], now, ahead[t - 1])
        behind[size - 1] = 1 / k if beyond is None else beyond
        for t in range(size - 2, -1, -1):
            now = (behind[t + 1] * local[:, t + 1]) @ move.T
            now /= now.sum(1, keepdims=True)
            behind[t] = np.where(live[:, t + 1, None], now, 1 / k)
        both = ahead * behind
        both /= both.sum(2, keepdims=True)
        both = both.transpose(1, 0, 2)
        if not pairs:
            return both
        expected = np.zeros((k, k))
        for t in range(1, size):
            joint = ahead[t - 1][:, :, None] * move[None] * (local[:, t] * behind[t])[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            expected += joint[live[:, t]].sum(0)
        return both, expected

    def fit(self, texts: list[tuple[str, str]], rounds: int = 5, rate: float = 0.5, seed: int = 1) -> Crf:
        """Maximum likelihood by AdaGrad over chains that mix stretches of texts of several languages."""
        rng = np.random.default_rng(seed)
        at = {name: i for i, name in enumerate(self.labels)}
        stretches = []
        for text, name in texts:
            words, i = words_of(text), 0
            while i < len(words):
                size = int(rng.integers(4, CHAIN + 1))
                stretches.append((words[i : i + size], at[name]))
                i += size
        if not stretches:
            return self
        vocabulary = {w: i for i, w in enumerate(sorted({w for s, _ in stretches for w in s}))}
        flat, sizes = features(list(vocabulary), self.lexicon)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        k = len(self.labels)
        past_w, past_s, past_b = np.full_like(self.weights, 1e-3), np.full((k, k), 1e-3), np.full(k, 1e-3)
        for _ in range(rounds):
            order = rng.permutation(len(stretches))
            chains, now, gold = [], [], []
            for i in order.tolist():  # half of all chains hold more than one stretch
                now += [vocabulary[w] for w in stretches[i][0]]
                gold += [stretches[i][1]] * len(stretches[i][0])
                if len(now) >= CHAIN or rng.random() < 0.5:
                    chains.append((now[:CHAIN], gold[:CHAIN]))
                    now, gold = now[CHAIN:], gold[CHAIN:]  # what is left begins the next chain
            if now:
                chains.append((now, gold))
            for a in range(0, len(chains), 256):
                part = chains[a : a + 256]
                words = np.full((len(part), CHAIN), -1)
                truth = np.zeros((len(part), CHAIN), np.int64)
                for i, (w, g) in enumerate(part):
                    words[i, : len(w)], truth[i, : len(w)] = w, g
                live = words >= 0
                used, word = np.unique(words[live], return_inverse=True)
                mine = np.zeros(len(sizes), bool)
                mine[used] = True
                names, size = flat[mine[owner]], sizes[used]
                table = 4 * np.add.reduceat(self.weights[names], np.cumsum(size) - size, axis=0) / size[:, None]
                scores = np.zeros((*words.shape, k))
                scores[live] = table[word]
                prob, expected = self.marginals(scores, live, True)
                want = np.eye(k)[truth]
                error, grad = (want - prob)[live], np.empty_like(self.weights)
                for label in range(k):
                    share = 4 * np.bincount(word, error[:, label], len(used)) / size
                    grad[:, label] = np.bincount(names, np.repeat(share, size), len(grad))
                follows = live[:, 1:]
                seen = np.zeros((k, k))
                np.add.at(seen, (truth[:, :-1][follows], truth[:, 1:][follows]), 1)
                for value, past, g in ((self.weights, past_w, grad), (self.step, past_s, seen - expected), (self.start, past_b, (want - prob)[:, 0].sum(0))):
                    g = g / len(part)
                    past += g * g
                    value += (rate * g / np.sqrt(past)).astype(value.dtype)
        return self


def train(sample: list[tuple[str, str]]) -> Crf:
    """A model from (text, label) rows; its lexicon is the words of most texts, ties in order of the alphabet."""
    seen = Counter(w for text, _ in sample for w in set(words_of(text)))
    top = sorted(seen, key=lambda w: (-seen[w], w))[:LEXICON]
    return Crf(sorted({label for _, label in sample}), {w: i for i, w in enumerate(top)}).fit(sample)


def training_sample(docs: DataFrame, text: str, label: str, key: str) -> list[tuple[str, str]]:
    """At most SAMPLE_ROWS rows of each label, by the least hash of the key, with their whole texts.

    One pass counts the rows of each label, one takes the sample of all labels. Where the texts of a label
    pass SAMPLE_CHARS together, rows that no longer fit stay out; no text is cut. The label set is small by
    nature and checked.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(key).cast("string").alias("key"), F.col(text).alias("t"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError("more than 1000 labels: this column doesn't hold languages")
    if not counts:
        return []
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    shares = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, int((1 << 30) * min(1.0, 1.5 * SAMPLE_ROWS / n)) + 1)])
    order = Window.partitionBy("label").orderBy("place", "key", F.xxhash64("t"))
    near = rows.withColumn("place", place).filter(F.col("place") < F.element_at(shares, F.col("label")))
    chosen = near.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= SAMPLE_ROWS)
    fits = chosen.withColumn("size", F.sum(F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("size") <= SAMPLE_CHARS)
    return [(r["t"], r["label"]) for r in sorted(fits.select("t", "label", "i").collect(), key=lambda r: (r["label"], r["i"]))]


def by_size(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, piece) in lists of about PIECE characters; texts are cut at spaces only, where no word is."""
    some, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = text.find(" ", at + PIECE) if len(text) - at > PIECE else -1
            end = len(text) if end < 0 else end
            some.append((i, text[at:end]))
            size += end - at
            at = max(end, 1)
            if size >= PIECE:
                yield some
                some, size = [], 0
    if some:
        yield some


class Labeller:
    """Applies a model to batches of texts; keeps the scores of frequent words."""

    def __init__(self, model: Crf) -> None:
        self.model = model
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, len(model.labels)), np.float32)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        at = len(self.rows)
        scores = np.concatenate([self.model.scores([w.decode("utf-8", "replace") for w in new[a : a + 20_000]]) for a in range(0, len(new), 20_000)])
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:at], np.zeros((at + 2 * len(new), self.table.shape[1]), np.float32)])
        self.table[at : at + len(new)] = scores
        self.rows.update(zip(new, range(at, at + len(new)), strict=True))

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the expected share of letters by label, and its number of words."""
        if len(self.rows) > CACHE_WORDS:
            self.rows.clear()
        held, lengths, counts = array("i"), array("i"), np.zeros(len(texts), np.int64)
        for some in by_size(texts):  # of a long text a piece at a time
            words = [split(piece) for _, piece in some]
            self.learn(set().union(*words))
            for (i, _), found in zip(some, words, strict=True):
                held.extend(map(self.rows.__getitem__, found))
                lengths.extend(map(len, found))
                counts[i] += len(found)
        k, total = len(self.model.labels), int(counts.sum())
        if not total:
            return np.zeros((len(texts), k)), counts
        ids, sizes = np.frombuffer(held, np.int32), np.frombuffer(lengths, np.int32)
        chains = -(-counts // CHAIN)
        n, doc = int(chains.sum()), np.repeat(np.arange(len(texts)), chains)
        within = np.arange(n) - np.repeat(np.cumsum(chains) - chains, chains)
        begin = np.repeat(np.cumsum(counts) - counts, chains) + within * CHAIN
        length = np.minimum(CHAIN, np.repeat(np.cumsum(counts), chains) - begin)
        first, last = within == 0, within == chains[doc] - 1

        def words_at(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.minimum(begin[part][:, None] + np.arange(CHAIN), total - 1), np.arange(CHAIN) < length[part][:, None]

        def block(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, live = words_at(part)
            scores = self.table[ids[at]]
            scores[~live] = 0
            return np.exp(scores - scores.max(2, keepdims=True)).astype(float), live

        before, beyond = self.model.carried(block, n, first, last)
        out, most = np.zeros((len(texts), k)), max(1, SCORES // (CHAIN * k))
        for a in range(0, n, most):
            part = np.arange(a, min(n, a + most))
            at, live = words_at(part)
            scores = self.table[ids[at]]
            scores[~live] = 0
            prob = self.model.marginals(scores, live, before=before[part], beyond=beyond[part])[live]
            of, weight = np.broadcast_to(doc[part][:, None], live.shape)[live], sizes[at[live]]
            for i in range(k):
                out[:, i] += np.bincount(of, prob[:, i] * weight, len(texts))
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300), counts


def identify(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each row, without a shuffle; the model (a few MB) is broadcast.

    ``lang_pred`` is ``und`` with score 0 if the text is null, empty or has no letter, or if the model
    knows no label; ties go to the label that is first in the alphabet. Every word of a text counts, and
    a text is one chain, however long. Repeated rows are labelled each; columns of these
    names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        labels = held.value.labels
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in chunks(blobs(column)[1]):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                if not labels:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                shares, counts = labeller.shares(texts)
                best = shares.argmax(1)
                for i, t in enumerate(texts):
                    known = counts[i] > 0 and LETTER.search(t) is not None
                    names.append(labels[best[i]] if known else UNKNOWN)
                    scores.append(float(min(1.0, shares[i, best[i]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return arrow_map(docs, run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def model_of(docs: DataFrame) -> Crf:
    """The model that the query and the pipeline use: learned from documents that aren't held out."""
    model = train(training_sample(docs.select("doc_id", "text", "lang").filter(~held_out()), "text", "lang", "doc_id"))
    give_back()
    return model


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), model_of(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
