"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A token sequence is the exact BPE result if and
only if each adjacent pair is compatible, that is, if merging the bytes of the two tokens gives the
two tokens again. All pairs of a batch of words are checked at once against a sorted table of known
pairs; only words with an incompatible pair go through exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blobs, chunks, read

#: Fixed value: the published split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words in a worker's cache; it is emptied when full, so memory is bounded whatever the input.
CACHE_WORDS = 64_000
#: Widths of the classes in which words are merged together; longer words are merged one by one.
WIDTHS = (8, 16, 32, 64)
#: Words from which on proposals are taken one by one; known pairs from which on their table is begun anew.
FEW, MOST_PAIRS = 8, 1_000_000
#: No merge.
NEVER = np.iinfo(np.int32).max
#: Bytes of text whose words are proposed and verified together.
BATCH_BYTES = 1 << 20
#: Longer words are never cached.
LONG_WORD = 128


def latin_split() -> re.Pattern:
    """SPLIT for texts below U+0250, for the faster standard library engine; classes come from the character database."""
    found = {"L": "", "N": "", "Z": ""}
    for c in map(chr, range(0x250)):
        kind = "Z" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else unicodedata.category(c)[0]
        if kind in found:
            found[kind] += re.escape(c)
    return re.compile(SPLIT.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{found['Z']}{found['L']}{found['N']}]").replace(r"\p{White_Space}", f"[{found['Z']}]").replace(r"\P{White_Space}", f"[^{found['Z']}]").replace(r"\p{L}", f"[{found['L']}]").replace(r"\p{N}", f"[{found['N']}]"))


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in vocabulary files: printable Latin-1 is itself, the rest follows from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file (its JSON text).

    Its arrays are pickled; caches, and the dicts that only long words need, are not.
    """

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        as_byte = byte_alphabet()
        plain = {token: bytes(as_byte[c] for c in token) for token in spec["model"]["vocab"]}
        self.id_of = {plain[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        named = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.base = 1 + max(named)
        self.bytes_of = [named.get(i, b"") for i in range(self.base)]
        self.decimal = list(map(str, range(self.base)))
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (plain[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge.setdefault((self.id_of[a], self.id_of[b]), (rank, self.id_of[a + b]))
        self.reach = [0] * 256  # longest token by first byte
        for b in self.id_of:
            self.reach[b[0]] = max(self.reach[b[0]], len(b))
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.any_split, self.latin_split, self.beyond = regex.compile(SPLIT), latin_split(), re.compile("[^\x00-\u024f]")
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._tables()
        self.forget()

    def _tables(self) -> None:
        """The vocabulary as a trie and the merges as a sorted list of pairs, for whole arrays of words."""
        nodes: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        edges: list[tuple[int, int]] = []
        for token in self.id_of:
            for n in range(2, len(token) + 1):
                if token[:n] not in nodes:
                    edges.append((nodes[token[: n - 1]] << 8 | token[n - 1], len(nodes)))
                    nodes[token[:n]] = len(nodes)
        self.edge, self.child = np.array(sorted(edges), np.int64).reshape(-1, 2).T.copy()
        self.token_at = np.array([self.id_of.get(b, -1) for b in nodes], np.int64)
        pairs = sorted((a * self.base + b, rank) for (a, b), (rank, _) in self.merge.items())
        self.pair, self.pair_rank = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        self.merged = np.zeros(1 + int(self.pair_rank.max(initial=0)), np.int32)
        for rank, new in self.merge.values():
            self.merged[rank] = new
        self.byte_id = np.array(self.byte_ids, np.int32)
        self.byte_rank = self.ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)

    def forget(self) -> None:
        """Empty the caches."""
        self.known = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.as_text: dict[str, str] = {}
        self.as_bytes: dict[str, bytes] = {}
        self.merged_words = self.proposed_words = 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "fits", "as_text", "as_bytes", "id_of", "merge")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    @cached_property
    def id_of(self) -> dict[bytes, int]:
        special = set(self.special.values())
        return {b: i for i, b in enumerate(self.bytes_of) if b and i not in special}

    @cached_property
    def merge(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {(p // self.base, p % self.base): (r, int(self.merged[r])) for p, r in zip(self.pair.tolist(), self.pair_rank.tolist(), strict=True)}

    def split(self, text: str) -> list[str]:
        return (self.any_split if self.beyond.search(text) else self.latin_split).findall(text)

    def exact(self, word: bytes) -> list[int]:
        """Merging in order of rank, leftmost first, by a heap over a linked list, in O(n log n)."""
        ids: list[int] = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [t for t in ids if t >= 0]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each pair of ids, NEVER if there is none; a negative id is no token."""
        if not len(self.pair):
            return np.full(len(a), NEVER, np.int32)
        keys = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.base + b)
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        return np.where(self.pair[at] == keys, self.pair_rank[at], NEVER).astype(np.int32)

    def exact_many(self, words: list[bytes]) -> list[list[int]]:
        """``exact`` for many words: all words of one width class take their best merge at the same time."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            for a in range(0, len(chosen), 1 << 15):
                for i, ids in zip(chosen[a : a + (1 << 15)].tolist(), self._merged([words[i] for i in chosen[a : a + (1 << 15)]], width), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[i] = self.exact(words[i])
        return out

    def _merged(self, words: list[bytes], width: int) -> Iterator[list[int]]:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(width)
        ids = np.where(place < sizes[:, None], self.byte_id[raw], np.int32(-1))
        rank = np.where(place[1:] < sizes[:, None], self.byte_rank[raw[:, :-1], raw[:, 1:]], NEVER)
        rows, done = np.arange(len(words)), np.full((len(words), width), -1, np.int32)
        while rank.shape[1] and len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            over = best == NEVER
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                rows, ids, rank, at, best = (x[~over] for x in (rows, ids, rank, at, best))
            row, left = np.arange(len(rows)), at > 0
            place = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
            ids[row, at] = self.merged[best]
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= at[:, None]), 1)
            rank[row[left], at[left] - 1] = self.ranks(ids[row[left], at[left] - 1], ids[row[left], at[left]])
            right = at < rank.shape[1]
            rank[row[right], at[right]] = self.ranks(ids[row[right], at[right]], ids[row[right], at[right] + 1])
        done[rows, : ids.shape[1]] = ids
        for ids, n in zip(done.tolist(), (done >= 0).sum(1).tolist(), strict=True):
            yield ids[:n]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words, token after token: the ids, word after word, and each word's number of them."""
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        begin = np.concatenate([[0], end[:-1]])
        words_at, found = [], []
        live = np.flatnonzero(begin < end)
        while len(live):
            if len(live) < FEW:  # what is left of a few very long words
                for w in live.tolist():
                    ids = self._propose_one(data[begin[w] : end[w]].tobytes())
                    words_at.append(np.full(len(ids), w))
                    found.append(np.array(ids, np.int64))
                break
            at, stop = begin[live], end[live]
            node = data[at].astype(np.int64)
            token, after = self.token_at[node], at + 1
            who, to = np.arange(len(live)), at + 1
            while len(who := who[inside := to < stop[who]]):
                node, to = node[inside], to[inside]
                key = node << 8 | data[to]
                i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                on = self.edge[i] == key
                who, node, to = who[on], self.child[i[on]], to[on] + 1
                ids = self.token_at[node]
                real = ids >= 0
                token[who[real]], after[who[real]] = ids[real], to[real]
            words_at.append(live)
            found.append(token)
            begin[live] = after
            live = live[after < stop]
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner = np.concatenate(words_at)
        return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _propose_one(self, word: bytes) -> list[int]:
        ids, at, n, get, reach = [], 0, len(word), self.id_of.get, self.reach
        while at < n:
            end = min(n, at + reach[word[at]])
            while (t := get(word[at:end])) is None:
                end -= 1
            ids.append(t)
            at = end
        return ids

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (first id * base + second id) stays two tokens."""
        fresh = np.unique(pairs)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, fresh), len(self.known) - 1)
            fresh = fresh[self.known[at] != fresh]
        if len(fresh):
            both = [[p // self.base, p % self.base] for p in fresh.tolist()]
            exact = self.exact_many([self.bytes_of[a] + self.bytes_of[b] for a, b in both])
            fit = np.fromiter((x == y for x, y in zip(both, exact, strict=True)), bool, len(fresh))
            known, fits = np.concatenate([self.known, fresh]), np.concatenate([self.fits, fit])
            order = np.argsort(known, kind="stable")
            self.known, self.fits = known[order], fits[order]
        return self.fits[np.searchsorted(self.known, pairs)]

    def words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        flat, counts = self.propose(raw)
        ends = np.cumsum(counts)
        listed = flat.tolist()
        ids = [listed[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        if len(flat) > 1:
            inside = np.ones(len(flat) - 1, bool)
            inside[ends[:-1] - 1] = False  # pairs across words
            pairs = np.flatnonzero(inside)
            bad = pairs[~self.compatible(flat[pairs] * self.base + flat[pairs + 1])]
            wrong = np.unique(np.searchsorted(ends, bad, "right")).tolist()
            for w, exact in zip(wrong, self.exact_many([raw[w] for w in wrong]), strict=True):
                ids[w] = exact
            self.merged_words += len(wrong)
        self.proposed_words += len(words)
        return ids

    def learn(self, words: Iterable[str]) -> None:
        """Put words that are not in the cache there."""
        new = [w for w in words if w not in self.as_text]
        decimal, bytes_of = self.decimal.__getitem__, self.bytes_of.__getitem__
        for w, ids in zip(new, self.words(new), strict=True):
            self.as_text[w] = ",".join(map(decimal, ids))
            self.as_bytes[w] = b"".join(map(bytes_of, ids))

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special tokens."""
        if self.cut is None:
            yield text, False
            return
        for i, part in enumerate(self.cut.split(text)):
            if part:
                yield part, i % 2 == 1

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self.pieces(text):
            ids += [self.special[part]] if special else [t for w in self.words(self.split(part)) for t in w]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def both(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text the ids as decimal text, comma-joined, and the bytes that these ids decode to.

        The words that are new in any of the texts are proposed and verified together.
        """
        if len(self.as_text) > CACHE_WORDS:
            self.as_text.clear()
            self.as_bytes.clear()
        if len(self.known) > MOST_PAIRS:
            self.known, self.fits = self.known[:0], self.fits[:0]
        parts = [[(part if special else self.split(part), special) for part, special in self.pieces(t)] for t in texts]
        fresh = set().union(*(words for x in parts for words, special in x if not special))
        self.learn(fresh)
        for x in parts:
            out = ",".join(str(self.special[p]) if special else ",".join(map(self.as_text.__getitem__, p)) for p, special in x)
            back = b"".join(self.bytes_of[self.special[p]] if special else b"".join(map(self.as_bytes.__getitem__, p)) for p, special in x)
            yield out, back
        for w in fresh:
            if len(w) > LONG_WORD:
                del self.as_text[w], self.as_bytes[w]


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file's text; the path is a parameter and defaults to the installed 50k byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenize(docs: DataFrame, text: str = "text", definition: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, ``token_ids`` and ``decoded`` to each row.

    No shuffle. The tables of the vocabulary (of a fixed file; some MB) are broadcast. Null and empty texts have no
    tokens and decode to an empty text. Repeated rows are encoded each. Columns of these names in
    the input are replaced; all others are kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(ByteBpe(definition or vocabulary()))
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "decoded"] * keep_ids
    source = docs.drop(*[c for c in docs.columns if c in made and c != text])
    schema = source.select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"), *[F.array(F.lit(0)).alias("token_ids"), F.lit("").alias("decoded")] * keep_ids).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value  # one for the worker as long as this broadcast lives; its caches are the task's
        for batch in batches:
            n, ids, back, lists, texts = [], [], [], [], []
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in chunks(blobs(column)[1], BATCH_BYTES):
                for out, raw in bpe.both([t or "" for t in column.slice(lo, hi - lo).to_pylist()]):
                    decoded = raw.decode("utf-8", "replace")
                    n.append(out.count(",") + 1 if out else 0)
                    ids.append(hashlib.sha256(out.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        lists.append(np.array(out.split(","), np.int32) if out else np.zeros(0, np.int32))
                        texts.append(decoded)
            arrays = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            arrays += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())] * keep_ids
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *made])
        bpe.forget()

    return arrow_map(source, run, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
