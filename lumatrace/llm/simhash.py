"""SimHash near-duplicates by a self-join of a binary trie.

The trie over fingerprints is walked with pairs of its nodes: both step down together, the differing
bits add up, and a pair is dropped as soon as they exceed the budget. For Spark the trie is taken in
four rotations: with a budget of 3, two linked fingerprints agree on one of four 16-bit blocks, so a
rotation that has this block on top leaves no error for the top path, and each top path is a subtrie
of its own. Subtries that hold too many fingerprints are split in the same way on the bits below.

Near copies by five-word similarity need a wider budget: ``Similar`` searches by fingerprints of word
pairs, of which any two of nine blocks make a path, and links what also agrees in fingerprints of five
words. There only what is linked through others counts, so the walk leaves out what is linked already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WRITTEN, arrow_map, blobs, chunks, discard, materialize, read, text_key
from .graph import components

SEED = 42
SHINGLE = 3
BUDGET = 3
#: Fingerprints in a subtrie from which it is split by the bits below.
SUBTRIE = 512
#: Rows of two longs that may be broadcast: 16 MB of values.
BROADCAST_ROWS = 1_000_000
#: Node pairs that a walk holds at a time.
FRONTIER = 1 << 19
#: Pairs of fingerprints that leaves hold, below which they are compared at once; comparisons held at a time.
LEAF, COMPARED = 1024, 1 << 20
#: Fingerprints of one path in a task; larger ones are dealt as pairs of parts of half the size.
PATH_ROWS = 1 << 16
#: Bytes of shingles of a proposed group, and ROW_BYTES for each text, up to which one task counts it; larger ones are dealt as pairs of parts of half of it.
GROUP_BYTES, ROW_BYTES = 1 << 20, 512
#: Bytes of shingles that a text may have to be held against a whole group: it is broadcast.
LEADER_BYTES = 1 << 16
#: Odd factors of the polynomial of a shingle and of its mixing.
FACTOR, MIXER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: bit b is set if over half of its shingles' XXH64 values have it; 0 without words."""
    counts, hashes = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))) if len(words) >= size else [b" ".join(words)] * bool(words)
        counts.append(len(shingles))
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = bits_set(np.concatenate(hashes), counts[some]) * 2 > counts[some, None]
        out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def hashed_shingles(texts: list[bytes], sizes: list[int]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The numbers of the texts with words, and for each size the hashes of their shingles and how many each has.

    A shingle's hash is a polynomial of its words' XXH64 values, mixed; a text of fewer words is one shingle.
    """
    words = [t.translate(LOWER).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    some = np.flatnonzero(counts)
    if not len(some):
        return some, [(np.zeros(0, np.uint64), counts[some]) for _ in sizes]
    each = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words), repeat(SEED)), np.uint64, int(counts.sum()))
    counts = counts[some]
    begin = np.cumsum(counts) - counts
    left = np.repeat(begin + counts, counts) - np.arange(len(each))  # words from here to the text's end
    first = left == np.repeat(counts, counts)
    found = []
    for size in sizes:
        hashes = np.zeros(len(each), np.uint64)
        for j in range(size):
            there = left > j
            hashes[there] = hashes[there] * np.uint64(FACTOR) + each[np.flatnonzero(there) + j]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(MIXER)
        hashes ^= hashes >> np.uint64(29)
        found.append((hashes[(left >= size) | first], np.maximum(counts - size + 1, 1)))
    return some, found


def word_fingerprints(texts: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """SimHashes over shingles of several sizes, whose hashes are made of the words' own; for ``Similar``."""
    some, found = hashed_shingles(texts, sizes)
    outs = [np.zeros(len(texts), np.uint64) for _ in sizes]
    for out, (hashes, shingles) in zip(outs, found, strict=True):
        if len(some):
            bits = bits_set(hashes, shingles) * 2 > shingles[:, None]
            out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return outs


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The different hashes of each text's shingles, ascending; none without words."""
    some, [(hashes, counts)] = hashed_shingles(texts, [size])
    sets = [np.zeros(0, np.uint64)] * len(texts)
    for i, own in zip(some.tolist(), np.split(hashes, np.cumsum(counts)[:-1]) if len(some) else [], strict=True):
        sets[i] = np.unique(own)
    return sets


#: For each byte its bits as eight counters of eight bits.
LANES = np.array([sum(1 << 8 * b for b in range(8) if byte >> b & 1) for byte in range(256)], np.uint64)


def bits_set(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each of successive runs of ``counts`` hashes; all counts are positive.

    Eight bits are counted in one addition, in pieces of 255 hashes, as many as a counter of eight bits holds.
    """
    pieces = -(-counts // 255)
    first = np.cumsum(pieces) - pieces
    at = 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) + np.repeat(np.cumsum(counts) - counts, pieces)
    split = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    found = [np.add.reduceat(LANES[split[:, k]], at).astype("<u8").view(np.uint8).reshape(-1, 8) for k in range(8)]
    return np.add.reduceat(np.concatenate(found, axis=1), first, axis=0, dtype=np.int64)


@dataclass(frozen=True)
class Similar:
    """Texts are proposed if their fingerprints of ``shingle`` words differ in ``budget`` bits or fewer and those of ``wide`` words in ``most``.

    With ``share`` they link only if their sets of ``wide``-word shingles have that similarity, see ``verified``; else all proposals link.

    By the angle between sets, a similarity of 0.8 in five-word shingles is 9.7 of 64 bits on average, with a
    deviation of 2.9; word pairs of such texts are 6.2 bits apart.
    """

    shingle: int = 2
    budget: int = 7
    wide: int = 5
    most: int = 12
    agree: int = 2
    subtrie: int = 1024
    levels: int = 2
    share: float = 0.0
    rounds: int = 3


def with_fingerprints(docs: DataFrame, text: str = "text", **sizes: int) -> DataFrame:
    """Add ``fp``, the 64-bit SimHash as a long; null and empty texts have 0. No shuffle.

    ``sizes``: instead, columns of ``word_fingerprints`` by their names, and the words of their shingles.
    """
    fingerprints = partial(word_fingerprints, sizes=list(sizes.values())) if sizes else lambda texts: [fingerprints_of(texts)]
    sizes = sizes or {"fp": SHINGLE}
    docs = docs.drop(*sizes)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in sizes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = blobs(batch.column(batch.schema.get_field_index(text)))
            found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in sizes]
            for lo, hi in chunks(at):
                texts = [data[at[i] : at[i + 1]].tobytes() for i in range(lo, hi)]
                for out, prints in zip(found, fingerprints(texts), strict=True):
                    out.append(prints)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(x).view(np.int64)) for x in found)], [*batch.schema.names, *sizes])

    return arrow_map(docs, run, schema)


def trie_pairs(fps: np.ndarray, starts: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the budget, by group.

    ``fps``: uint64, ascending and distinct within each group; ``starts``: where groups begin.
    A node is a range of ``fps`` that shares its upper bits; a pair of equal nodes stands for itself.
    """
    ends = np.append(starts[1:], len(fps))
    ones = [np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)]) for d in range(64)]
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        depth, a, az, b, bz, err = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(depth, *(x[half:] for x in (a, az, b, bz, err))), (depth, *(x[:half] for x in (a, az, b, bz, err)))]
            continue
        if depth == 64:
            yield a, b
            continue
        c = ones[depth]
        am, bm = az - (c[az] - c[a]), bz - (c[bz] - c[b])
        same = a == b
        other = ~same
        more = err + 1
        parts = [
            (a, am, b, bm, err, same & (am - a > 1) | other & (am > a) & (bm > b)),
            (am, az, bm, bz, err, same & (az - am > 1) | other & (az > am) & (bz > bm)),
            (a, am, bm, bz, more, (am > a) & (bz > bm) & (more <= budget)),
            (am, az, b, bm, more, other & (az > am) & (bm > b) & (more <= budget)),
        ]
        new = [np.concatenate([p[i][p[5]] for p in parts]) for i in range(5)]
        if len(new[0]):
            stack.append((depth + 1, *new))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of n indexes is linked to, through any number of pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``root`` that the links (a, b) connect; afterwards each root is the least index of its tree."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def trie_forest(fps: np.ndarray, wide: np.ndarray, starts: np.ndarray, rule: Similar) -> np.ndarray:
    """For each row the least row that it is linked to through any number of links of ``rule``, by group.

    ``fps`` ascend within each group and may repeat; ``starts``: where groups begin. Neighbours in the trie's
    order are linked first, then what is left of them; the walk over node pairs then drops each pair whose
    leaves are all in one tree, so a group of copies costs little more than its rows.
    """
    n = len(fps)
    root = np.arange(n)
    group = np.zeros(n, np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = np.bitwise_count(fps[a] ^ fps[b]) <= rule.budget
        near[near] = np.bitwise_count(wide[a[near]] ^ wide[b[near]]) <= rule.most
        return near

    left = np.arange(n)
    for _ in range(12):
        a, b = left[:-1], left[1:]
        near = (group[a] == group[b]) & fit(a, b)
        if not near.any():
            break
        united(root, a[near], b[near])
        left = np.flatnonzero(root == np.arange(n))
    ends = np.append(starts[1:], n)
    ones = [np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int32)]) for d in range(64)]
    turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        depth, a, az, b, bz, err = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(depth, *(x[half:] for x in (a, az, b, bz, err))), (depth, *(x[:half] for x in (a, az, b, bz, err)))]
            continue
        apart = (root[a] != root[b]) | (turns[az - 1] != turns[a]) | (turns[bz - 1] != turns[b])
        few = ((az - a) * (bz - b) <= LEAF) | (depth == 64)
        for i, j in leaf_pairs(*(x[apart & few] for x in (a, az, b, bz))):
            i, j = (x[root[i] != root[j]] for x in (i, j))
            near = fit(i, j)
            if near.any():
                united(root, i[near], j[near])
                turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        a, az, b, bz, err = (x[apart & ~few] for x in (a, az, b, bz, err))
        if not len(a):
            continue
        c = ones[depth]
        am, bm = az - (c[az] - c[a]), bz - (c[bz] - c[b])
        same, more = a == b, err + 1
        parts = [
            (a, am, b, bm, err, (am > a) & (bm > b)),
            (am, az, bm, bz, err, (az > am) & (bz > bm)),
            (a, am, bm, bz, more, (am > a) & (bz > bm) & (more <= rule.budget)),
            (am, az, b, bm, more, ~same & (az > am) & (bm > b) & (more <= rule.budget)),
        ]
        stack.append((depth + 1, *(np.concatenate([p[i][p[5]] for p in parts]) for i in range(5))))
    return root


def leaf_pairs(a: np.ndarray, az: np.ndarray, b: np.ndarray, bz: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows from ranges [a, az) and [b, bz), about COMPARED at a time; of equal ranges each pair once."""
    wide = bz - b
    size = (az - a) * wide
    while len(big := np.flatnonzero(size > COMPARED)):  # many equal fingerprints: cut the range into rows
        k = big[0]
        for i in range(int(a[k]), int(az[k])):
            for lo in range(int(b[k]), int(bz[k]), COMPARED):
                j = np.arange(lo, min(lo + COMPARED, int(bz[k])))
                yield np.full(len(j), i), j
        a, az, b, bz, wide, size = (np.delete(x, k) for x in (a, az, b, bz, wide, size))
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
        pair = np.repeat(np.arange(at, to), size[at:to])
        off = np.arange(len(pair)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to])
        i, j = a[pair] + off // wide[pair], b[pair] + off % wide[pair]
        once = (a[pair] != b[pair]) | (i < j)
        yield i[once], j[once]
        at = to


def subtrie_links(rows: DataFrame, budget: int) -> DataFrame:
    """Edges (u, v) that span the links within each ``path``; v is the least fingerprint of its links there."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("path", "fp").repartition(parts, "path").sortWithinPartitions("path")

    def links(path: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        unsigned = fp.view(np.uint64)
        order = np.lexsort((unsigned, path))
        path, unsigned = path[order], unsigned[order]
        keep = np.concatenate([[True], (path[1:] != path[:-1]) | (unsigned[1:] != unsigned[:-1])])
        path, unsigned = path[keep], unsigned[keep]
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        some = np.diff(np.append(starts, len(path))) > 1
        keep = np.repeat(some, np.diff(np.append(starts, len(path))))
        path, unsigned = path[keep], unsigned[keep]
        if not len(path):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["u", "v"])
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        root = forest(len(path), trie_pairs(unsigned, starts, budget))
        linked = np.flatnonzero(root != np.arange(len(path)))
        signed = unsigned.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[root[linked]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            path = np.concatenate([path, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(path) > 1 << 16:
                cut = int(np.searchsorted(path, path[-1]))  # the last group may go on
                if cut:
                    yield links(path[:cut], fp[:cut])
                    path, fp = path[cut:], fp[cut:]
        if len(path):
            yield links(path, fp)

    return arrow_map(rows, run, "u long, v long")


def descend(rows: DataFrame, bits: int, budget: int, agree: int = 1) -> tuple[DataFrame, int]:
    """The next top paths of rows with fp, path and rest: any ``agree`` of ``budget + agree`` blocks of rest's low bits."""
    blocks = budget + agree
    n = bits // blocks
    at = [(k * n, n if k < blocks - 1 else bits - k * n) for k in range(blocks)]
    value = lambda k: F.shiftrightunsigned("rest", at[k][0]).bitwiseAND((1 << at[k][1]) - 1)
    parts = []
    for chosen in combinations(range(blocks), agree):
        rest, size = F.lit(0).cast("long"), 0
        for k in range(blocks):
            if k not in chosen:
                rest, size = rest.bitwiseOR(F.shiftleft(value(k), size)), size + at[k][1]
        parts.append(F.struct(F.xxhash64("path", *[F.lit(k) for k in chosen], *map(value, chosen)).alias("path"), rest.alias("rest")))
    kept = [c for c in rows.columns if c not in ("path", "rest")]
    return rows.select(*kept, F.explode(F.array(*parts)).alias("x")).select(*kept, "x.path", "x.rest"), bits - agree * n


def linked_fingerprints(fps: DataFrame, budget: int = BUDGET, most: int = SUBTRIE) -> DataFrame:
    """Edges (u, v) between distinct values of ``fp`` whose closure is that of all links within the budget."""
    rows, bits = descend(fps.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest")), 64, budget)
    done = None
    while bits >= 16:
        large = materialize(rows.groupBy("path").count().filter(F.col("count") > most).select("path"))
        if large.isEmpty():
            break
        small = rows.join(large, "path", "left_anti")
        done = small if done is None else done.union(small)
        rows, bits = descend(materialize(rows.join(large, "path", "left_semi").select("fp", "path", "rest")), bits, budget)
    return subtrie_links(rows if done is None else done.union(rows), budget)


def in_parts(rows: DataFrame, most: int, weight: Column | None = None, by: tuple[str, ...] = ("fp", "wide")) -> DataFrame:
    """Deal the rows of paths that weigh over ``most`` (by count, if not given) as pairs of parts with half as much, so that each pair of rows still meets."""
    total = F.sum(F.lit(1) if weight is None else weight)
    large = materialize(rows.groupBy("path").agg(total.alias("n")).filter(F.col("n") > most).select("path", F.ceil(F.col("n") * 2 / most).cast("int").alias("of")))
    if large.isEmpty():
        return rows
    kept = rows.columns
    dealt = rows.join(F.broadcast(large), "path", "left")
    own = F.pmod(F.xxhash64(*by), F.col("of")).cast("int")
    other = F.explode(F.when(F.col("of").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.withColumn("own", own).withColumn("other", other).filter("other IS NULL OR other <> own OR of = 1")
    path = F.when(F.col("other").isNull(), F.col("path")).otherwise(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.withColumn("path", path).select(kept)


def similar_links(prints: DataFrame, rule: Similar) -> DataFrame:
    """Edges (u, v) between nodes of distinct (fp, wide) whose closure is that of all links of ``rule``.

    Paths with over ``rule.subtrie`` fingerprints are split by the bits below, up to ``rule.levels`` times:
    copies stay together however deep one goes, so beyond that a path goes to one task, or in parts to several.
    """
    own = prints.select("fp", "wide", F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest"))
    rows, bits = descend(own, 64, rule.budget, rule.agree)
    done = None
    for _ in range(rule.levels - 1):
        large = materialize(rows.groupBy("path").count().filter(F.col("count") > rule.subtrie).select("path"))
        if large.isEmpty():
            break
        small = rows.join(large, "path", "left_anti").select("path", "fp", "wide")
        done = small if done is None else done.union(small)
        rows, bits = descend(rows.join(large, "path", "left_semi"), bits, rule.budget)
    rows = rows.select("path", "fp", "wide")
    rows = in_parts(rows if done is None else done.union(rows), PATH_ROWS)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "path").sortWithinPartitions("path")
    names = ["u_fp", "u_wide", "v_fp", "v_wide"]

    def links(path: np.ndarray, fp: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((wide, fp, path))
        path, fp, wide = path[order], fp[order], wide[order]
        new = np.concatenate([[True], path[1:] != path[:-1]])
        keep = new | np.concatenate([[True], (fp[1:] != fp[:-1]) | (wide[1:] != wide[:-1])])
        path, fp, wide = path[keep], fp[keep], wide[keep]
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        sizes = np.diff(np.append(starts, len(path)))
        some = np.repeat(sizes > 1, sizes)
        path, fp, wide = path[some], fp[some], wide[some]
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, np.int64)
        root = trie_forest(fp, wide, starts, rule) if len(path) else np.zeros(0, np.int64)
        linked = np.flatnonzero(root != np.arange(len(root)))
        found = (fp[linked], wide[linked], fp[root[linked]], wide[root[linked]])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for batch in batches:
            for x, column, kind in zip(held, batch.columns, (np.int64, np.uint64, np.uint64), strict=True):
                x.append(column.to_numpy(zero_copy_only=False).view(kind))
            size += len(batch)
            if size > PATH_ROWS:
                path, fp, wide = map(np.concatenate, held)
                cut = int(np.searchsorted(path, path[-1]))  # the last group may go on
                held, size = [[path[cut:]], [fp[cut:]], [wide[cut:]]], len(path) - cut
                if cut:
                    yield links(path[:cut], fp[:cut], wide[:cut])
        if size:
            yield links(*map(np.concatenate, held))

    found = arrow_map(rows, run, ", ".join(f"{c} long" for c in names))
    return found.select(F.xxhash64("u_fp", "u_wide").alias("u"), F.xxhash64("v_fp", "v_wide").alias("v"))


def shingled(docs: DataFrame, wanted: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(group, node, key, set) of ``wanted`` (group, node, key, tk): the shingles of one text for each node, as bytes."""
    few = wanted.count() <= BROADCAST_ROWS // 2
    named = wanted.select(F.col("group").alias("__group"), F.col("node").alias("__node"), F.col("key").alias("__key"), F.col("tk").alias("__own"))
    on = docs[key].eqNullSafe(F.col("__key")) & (F.col("__tk") == F.col("__own"))
    rows = docs.withColumn("__tk", text_key(text)).join(F.broadcast(named) if few else named, on).select(F.col("__group").alias("group"), F.col("__node").alias("node"), F.col("__key").alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat have one node
        for batch in batches:
            nodes = batch.column(1).to_pylist()
            new = [i for i, node in enumerate(nodes) if not (node in seen or seen.add(node))]
            batch = batch.take(pa.array(new, pa.int64()))
            data, at = blobs(batch.column(3))
            for lo, hi in chunks(at):
                sets = shingle_sets([data[at[i] : at[i + 1]].tobytes() for i in range(lo, hi)], size)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), pa.array([x.tobytes() for x in sets], pa.binary())], ["group", "node", "key", "set"])

    return arrow_map(rows, run, f"group long, node long, key {kind}, set binary").dropDuplicates(["node"])


def compared(pairs: DataFrame, share: float) -> DataFrame:
    """Add to pairs of shingle sets ``a`` and ``set`` whether they are ``near`` (similarity ``share`` or more) and how far ``apart``, from 0 to 1; ``a`` goes."""
    schema = T.StructType([*(f for f in pairs.schema.fields if f.name != "a"), T.StructField("near", T.BooleanType()), T.StructField("apart", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of = (batch.schema.get_field_index(c) for c in ("a", "set"))
            near, apart = [], []
            for x, y in zip(batch.column(at), batch.column(of), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                near.append(both >= share * (len(a) + len(b) - both))
                apart.append(1 - both / (len(a) + len(b) - both))
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(near, pa.bool_()), pa.array(apart, pa.float64())], schema.names)

    return arrow_map(pairs, run, schema)


def set_forest(sets: list[np.ndarray], root: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Pairs of sets, none empty, of similarity ``share`` or more that connect all trees of ``root`` that such pairs connect.

    A set is held against all that are at least its size and at most as large as the share allows, at once, by
    a mark on its values; sets of which all are in its tree already are left out.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    values = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True)[1]
    marked = np.zeros(len(values), bool)
    found: list[tuple[int, int]] = []
    reach = np.searchsorted(share * sizes, sizes, "right")
    for i in range(len(sets) - 1):
        lo, hi = i + 1, int(reach[i])
        others = np.arange(lo, hi)[root[order[lo:hi]] != root[order[i]]]
        if not len(others):
            continue
        own = values[at[i] : at[i + 1]]
        marked[own] = True
        if 2 * len(others) > hi - lo:
            both = np.add.reduceat(marked[values[at[lo] : at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)[others - lo]
        else:
            begin = np.cumsum(sizes[others]) - sizes[others]
            both = np.add.reduceat(marked[values[np.repeat(at[others] - begin, sizes[others]) + np.arange(int(sizes[others].sum()))]], begin, dtype=np.int64)
        marked[own] = False
        near = order[others[both >= share * (sizes[i] + sizes[others] - both)]]
        if len(near):
            near = near[np.unique(root[near], return_index=True)[1]]
            found += zip(repeat(int(order[i])), near.tolist(), strict=False)
            united(root, np.full(len(near), order[i]), near)
    return found


def set_links(rows: DataFrame, share: float) -> DataFrame:
    """Links (u, v) of similarity ``share`` or more that connect all that such links connect within each path of (path, node, star, set); rows of one ``star`` are connected already."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("path", "node", "star", "set").repartition(parts, "path").sortWithinPartitions("path")

    def links(held: list[tuple]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        first: dict[int, int] = {}
        root = np.array([i if star is None else first.setdefault(star, i) for i, (_, star, _) in enumerate(held)])
        return [(held[i][0], held[j][0]) for i, j in set_forest([np.frombuffer(x, np.uint64) for _, _, x in held], root, share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, []
        for batch in batches:
            found = []
            for at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != path:
                    found += links(held)
                    path, held = at, []
                held.append(row)
            yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in found], pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in links(held)], pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return arrow_map(rows, run, "u long, v long")


def verified(docs: DataFrame, distinct: DataFrame, groups: DataFrame, text: str, key: str, rule: Similar) -> DataFrame:
    """Links (u, v) between the nodes of each proposed group that connect all that texts of similarity ``rule.share`` connect, counted on their shingles.

    A group of up to GROUP_BYTES goes to one task. Larger ones first have up to ``rule.rounds`` rounds: a text is
    held against its whole group, and those near it that can't be near any other go, by the triangle
    inequality, which the distance of sets obeys. What stays is dealt as pairs of parts, so that each pair of texts
    that is not known to be connected, or to be too far apart, is counted.
    """
    first = len(WRITTEN)
    wanted = materialize(groups.join(distinct.select("node", "one.*"), "node").select(F.col("root").alias("group"), "node", "key", "tk"))
    sets = shingled(docs, wanted, text, key, rule.wide).filter(F.length("set") > 0)
    left, settled, edges = materialize(sets.withColumn("star", F.lit(None).cast("long"))), None, None
    weight = F.length("set") + ROW_BYTES
    for _ in range(rule.rounds):
        least = F.min(F.when(F.col("star").isNull() & (F.length("set") <= LEADER_BYTES), F.struct("key", "node"))).alias("least")
        heavy = left.groupBy("group").agg(F.sum(weight).alias("n"), least).filter((F.col("n") > GROUP_BYTES) & F.col("least").isNotNull())
        heavy = materialize(heavy.select("group", F.col("least.node").alias("u")))
        if heavy.isEmpty():
            break
        light = left.join(F.broadcast(heavy.select("group")), "group", "left_anti")
        settled = light if settled is None else settled.union(light)
        lead = left.select(F.col("node").alias("u"), F.col("set").alias("a")).join(F.broadcast(heavy), "u")
        held = materialize(compared(left.join(F.broadcast(lead), "group"), rule.share))
        found = held.filter("near AND node <> u").select("u", F.col("node").alias("v"))
        edges = found if edges is None else edges.union(found)
        gaps = held.filter("NOT near").groupBy("group").agg(F.min("apart").alias("gap"))
        stays = ~F.col("near") | (F.col("apart") + (1 - rule.share) + 1e-9 >= F.col("gap"))
        star = F.when(F.col("near"), F.col("u")).otherwise(F.col("star"))
        left = materialize(held.join(F.broadcast(gaps), "group", "left").filter(stays).withColumn("star", star).select(left.columns))
    rows = in_parts((left if settled is None else settled.union(left)).withColumn("path", F.col("group")), GROUP_BYTES, weight, ("node",))
    linked = set_links(rows, rule.share)
    edges = materialize(linked if edges is None else edges.union(linked))
    discard(docs.sparkSession, WRITTEN[first:-1])
    return edges


def rooted(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``root`` and ``component_id`` to prints (key, tk, node); ``distinct``: (node, least)."""
    roots = components(edges)
    named = materialize(distinct.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = materialize(named.join(least, "root").select(F.col("node").alias("print"), "root", "component_id"))
    return prints.join(by_print, F.col("node") == F.col("print"), "left").drop("print")


def components_of(docs: DataFrame, text: str, key: str, budget: int) -> DataFrame:
    """(key, tk, fp, node, root, component_id) per row; ``tk`` names the text, ``root`` the component by a fingerprint."""
    own = docs.select(F.col(key).alias("key"), text_key(text).alias("tk"), F.col(text).cast("string").alias("body"))
    prints = materialize(with_fingerprints(own, "body").select("key", "tk", "fp"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")))
    return rooted(prints.withColumn("node", F.col("fp")), distinct.select(F.col("fp").alias("node"), "least"), linked_fingerprints(distinct, budget))


def similar_components(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Similar = Similar()) -> DataFrame:  # noqa: B008
    """(key, tk, node, root, component_id) per row, for links of ``rule``; otherwise as ``components_of``.

    Equal pairs of fingerprints are one node and never compared. With ``rule.share`` each different text is a node, and the groups
    that equal fingerprints and proposed links hold together are ``verified``. Texts of fewer than ``wide`` words are one
    shingle, so they link only if they are equal but for case and white space. Null, empty and wordless
    texts are one component.
    """
    own = docs.select(F.col(key).alias("key"), text_key(text).alias("tk"), F.col(text).cast("string").alias("body"))
    made = with_fingerprints(own, "body", fp=rule.shingle, wide=rule.wide)
    prints = materialize(made.select("key", "tk", "fp", "wide", F.xxhash64("fp", "wide").alias("node")))
    fps = F.min("fp").alias("fp"), F.min("wide").alias("wide")
    if not rule.share:
        distinct = materialize(prints.groupBy("node").agg(*fps, F.min("key").alias("least")))
        return rooted(prints.select("key", "tk", "node"), distinct.select("node", "least"), similar_links(distinct, rule))
    wordless = (F.col("fp") == 0) & (F.col("wide") == 0)
    prints = prints.withColumnRenamed("node", "print").withColumn("node", F.when(wordless, F.col("print")).otherwise(F.col("tk")))
    texts = materialize(prints.groupBy("node").agg(F.min("print").alias("print"), *fps, F.min("key").alias("least"), F.min(F.struct("key", "tk")).alias("one")))
    distinct = materialize(texts.groupBy("print").agg(*fps, F.count(F.lit(1)).alias("n")))
    roots = components(similar_links(distinct, rule)).withColumnRenamed("node", "print")
    several = distinct.join(roots, "print", "left").filter("root IS NOT NULL OR n > 1").select("print", F.coalesce("root", "print").alias("root"))
    edges = verified(docs, texts, texts.select("node", "print").join(several, "print").select("node", "root"), text, key, rule)
    return rooted(prints.select("key", "tk", "node"), texts.select("node", "least"), edges)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """(key, fp, component_id) per row: documents link at ``budget`` or fewer differing bits.

    component_id is the least key of all documents that links lead to, itself included. Rows with
    equal fingerprints are joined by that value alone and never paired; null keys don't count for the
    least one, so a component of null keys has null. Null, empty and wordless texts share fingerprint
    0 and link like any other. Any budget from 0 to 7 is exact. An empty table gives an empty result.
    """
    return components_of(docs, text, key, budget).select(F.col("key").alias(key), "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = BUDGET, rule: Similar | None = None) -> DataFrame:
    """One row of every component, all its columns: that of least key, and of these of least text hash.

    Links are those of ``near_duplicates``, or with ``rule`` those of ``similar_components``.
    What goes is far less than what stays: its keys and text hashes are counted and, up to BROADCAST_ROWS
    of them, broadcast, so that texts aren't shuffled; beyond that the anti join shuffles both sides.
    """
    found = materialize(similar_components(docs, text, key, rule) if rule else components_of(docs, text, key, budget))
    first = F.col("key").eqNullSafe(F.col("component_id"))
    several = materialize(found.filter(first).groupBy(F.col("root").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("tk").alias("chosen")).filter("n > 1"))
    gone = found.filter(~first).select("key", "tk")
    repeats = not several.isEmpty()
    if repeats:
        gone = gone.union(found.filter(first).join(several, F.col("root") == F.col("of")).filter("tk <> chosen").select("key", "tk"))
    gone = materialize(gone.distinct().select(F.col("key").alias("__gone"), F.col("tk").alias("__gone_tk")))
    few = gone.count() <= BROADCAST_ROWS
    on = docs[key].eqNullSafe(F.col("__gone")) & (F.col("__tk") == F.col("__gone_tk"))
    kept = docs.withColumn("__tk", text_key(text)).join(F.broadcast(gone) if few else gone, on, "left_anti")
    return (kept.dropDuplicates([key, "__tk"]) if repeats else kept).select(docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
