"""Movie frames: one row a frame (session_id, frame_idx, h, w, pixels), row-major pixels.

Work within a frame stays in array functions, without a shuffle; only sums over time group anything. They
are added up over whole frames in each task, so that what is shuffled is a frame for each task and session
and not a row for each pixel of each frame. What belongs to a session (its image, its footprints) goes to the
frames and not the frames to it, see ``beside``.

Frames whose ``pixels`` are null take no part in sums over time and templates, and stay null where each frame
gives one; null pixels of a frame count as NaN.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import percentiles_by
from lumatrace.session import written

SHAPE = ["h", "w"]
EPS = 2.0**-52
#: Bytes of sums over time that a task holds, and of sessions' tables that go to all tasks at once.
HELD_BYTES, BESIDE_BYTES = 128 << 20, 64 << 20
#: Pixels of a frame that a template's block scores are summed over in one group.
TILE = 8192


def values(pixels: pa.ListScalar) -> np.ndarray:
    """A frame's pixels as doubles; null ones are NaN."""
    return pixels.values.to_numpy(zero_copy_only=False).astype(float)


def deinterleave(frames: DataFrame) -> DataFrame:
    """Add ``pair`` and ``plane``: odd frames are plane A, even ones B."""
    return frames.withColumns({"pair": F.expr("int((frame_idx + 1) div 2)"), "plane": F.when(F.col("frame_idx") % 2 == 1, "A").otherwise("B")})


def pair_maximum(frames: DataFrame) -> DataFrame:
    """One frame a pair, the larger of both planes in each pixel; an odd last frame goes. One shuffle."""
    pairs = deinterleave(frames).groupBy("session_id", "pair").agg(*[F.any_value(F.when(F.col("plane") == p, F.col("pixels")), True).alias(p) for p in "AB"], *[F.any_value(c).alias(c) for c in SHAPE])
    both = pairs.filter("A IS NOT NULL AND B IS NOT NULL")
    return both.select("session_id", F.col("pair").alias("frame_idx"), *SHAPE, F.zip_with("A", "B", lambda a, b: F.greatest(a, b)).alias("pixels"))


def channel(frames: DataFrame, green: bool = True) -> DataFrame:
    """The odd (green) or even (red) frames, numbered anew."""
    return frames.filter(F.col("frame_idx") % 2 == int(green)).withColumn("frame_idx", F.expr("int((frame_idx + 1) div 2)"))


def bin_mean(frames: DataFrame, k: int = 4, whole: bool = False) -> DataFrame:
    """Means of k successive frames, rounded if ``whole``; an incomplete tail goes."""
    binned = frames.groupBy("session_id", (F.expr(f"int((frame_idx - 1) div {k})") + 1).alias("b")).agg(F.collect_list("pixels").alias("all"), *[F.any_value(c).alias(c) for c in SHAPE])
    at = F.sequence(F.lit(0), F.size(F.get("all", F.lit(0))) - 1)
    mean = F.transform(at, lambda i: F.aggregate("all", F.lit(0.0), lambda s, px: s + F.get(px, i)) / k)
    if whole:
        mean = F.transform(mean, lambda v: F.round(v).cast("int"))
    return binned.filter(F.size("all") == k).select("session_id", F.col("b").alias("frame_idx"), *SHAPE, mean.alias("pixels"))


def time_sums(frames: DataFrame) -> DataFrame:
    """(session_id, w, n, mean, squares, top): over the frames of a session in a task their number and, for each pixel, mean, squared deviations and maximum.

    A task holds the sums of at most HELD_BYTES; where many sessions alternate it gives out several rows of one.
    """
    schema = "session_id string, w int, n long, mean array<double>, squares array<double>, top array<double>"

    def row(session: str, w: int, n: int, *sums: np.ndarray) -> pa.RecordBatch:
        values = [[session], [w], [n], *([x] for x in sums)]
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["session_id", "w", "n", "mean", "squares", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], tuple] = {}
        for batch in batches:
            for session, w, px in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                v = values(px)
                key = (session, w, len(v))
                if key not in held and sum(24 * size for _, _, size in held) > HELD_BYTES:
                    for (of, wide, _), sums in held.items():
                        yield row(of, wide, *sums)
                    held.clear()
                n, mean, squares, top = held.get(key, (0, np.zeros(len(v)), np.zeros(len(v)), np.full(len(v), -np.inf)))
                apart = v - mean
                mean = mean + apart / (n + 1)
                held[key] = n + 1, mean, squares + apart * (v - mean), np.maximum(top, v)
        for (of, wide, _), sums in held.items():
            yield row(of, wide, *sums)

    return frames.filter("pixels IS NOT NULL").select("session_id", "w", "pixels").mapInArrow(run, schema)


def pixel_stats(frames: DataFrame) -> DataFrame:
    """(session_id, w, at, mean, top, std) of each pixel over time; one frame has deviation 0."""
    parts = time_sums(frames).select("session_id", "w", "n", F.posexplode(F.arrays_zip("mean", "squares", "top")).alias("at", "p"))
    own = Window.partitionBy("session_id", "w", "at")
    parts = parts.withColumn("all", F.sum("n").over(own)).withColumn("m", F.sum(F.col("n") * F.col("p.mean")).over(own) / F.col("all"))
    away = F.col("p.mean") - F.col("m")
    std = F.when(F.max("all") > 1, F.sqrt(F.sum(F.col("p.squares") + F.col("n") * away * away) / (F.max("all") - 1))).otherwise(0.0)
    return parts.groupBy("session_id", "w", "at").agg(F.max("m").alias("mean"), F.max("p.top").alias("top"), std.alias("std"))


def projections(frames: DataFrame) -> DataFrame:
    """Mean, maximum and standard deviation over time of each pixel (session_id, y, x)."""
    kind = frames.schema["pixels"].dataType.elementType
    return pixel_stats(frames).select("session_id", F.expr("int(at div w + 1)").alias("y"), F.expr("int(at % w + 1)").alias("x"), "mean", F.col("top").cast(kind).alias("max"), "std")


def images(stats: DataFrame, **columns: Column) -> DataFrame:
    """(session_id, w, ...): for each of ``columns`` of pixel statistics an array of all pixels in row-major order."""
    rows = stats.groupBy("session_id").agg(F.max("w").alias("w"), F.array_sort(F.collect_list(F.struct("at", *[c.alias(n) for n, c in columns.items()]))).alias("rows"))
    return rows.select("session_id", "w", *[F.col(f"rows.{n}").alias(n) for n in columns])


def beside(frames: DataFrame, small: DataFrame, size: Column, run, schema: str, most: int = BESIDE_BYTES) -> DataFrame:
    """``run(row, held)`` for the frames (session_id, ...) of an Arrow batch and session, with that session's row of ``small``.

    ``small`` has one row a session, a frame or footprints large, and goes to all tasks; frames aren't shuffled.
    ``size`` is a row's bytes: what is more than ``most`` in all goes in several blocks of sessions, chosen by a
    hash of ``session_id``. On a table in partitions by session (as ``save_results`` writes it) a block reads its own
    partitions only, so that each frame is read once whatever the number of blocks; on others once a block.
    ``run`` takes a batch of one session and the row as a dict of numpy arrays, and returns a list of columns.
    Frames of sessions that ``small`` lacks go.
    """
    spark = frames.sparkSession
    small = written(small)
    blocks = -(-int(small.agg(F.sum(size)).first()[0] or 0) // most) or 1
    names = [f.split()[0] for f in schema.split(", ")]
    parts = []
    for block in range(blocks):
        here = (lambda df: df) if blocks == 1 else (lambda df, b=block: df.filter(F.pmod(F.xxhash64("session_id"), F.lit(blocks)) == b))
        table = here(small).toArrow().combine_chunks()
        plain = lambda v: np.asarray(v.values) if isinstance(v, pa.ListScalar) else v.as_py()
        held = spark.sparkContext.broadcast({row["session_id"].as_py(): {n: plain(row[n]) for n in table.column_names} for row in ({n: table.column(n)[i] for n in table.column_names} for i in range(len(table)))})

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sessions = batch.column(0).dictionary_encode()
                for code, session in enumerate(sessions.dictionary.to_pylist()):
                    if session in held.value:
                        rows = np.flatnonzero(sessions.indices.to_numpy(zero_copy_only=False) == code)
                        yield pa.RecordBatch.from_arrays(run(batch.take(pa.array(rows)), held.value[session]), names)

        parts.append(here(frames).filter("session_id IS NOT NULL").mapInArrow(work, schema))
    return reduce(DataFrame.union, parts)


def z_score(frames: DataFrame) -> DataFrame:
    """Each pixel less its mean over its deviation in time; a deviation below 1e-6 counts as 1.

    Two passes: the statistics, an image a session, are written once and then held beside the frames, which are
    never shuffled or exploded.
    """
    kind = frames.schema["session_id"].dataType.simpleString()
    stats = images(pixel_stats(frames), mean=F.col("mean"), deviation=F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))

    def run(batch: pa.RecordBatch, image: dict) -> list[pa.Array]:
        out = [None if not px.is_valid else (values(px) - image["mean"]) / image["deviation"] for px in batch.column(4)]
        return [*batch.columns[:4], pa.array(out, pa.list_(pa.float64()))]

    schema = f"session_id {kind}, frame_idx int, h int, w int, pixels array<double>"
    typed = frames.select("session_id", *[F.col(c).cast("int") for c in ("frame_idx", *SHAPE)], "pixels")
    return beside(typed, stats, 16 * F.size("mean"), run, schema)


def kernel(sigma: float) -> list[float]:
    """Gaussian weights for offsets up to ceil(2 sigma), of sum 1."""
    half = math.ceil(2 * sigma)
    raw = [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-half, half + 1)]
    return [v / sum(raw) for v in raw]


def smooth(frames: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing of each frame, along rows and then columns; the edge is repeated outwards; null pixels of a frame leave its neighbourhood NaN.

    A stencil over whole frames: array functions are interpreted pixel by pixel, so frames go to numpy
    in Arrow batches. No shuffle.
    """
    weights = kernel(sigma)
    kinds = [f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("session_id", "frame_idx", *SHAPE)]
    schema = ", ".join([*kinds, "pixels array<double>"])

    def along(image: np.ndarray, axis: int) -> np.ndarray:
        half, n = len(weights) // 2, image.shape[axis]
        wide = np.pad(image, [(half, half) if d == axis else (0, 0) for d in (0, 1)], "edge")
        return sum(w * wide.take(range(k, k + n), axis) for k, w in enumerate(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, px in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                out.append(None if not px.is_valid else along(along(values(px).reshape(h, w), 1), 0).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.float64()))], ["session_id", "frame_idx", *SHAPE, "pixels"])

    return frames.select("session_id", "frame_idx", *SHAPE, "pixels").mapInArrow(run, schema)


def tile_sums(frames: np.ndarray, length: int, most: int) -> dict[str, np.ndarray]:
    """Of ``frames`` (frames x pixels) and the means of the blocks of ``length`` that begin at one of the first ``most``: means and squared deviations over the pixels, and co-deviations of each frame and block mean."""
    starts = min(most, len(frames) - length + 1)
    mean = frames.mean(1)
    apart = frames - mean[:, None]
    runs = np.concatenate([np.zeros((1, apart.shape[1])), np.cumsum(apart, axis=0)])
    blocks = (runs[length : length + starts] - runs[:starts]) / length  # their pixels' mean is 0
    steps = np.concatenate([[0.0], np.cumsum(mean)])
    return {"mean": mean, "squares": (apart * apart).sum(1), "block_mean": (steps[length : length + starts] - steps[:starts]) / length, "block_squares": (blocks * blocks).sum(1), "both": (apart @ blocks.T).ravel()}


def joined_sums(tiles: list[dict[str, np.ndarray]], sizes: list[int]) -> dict[str, np.ndarray]:
    """The same over all pixels of all tiles: deviations add, with those of the tiles' means from their common mean."""
    n = np.array(sizes, float)[:, None]
    every = {k: np.stack([t[k] for t in tiles]) for k in tiles[0]}
    mean, block_mean = ((n * every[k]).sum(0) / n.sum() for k in ("mean", "block_mean"))
    off, block_off = every["mean"] - mean, every["block_mean"] - block_mean
    return {
        "squares": every["squares"].sum(0) + (n * off * off).sum(0),
        "block_squares": every["block_squares"].sum(0) + (n * block_off * block_off).sum(0),
        "both": every["both"].sum(0).reshape(len(mean), -1) + (n * off).T @ block_off,
    }


def block_scores(tiles: list[dict[str, np.ndarray]], sizes: list[int], length: int) -> np.ndarray:
    """The score of each block: the mean over its frames of the correlation of frame and block mean, as ``stable_template`` has it."""
    sums, size = joined_sums(tiles, sizes), sum(sizes)
    with np.errstate(invalid="ignore", divide="ignore"):
        sd = np.sqrt(sums["squares"] / (size - 1))[:, None] * np.sqrt(sums["block_squares"] / (size - 1))[None, :]
        like = sums["both"] / size / (EPS + sd)
    return np.array([like[k : k + length, k].mean() for k in range(like.shape[1])])


def stable_blocks(frames: DataFrame, first: int = 500, last: int = 1500, length: int = 100, most: int = 50) -> DataFrame:
    """(session_id, start, score, from_frame, to_frame): the block of ``length`` frames that is most like its own mean.

    Starts 1 to ``most`` of the frame range are tried. A block's score is the mean over its frames of
    (mean of products - product of means) / (eps + product of sample deviations) of frame and block
    mean; the first start wins ties. Sessions with too short a range give none. Sums and products over pixels add, so
    the frames of a range meet a tile of TILE pixels at a time, and what then meets of a session is a row a tile.
    """
    ranged = frames.filter(F.col("frame_idx").between(first, last) & (F.size("pixels") > 0))
    tile = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"int((size(pixels) - 1) div {TILE})"))), lambda t: F.struct(t.alias("tile"), F.slice("pixels", t * TILE + 1, TILE).alias("part")))
    cut = ranged.select("session_id", "frame_idx", F.explode(tile).alias("t")).select("session_id", "t.tile", "frame_idx", "t.part")
    numbers = ("mean", "squares", "block_mean", "block_squares", "both")
    kind = frames.schema["session_id"].dataType.simpleString()
    sums = f"session_id {kind}, size int, frames array<int>, {', '.join(f'{n} array<double>' for n in numbers)}"

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("frame_idx").to_numpy(), kind="stable")[: length + most - 1]
        found: dict[str, list] = {n: [] for n in ("session_id", "size", "frames", *numbers)}
        if len(order) >= length:
            px = table.column("part").combine_chunks()
            size = len(px[0].values)
            part = np.stack([values(px[int(i)]) for i in order])
            of = {"session_id": table.column("session_id")[0], "size": size, "frames": table.column("frame_idx").to_numpy()[order], **tile_sums(part, length, most)}
            found = {n: [of[n]] for n in found}
        kinds = [table.schema.field("session_id").type, pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * len(numbers)]
        return pa.table([pa.array([v.as_py() if isinstance(v, pa.Scalar) else v for v in found[n]], k) for n, k in zip(found, kinds, strict=True)], names=list(found))

    def score(table: pa.Table) -> pa.Table:
        array = lambda n, i: np.asarray(table.column(n)[i].values)
        tiles = [{n: array(n, i) for n in numbers} for i in range(len(table))]
        scores = block_scores(tiles, table.column("size").to_pylist(), length).round(9)
        best = int(np.argmax(np.where(np.isnan(scores), np.inf, scores)))  # as in Spark's order, NaN is above all
        numbered = array("frames", 0)
        return pa.table({"session_id": table.column("session_id").slice(0, 1), "start": pa.array([best + 1], pa.int32()), "score": [float(scores[best])], "from_frame": pa.array([numbered[best]], pa.int32()), "to_frame": pa.array([numbered[best + length - 1]], pa.int32())})

    added = cut.groupBy("session_id", "tile").applyInArrow(add, sums)
    return added.groupBy("session_id").applyInArrow(score, f"session_id {kind}, start int, score double, from_frame int, to_frame int")


def stable_template(frames: DataFrame, first: int = 500, last: int = 1500, length: int = 100, most: int = 50) -> DataFrame:
    """(session_id, start, score, h, w, pixels): the mean image of the block that ``stable_blocks`` finds.

    A second pass reads the frames of the range again and adds up those of the block in each task.
    """
    best = written(stable_blocks(frames, first, last, length, most))  # a row a session
    inside = frames.filter(F.col("frame_idx").between(first, last)).join(best, "session_id").filter("frame_idx BETWEEN from_frame AND to_frame")
    mean = images(pixel_stats(inside), pixels=F.col("mean"))
    return best.select("session_id", "start", "score").join(mean, "session_id").select("session_id", "start", "score", F.expr("int(size(pixels) div w)").alias("h"), "w", "pixels")


def contrast_limits(frames: DataFrame, most: int = 20) -> DataFrame:
    """p1 and p99.5 of all pixels of up to 20 frames, evenly spread; hi above lo by 1 at least if they met."""
    total = frames.groupBy("session_id").agg(F.max("frame_idx").alias("nf"))
    m = F.least(F.col("nf"), F.lit(most))
    places = F.when(m > 1, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.round(1 + i * (F.col("nf") - 1) / (m - 1)).cast("int"))).otherwise(F.array(F.lit(1)))
    wanted = total.select("session_id", F.explode(places).alias("frame_idx")).distinct()
    values = frames.join(wanted, ["session_id", "frame_idx"], "left_semi").select("session_id", F.explode("pixels").alias("v")).withColumn("v", F.col("v").cast("double"))
    return percentiles_by(values, ["session_id"], "v", {"lo": 1, "hi": 99.5}).withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))


def rescale(frames: DataFrame, limits: DataFrame, most: int | None = None) -> DataFrame:
    """Pixels of the first ``most`` frames as 0...1 between the limits."""
    kept = frames if most is None else frames.filter(F.col("frame_idx") <= most)
    joined = kept.join(limits, "session_id")
    scaled = F.transform("pixels", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.col("lo")) / (F.col("hi") - F.col("lo")))))
    return joined.select("session_id", "frame_idx", *SHAPE, scaled.alias("pixels"))
