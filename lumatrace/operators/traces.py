"""Cell traces: long tables (session_id, cell_id, frame_idx, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import midpoint_percentile, percentiles_by
from lumatrace.operators.frames import beside, values

CELL = ["session_id", "cell_id"]


def project_footprints(frames: DataFrame, footprints: DataFrame) -> DataFrame:
    """Full-length traces: the sum of pixel times weight over a cell's footprint.

    A session's sparse footprints are one row, held beside its frames (``frames.beside``): the product is a sum
    over the footprints' pixels only, and frames are neither shuffled nor exploded. Points outside the frame or on
    a null pixel don't count; a cell without others has no value in that frame. Frames without pixels give none.
    """
    point = F.struct("cell_id", "y", "x", F.col("weight").cast("double").alias("weight"))
    points = footprints.filter("cell_id IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL AND weight IS NOT NULL")
    small = points.groupBy("session_id").agg(F.array_sort(F.collect_list(point)).alias("p")).select("session_id", *[F.col(f"p.{n}").alias(n) for n in ("cell_id", "y", "x", "weight")])
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((frames, "session_id"), (footprints, "cell_id"))}

    def run(batch: pa.RecordBatch, of: dict) -> list[pa.Array]:
        rows, cells, sums = [], [], []
        for i, (w, px) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
            if not px.is_valid or not w:
                continue
            at = (of["y"] - 1) * w + of["x"] - 1
            there = (of["x"] >= 1) & (of["x"] <= w) & (at >= 0) & (at < len(px.values))
            if px.values.null_count:
                there[there] = px.values.is_valid().to_numpy(zero_copy_only=False)[at[there]]
            cell, value = of["cell_id"][there], values(px)[at[there]] * of["weight"][there]
            begin = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)) if len(cell) else np.zeros(0, int)
            rows.append(np.full(len(begin), i))
            cells.append(cell[begin])
            sums.append(np.add.reduceat(value, begin) if len(begin) else value)
        if not rows:
            return [batch.column(0).slice(0, 0), pa.array(np.zeros(0, of["cell_id"].dtype)), batch.column(1).slice(0, 0), pa.array([], pa.float64())]
        at = pa.array(np.concatenate(rows))
        return [batch.column(0).take(at), pa.array(np.concatenate(cells)), batch.column(1).take(at), pa.array(np.concatenate(sums))]

    typed = frames.select("session_id", F.col("frame_idx").cast("int"), F.col("w").cast("int"), "pixels")
    return beside(typed, small, 32 * F.size("x"), run, f"session_id {kinds['session_id']}, cell_id {kinds['cell_id']}, frame_idx int, value double")


def delta_f(traces: DataFrame) -> DataFrame:
    """(value - mean) / max(|mean|, 1), the mean over all frames of the cell."""
    base = F.avg("value").over(Window.partitionBy(*CELL))
    return traces.withColumn("f0", base).withColumn("dff", (F.col("value") - F.col("f0")) / F.greatest(F.abs("f0"), F.lit(1.0))).drop("f0", "value")


def peak_ranking(dff: DataFrame, most: int = 50) -> DataFrame:
    """Cells of a session by peak, highest first, ties to the lower cell; NaN never counts as peak."""
    peaks = dff.groupBy(*CELL).agg(F.max(F.when(~F.isnan("dff"), F.col("dff"))).alias("peak"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("peak"), "cell_id"))
    return peaks.withColumn("place", place).filter(F.col("place") <= most)


def top_traces(dff: DataFrame, most: int = 30) -> DataFrame:
    """The traces of the ``most`` highest-peaking cells."""
    return dff.join(peak_ranking(dff, most).select(*CELL), CELL, "left_semi")


def z_trace(traces: DataFrame, value: str = "value") -> DataFrame:
    """(value - mean) / max(standard deviation, 1e-10) per cell."""
    w = Window.partitionBy(*CELL)
    spread = F.greatest(F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(1e-10))
    return traces.withColumn("z", (F.col(value) - F.avg(value).over(w)) / spread)


def time_axis(traces: DataFrame, rate: float | None) -> DataFrame:
    """Seconds from the first frame; the frame number without a positive rate."""
    at = (F.col("frame_idx") - 1) / F.lit(float(rate)) if rate and rate > 0 else F.col("frame_idx").cast("double")
    return traces.withColumn("sec", at)


def stacked(dff: DataFrame, floor: bool = True) -> DataFrame:
    """Traces offset by 1.2 spans a cell, the span being p99 - p1 of all values of the session.

    ``floor``: a span below 1 becomes 1; else only one that isn't positive does.
    """
    spans = percentiles_by(dff, ["session_id"], "dff", {"lo": 1, "hi": 99}).select("session_id", (F.col("hi") - F.col("lo")).alias("span"))
    span = F.greatest("span", F.lit(1.0)) if floor else F.when(F.col("span") <= 0, 1.0).otherwise(F.col("span"))
    order = dff.select(*CELL).distinct().withColumn("i", F.row_number().over(Window.partitionBy("session_id").orderBy("cell_id")))
    placed = dff.join(order, CELL).join(spans.withColumn("span", span), "session_id")
    return placed.select(*CELL, "frame_idx", (F.col("dff") + (F.col("i") - 1) * 1.2 * F.col("span")).alias("y"))


def heatmap(dff: DataFrame) -> DataFrame:
    """One row a cell: its values in order of frames."""
    cells = dff.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "dff"))).alias("s"))
    return cells.select(*CELL, F.transform("s", lambda e: e["dff"]).alias("row"))


def clip_normalise(clip: DataFrame) -> DataFrame:
    """Per cell of a clip (x - p5) / (p99 - p5) where p99 > p5, else x; then clamped to 0...1."""
    limits = clip.groupBy(*CELL).agg(F.sort_array(F.collect_list("dff")).alias("s")).select(*CELL, midpoint_percentile(F.col("s"), 5).alias("lo"), midpoint_percentile(F.col("s"), 99).alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), (F.col("dff") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("dff"))
    return clip.join(limits, CELL).select(*CELL, "frame_idx", F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)).alias("norm"))


def population(dff: DataFrame) -> DataFrame:
    """Mean over cells of each frame."""
    return dff.groupBy("session_id", "frame_idx").agg(F.avg("dff").alias("mean_dff"))


def pick_source(all_traces: DataFrame, curated: DataFrame, source: str) -> DataFrame:
    """``extract``: all cells; ``signal_sorter``: the curated ones."""
    if source not in ("extract", "signal_sorter"):
        raise ValueError(f"unknown trace source: {source}")
    return all_traces if source == "extract" else curated
