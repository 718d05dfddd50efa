"""Cells: footprints (session_id, cell_id, y, x, weight), their geometry, curation and quality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import midpoint_percentile

CELL = ["session_id", "cell_id"]
MORPH_LEVEL, CONTOUR_LEVEL, RADIUS = 0.20, 0.15, 8
MAX_ECCENTRICITY, MIN_SOLIDITY, MIN_PEAK = 0.95, 0.45, 0.05


def silent(traces: DataFrame) -> DataFrame:
    """Cells whose trace is NaN or null in every frame."""
    bad = F.col("value").isNull() | F.isnan("value")
    return traces.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).filter("n = bad").select(*CELL)


def drop_silent(cells: DataFrame, traces: DataFrame) -> DataFrame:
    """Rows of traces or footprints of cells with any real value."""
    return cells.join(silent(traces), CELL, "left_anti")


def mask(footprints: DataFrame, level: float = MORPH_LEVEL) -> DataFrame:
    """Pixels strictly above ``level`` times the cell's largest weight."""
    top = F.max("weight").over(Window.partitionBy(*CELL))
    return footprints.withColumn("top", top).filter(F.col("weight") > F.col("top") * level).select(*CELL, "y", "x")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n things reaches over the pairs (a, b): both ends take the lesser root until nothing changes."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _largest(cell: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which pixels, in order of cell, row and column, are in their cell's largest 8-connected part; of equal parts the one that comes first by column, then row.

    Pixels side by side are a run; runs of neighbouring rows touch if their columns do, one aside included.
    """
    if not len(cell):
        return np.zeros(0, bool)
    y, x = y.astype(np.int64) - y.min(), x.astype(np.int64) - x.min() + 1
    height, width = y.max() + 2, x.max() + 2
    line = cell * height + y
    first = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(x) != 1)]))
    length = np.diff(np.append(first, len(cell)))
    line, left, right = line[first], x[first], x[first] + length - 1
    lo = np.searchsorted(line * width + right, (line + 1) * width + left - 1, "left")
    hi = np.searchsorted(line * width + left, (line + 1) * width + right + 1, "right")
    n = np.maximum(hi - lo, 0)
    below = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    root = _joined(len(first), np.repeat(np.arange(len(first)), n), below)
    size = np.bincount(root, length, len(first))
    corner = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(corner, root, left * height + y[first])
    part = np.unique(root)
    order = part[np.lexsort((corner[part], -size[part], cell[first[part]]))]
    best = order[np.concatenate([[True], np.diff(cell[first[order]]) != 0])]
    return np.repeat(np.isin(root, best), length)


def largest_component(masked: DataFrame) -> DataFrame:
    """(session_id, cell_id, y, x) of the largest 8-connected part of each cell's mask; a cell has at most the pixels of one frame.

    Cells come as rows, and all cells of an Arrow batch are worked on together. Pixels that repeat count once.
    """
    pixels = masked.filter("y IS NOT NULL AND x IS NOT NULL").groupBy(*CELL).agg(F.array_sort(F.collect_set(F.struct("y", "x"))).alias("px"))
    kinds = {c: masked.schema[c].dataType for c in (*CELL, "y", "x")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, cell = lists.flatten(), np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            y, x = flat.field("y"), flat.field("x")
            at = pa.array(np.flatnonzero(_largest(cell, y.to_numpy(), x.to_numpy())))
            own = pa.array(cell).take(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), y.take(at), x.take(at)], [*CELL, "y", "x"])

    return pixels.mapInArrow(run, ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()))


def region_properties(parts: DataFrame) -> DataFrame:
    """Area, centroid and eccentricity of the ellipse of equal second moments (a pixel adds 1/12 each way)."""
    m = parts.groupBy(*CELL).agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("row"), F.avg("x").alias("col"), (F.var_pop("x") + 1 / 12).alias("xx"), (F.var_pop("y") + 1 / 12).alias("yy"), F.covar_pop("x", "y").alias("xy"))
    root = F.sqrt((F.col("xx") - F.col("yy")) ** 2 + 4 * F.col("xy") ** 2)
    long, short = F.col("xx") + F.col("yy") + root, F.col("xx") + F.col("yy") - root
    return m.select(*CELL, "area", "row", "col", F.sqrt(F.greatest(F.lit(0.0), 1 - short / long)).alias("eccentricity"))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = sorted(set(points))
    def half(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]
    return half(points) + half(points[::-1])


def _solidity(y: np.ndarray, x: np.ndarray) -> float:
    """Pixels over pixels whose centre is within the hull of all pixel corners."""
    hull = _hull([(r + dr, c + dc) for r, c in zip(y.tolist(), x.tolist(), strict=True) for dr in (-0.5, 0.5) for dc in (-0.5, 0.5)])
    rows, cols = np.mgrid[y.min() : y.max() + 1, x.min() : x.max() + 1]
    inside = np.ones(rows.shape, bool)
    for (r0, c0), (r1, c1) in zip(hull, hull[1:] + hull[:1], strict=True):
        inside &= (r1 - r0) * (cols - c0) - (c1 - c0) * (rows - r0) >= -1e-9
    return len(y) / max(1, int(inside.sum()))


def solidity(parts: DataFrame) -> DataFrame:
    """Area over the area of the filled convex hull; a cell has at most the pixels of one frame."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [g["session_id"].iloc[0]], "cell_id": [g["cell_id"].iloc[0]], "solidity": [_solidity(g["y"].to_numpy(), g["x"].to_numpy())]})

    keys = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in CELL)
    return parts.groupBy(*CELL).applyInPandas(run, f"{keys}, solidity double")


def inside_field(regions: DataFrame, h: int, w: int, margin: int = RADIUS) -> DataFrame:
    """Regions whose centroid is further than the margin from every edge."""
    return regions.filter((F.col("row") > margin) & (F.col("row") < h - margin) & (F.col("col") > margin) & (F.col("col") < w - margin))


def trace_quality(traces: DataFrame) -> DataFrame:
    """Baseline p20, scale max(|p20|, p50 of |trace|, 1), and of the scaled trace: peak p99, mean, snr p99 / max(IQR, 1e-3)."""
    lists = traces.groupBy(*CELL).agg(F.sort_array(F.collect_list("value")).alias("s"), F.sort_array(F.collect_list(F.abs("value"))).alias("a"), F.avg("value").alias("m"))
    p = {k: midpoint_percentile(F.col("s"), v) for k, v in (("f0", 20), ("q1", 25), ("q3", 75), ("top", 99))}
    values = lists.select(*CELL, "m", *[c.alias(k) for k, c in p.items()], midpoint_percentile(F.col("a"), 50).alias("mid"))
    scaled = values.withColumn("scale", F.greatest(F.abs("f0"), F.col("mid"), F.lit(1.0)))
    peak = (F.col("top") - F.col("f0")) / F.col("scale")
    return scaled.select(*CELL, "f0", "scale", peak.alias("peak"), ((F.col("m") - F.col("f0")) / F.col("scale")).alias("mean"), (peak / F.greatest((F.col("q3") - F.col("q1")) / F.col("scale"), F.lit(1e-3))).alias("snr"))


def least_area(radius: float = RADIUS) -> int:
    return int(math.pi * (0.45 * radius) ** 2 + 0.5)


def quality_table(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """Geometry, peak, mean and snr of every cell; zeros for the geometry of an empty mask."""
    parts = largest_component(mask(footprints))
    table = trace_quality(traces).select(*CELL, "peak", "mean", "snr").join(region_properties(parts), CELL, "left").join(solidity(parts), CELL, "left")
    return table.fillna(0, ["area"]).fillna(0.0, ["row", "col", "eccentricity", "solidity"])


def keep(table: DataFrame, radius: float = RADIUS, field: tuple[int, int] | None = None, min_area: int | None = None, max_eccentricity: float = MAX_ECCENTRICITY, min_solidity: float = MIN_SOLIDITY, min_peak: float = MIN_PEAK) -> DataFrame:
    """(session_id, cell_id, new_id): cells that pass area, shape, peak and, with ``field``, the edge rule; numbered anew."""
    area = least_area(radius) if min_area is None else min_area
    kept = table.filter((F.col("area") > 0) & (F.col("area") >= area) & (F.col("eccentricity") <= max_eccentricity) & (F.col("solidity") >= min_solidity) & (F.col("peak") >= min_peak))
    kept = inside_field(kept, *field, margin=int(radius)) if field else kept
    return renumber(kept)


def renumber(cells: DataFrame) -> DataFrame:
    return cells.select(*CELL).distinct().withColumn("new_id", F.row_number().over(Window.partitionBy("session_id").orderBy("cell_id")))


def apply_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of kept cells under their new ids."""
    return rows.join(ids, CELL).withColumn("cell_id", F.col("new_id")).drop("new_id")


def funnel(raw: DataFrame, traces: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts of cells: raw, with any real value, and after the keep rule."""
    n = lambda df, name: df.select(*CELL).distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    real = drop_silent(raw.select(*CELL).distinct(), traces)
    return n(raw, "n_raw").join(n(real, "n_real"), "session_id", "left").join(n(kept, "n_kept"), "session_id", "left").fillna(0)


def ranges(table: DataFrame) -> DataFrame:
    """Least and largest area, eccentricity, solidity, peak and snr."""
    return table.groupBy("session_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("area", "eccentricity", "solidity", "peak", "snr") for n, f in (("min", F.min), ("max", F.max))])


def curated(cells: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows of cells with a choice above 0, numbered anew; all of them if there are no choices at all."""
    if choices.isEmpty():
        return apply_ids(cells, renumber(cells))
    chosen = cells.select(*CELL).distinct().join(choices.filter("choice > 0").select("cell_id").distinct(), "cell_id", "left_semi")
    return apply_ids(cells, renumber(chosen))


def contours(footprints: DataFrame, h: int, w: int, level: float = CONTOUR_LEVEL) -> DataFrame:
    """(session_id, y, x) of all outlines: object pixels beside the outside, thickened by one and clipped to the field.

    Holes have outlines too, on their object's side. Cells of a session are laid over one another.
    """
    inside = mask(footprints, level)
    steps = lambda df, around: df.select(*CELL, "y", "x", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in around])).alias("d"))
    beside = steps(inside, ((-1, 0), (1, 0), (0, -1), (0, 1))).select(*CELL, "y", "x", (F.col("y") + F.col("d.dy")).alias("ny"), (F.col("x") + F.col("d.dx")).alias("nx"))
    there = inside.select(*CELL, F.col("y").alias("ny"), F.col("x").alias("nx"))
    border = beside.join(there, [*CELL, "ny", "nx"], "left_anti").select(*CELL, "y", "x").distinct()
    thick = steps(border, [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]).select("session_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    return thick.filter(F.col("y").between(1, h) & F.col("x").between(1, w)).distinct()
