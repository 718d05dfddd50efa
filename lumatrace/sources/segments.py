"""Lists of recorded segments: their order, their global frame numbers, and what stands where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_number(name: Column) -> Column:
    """The last digit group of a name; 0 without one."""
    groups = F.regexp_extract_all(name, F.lit("([0-9]+)"), 1)
    return F.coalesce(F.when(F.size(groups) > 0, F.element_at(groups, -1)).try_cast("long"), F.lit(0).cast("long"))


def all_digits(name: Column) -> Column:
    """All digits of a name as one number; 0 without any."""
    digits = F.regexp_replace(name, "[^0-9]", "")
    return F.when(digits == "", 0).otherwise(digits.try_cast("long")).cast("long")


def ordered(segments: DataFrame, rule: str = "natural", by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Add ``ord`` from 1: ``natural`` (last digit group), ``digits`` (all digits) or ``name``; ties by name."""
    key = {"natural": last_number(F.col("segment_name")), "digits": all_digits(F.col("segment_name")), "name": F.lit(0)}[rule]
    return segments.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(key, "segment_name")))


def pick(files: DataFrame, patterns: tuple[str, ...] = (r"\.tif$", r"\.tiff$"), by: tuple[str, ...] = ("session_id",), nested: str | None = None) -> DataFrame:
    """The files of the first pattern that any file of a session matches; index files never count.

    ``nested``: the folder (column ``folder``) that is looked in first; only where no pattern matches in it do the
    files beside it count, whose ``folder`` is empty or null. Other folders never do. ``first`` marks the file
    that comes first by name, for uses that take one.
    """
    pattern = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        pattern = F.when(F.col("segment_name").rlike(p), i).otherwise(pattern)
    level = F.lit(0) if nested is None else F.when(F.col("folder") == nested, 0).when(F.coalesce("folder", F.lit("")) == "", 1)
    found = files.filter(~F.contains(F.col("segment_name"), F.lit("_index"))).withColumn("rank", level * len(patterns) + pattern).filter("rank IS NOT NULL")
    order = Window.partitionBy(*by).orderBy("rank")
    best = found.withColumns({"best": F.rank().over(order), "first": F.row_number().over(order.orderBy("rank", "segment_name")) == 1})
    return best.filter("best = 1").drop("rank", "best")


def concatenated(segments: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """First and last global frame number of each segment, in order of ``ord``."""
    last = F.sum("n_frames").over(Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("last_frame", last).withColumn("first_frame", F.col("last_frame") - F.col("n_frames") + 1)


def locate(wanted: DataFrame, segments: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Segment and local frame of each global ``at``, clamped to the recording.

    Segments and wanted frames are laid on one line per recording, and each frame takes the segment
    that began last before it: no range join.
    """
    total = segments.groupBy(*by).agg(F.max("last_frame").alias("n"))
    asked = wanted.join(total, list(by)).withColumn("global_frame", F.least(F.greatest(F.col("at").cast("long"), F.lit(1).cast("long")), "n"))
    keep = [c for c in wanted.columns if c not in by]
    line = asked.select(*by, F.col("global_frame").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("struct<segment_name:string,first_frame:bigint>").alias("seg"), *keep)
    begins = segments.filter("n_frames > 0").select(*by, F.col("first_frame").alias("pos"), F.lit(0).alias("kind"), F.struct("segment_name", F.col("first_frame").cast("long").alias("first_frame")).alias("seg"), *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in keep])
    w = Window.partitionBy(*by).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = begins.union(line).withColumn("seg", F.last("seg", True).over(w)).filter("kind = 1")
    return found.select(*by, *keep, F.col("seg.segment_name").alias("segment_name"), (F.col("pos") - F.col("seg.first_frame") + 1).alias("local_frame"))


def frame_range(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Frames of a range; the filter reaches the file scan."""
    return frames.filter(F.col("frame_idx").between(first, last))
