"""Checks of a recording as rows (session_id, check, status, detail)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import seconds_between
from lumatrace.operators.frames import pair_maximum


def row(df: DataFrame, name: str, ok: Column, detail: Column, otherwise: str = "WARNING") -> DataFrame:
    return df.select("session_id", F.lit(name).alias("check"), F.when(ok, "OK").otherwise(otherwise).alias("status"), detail.alias("detail"))


def movie_inventory(segments: DataFrame) -> DataFrame:
    """Frames, pairs, odd total and segments of another size than the first, of ordered segments."""
    first = Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = segments.withColumn("odd_size", (F.first("h").over(first) != F.col("h")) | (F.first("w").over(first) != F.col("w")))
    return sized.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n_frames").alias("n_frames"), F.count_if("odd_size").alias("n_other_size")).select("session_id", "n_segments", "n_frames", F.expr("n_frames div 2").alias("n_pairs"), (F.col("n_frames") % 2 == 1).alias("odd"), "n_other_size")


def movie_checks(inventory: DataFrame, expected: int = 18000) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    parts = [row(inventory, "movie_pairs", ~F.col("odd"), text("n_pairs")), row(inventory, "movie_sizes", F.col("n_other_size") == 0, text("n_other_size")), row(inventory, "movie_total", F.col("n_frames") == expected, text("n_frames"), "NOTE")]
    return reduce(DataFrame.union, parts)


def projection_spot_check(frames: DataFrame) -> DataFrame:
    """Mean and largest value of the first four frames and of the two pairs they make."""
    head = frames.filter("frame_idx <= 4")
    every = head.select("session_id", F.lit("frame").alias("kind"), "frame_idx", "pixels").union(pair_maximum(head).select("session_id", F.lit("pair"), "frame_idx", "pixels"))
    return every.select("session_id", "kind", "frame_idx", (F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v) / F.size("pixels")).alias("mean"), F.array_max("pixels").alias("max"))


def interleaved(raw: DataFrame) -> DataFrame:
    """Whether both plane numbers are among the first ten stamps."""
    seen = raw.filter("raw_idx <= 10").groupBy("session_id").agg(F.bool_or(F.col("slice") == "1").alias("one"), F.bool_or(F.col("slice") == "2").alias("two"))
    return row(seen, "interleave", F.col("one") & F.col("two"), F.concat_ws(",", F.when(F.col("one"), "1"), F.when(F.col("two"), "2")))


def two_point_rate(clock: DataFrame) -> DataFrame:
    """1 / (second - first stamp), 0 if not positive, and half of it."""
    ends = clock.groupBy("session_id", "stream").agg(*[F.max(F.when(F.col("frame_idx") == i, F.col("ts"))).alias(f"t{i}") for i in (1, 2)])
    gap = seconds_between(F.col("t2"), F.col("t1"))
    return ends.withColumn("rate", F.when(gap > 0, 1 / gap).otherwise(0.0)).select("session_id", "stream", "rate", (F.col("rate") / 2).alias("plane_rate"))


def durations(clocks: DataFrame) -> DataFrame:
    """Frames over two-point rate of each stream; 0 without a rate."""
    n = clocks.groupBy("session_id", "stream").agg(F.count(F.lit(1)).alias("n"))
    joined = n.join(two_point_rate(clocks), ["session_id", "stream"])
    return joined.select("session_id", "stream", "n", "rate", F.when(F.col("rate") > 0, F.col("n") / F.col("rate")).otherwise(0.0).alias("duration"))


def duration_check(clocks: DataFrame, within: float = 60.0) -> DataFrame:
    """Camera 1 against microscope: durations closer than ``within`` seconds; detail is the ratio of rates."""
    d = durations(clocks)
    pick = lambda s, p: d.filter(F.col("stream") == s).select("session_id", F.col("duration").alias(f"{p}_dur"), F.col("rate").alias(f"{p}_rate"))
    both = pick("microscope", "m").join(pick("camera1", "c"), "session_id")
    ratio = F.when(F.col("m_rate") > 0, F.col("c_rate") / F.col("m_rate")).otherwise(0.0)
    return row(both, "durations", F.abs(F.col("c_dur") - F.col("m_dur")) < within, F.format_string("%.1f", ratio))


def camera_inventory(segments: DataFrame) -> DataFrame:
    """Segments, frames and megabytes of each camera."""
    return segments.groupBy("session_id", "cam_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n_frames").alias("n_frames"), (F.sum("bytes") / 1e6).alias("mb"))


def interval_stability(paired: DataFrame, first: int = 100) -> DataFrame:
    """Mean and population deviation of the first intervals of the paired clock, effective rate and length."""
    gap = seconds_between(F.col("ts"), F.lag("ts").over(Window.partitionBy("session_id").orderBy("frame_idx")))
    early = paired.filter(F.col("frame_idx") <= first).withColumn("gap", gap).groupBy("session_id").agg(F.avg("gap").alias("mean_dt"), F.stddev_pop("gap").alias("std_dt"))
    n = paired.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    rate = F.when(F.col("mean_dt") > 0, 1 / F.col("mean_dt")).otherwise(0.0)
    return early.join(n, "session_id").select("session_id", "mean_dt", "std_dt", rate.alias("rate"), (F.col("n") * F.col("mean_dt")).alias("length"))


def ratio_check(paired: DataFrame, camera: DataFrame, low: float = 5.0, high: float = 8.0) -> DataFrame:
    """Two-point camera rate over effective microscope rate, strictly between the limits."""
    both = interval_stability(paired).select("session_id", F.col("rate").alias("m")).join(two_point_rate(camera).select("session_id", F.col("rate").alias("c")), "session_id")
    ratio = F.when(F.col("m") > 0, F.col("c") / F.col("m")).otherwise(0.0)
    return row(both.withColumn("ratio", ratio), "rate_ratio", (F.col("ratio") > low) & (F.col("ratio") < high), F.format_string("%.1f", "ratio"), "NOTE")


def output_inventory(spark: SparkSession, folder: str, expected: tuple[str, ...]) -> DataFrame:
    """(output, status, rows, columns, types): each expected output table as present, with its rows and fields, or pending.

    All tables are counted in one job that reads no column, only the rows that the files' footers state; a table's
    fields are those of one footer. A table without any file is pending, one whose files hold no row has 0.
    """
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())

    def filled(path) -> bool:
        files = system.listFiles(path, True)
        while files.hasNext():
            if files.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    listed = {s.getPath().getName() for s in system.listStatus(home) if s.isDirectory() and filled(s.getPath())} if system.exists(home) else set()
    present = [name for name in expected if name in listed]
    schemas = {name: spark.read.parquet(f"{folder}/{name}").schema for name in present}
    fields = [(name, name in listed, ",".join(schemas[name].names) if name in listed else "", ",".join(f.dataType.simpleString() for f in schemas[name]) if name in listed else "") for name in expected]
    known = spark.createDataFrame(fields, "output string, there boolean, columns string, types string")
    counts = spark.createDataFrame([], "output string, rows long")
    if present:
        files = spark.read.option("recursiveFileLookup", "true").schema("none int").parquet(*[f"{folder}/{name}" for name in present])
        name = F.regexp_extract("_metadata.file_path", f"/{re.escape(home.getName())}/([^/]+)/", 1)
        counts = files.groupBy(name.alias("output")).agg(F.count(F.lit(1)).alias("rows"))
    return known.join(counts, "output", "left").select("output", F.when(F.col("there"), "present").otherwise("pending").alias("status"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "columns", "types")


def verdict(checks: DataFrame) -> DataFrame:
    """Whether a session has no warning."""
    return checks.groupBy("session_id").agg(F.bool_and(F.col("status") != "WARNING").alias("passed"), F.count_if(F.col("status") == "WARNING").alias("n_warnings"))
