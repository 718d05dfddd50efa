"""Device clocks: (session_id, stream, frame_idx, ts) and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import seconds_between

STAMP = "yyyy-MM-dd HH:mm:ss.SSS"


def parse(text: Column) -> Column:
    """A stamp without zone; text of another form is an error."""
    return F.to_timestamp_ntz(text, F.lit(STAMP))


def parse_or_null(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}$"), text.try_cast("timestamp_ntz"))


def microscope_clock(raw: DataFrame) -> DataFrame:
    """One stamp a plane pair: odd raw numbers, numbered anew."""
    odd = raw.filter("raw_idx % 2 = 1")
    return odd.select("session_id", F.lit("microscope").alias("stream"), F.expr("int((raw_idx + 1) div 2)").alias("frame_idx"), parse(F.col("time")).alias("ts"))


def camera_clock(raw: DataFrame) -> DataFrame:
    return raw.select("session_id", F.concat(F.lit("camera"), "cam_id").alias("stream"), "frame_idx", parse(F.col("ref_time")).alias("ts"))


def since_first(clock: DataFrame) -> DataFrame:
    """Seconds since the stream's first frame by number."""
    first = clock.groupBy("session_id", "stream").agg(F.min_by("ts", "frame_idx").alias("first"))
    return clock.join(first, ["session_id", "stream"]).withColumn("sec", seconds_between(F.col("ts"), F.col("first"))).drop("first")


def median_rate(clock: DataFrame) -> DataFrame:
    """1 / median interval of each stream; null for one frame, and where the median isn't positive."""
    gap = seconds_between(F.col("ts"), F.lag("ts").over(Window.partitionBy("session_id", "stream").orderBy("frame_idx")))
    mid = clock.withColumn("gap", gap).groupBy("session_id", "stream").agg(F.median("gap").alias("mid"))
    return mid.select("session_id", "stream", F.when(F.col("mid") > 0, 1 / F.col("mid")).alias("rate"))


def length_warnings(clock: DataFrame, frames: DataFrame) -> DataFrame:
    """Sessions whose clock and recording differ in length."""
    a = clock.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_clock"))
    b = frames.groupBy("session_id").agg(F.countDistinct("frame_idx").alias("n_frames"))
    return a.join(b, "session_id").filter("n_clock <> n_frames")


def summary(clock: DataFrame) -> DataFrame:
    """Frames, rate, first and last stamp of each stream."""
    ends = clock.groupBy("session_id", "stream").agg(F.count(F.lit(1)).alias("n_frames"), F.min_by("ts", "frame_idx").alias("first"), F.max_by("ts", "frame_idx").alias("last"))
    return ends.join(median_rate(clock), ["session_id", "stream"])
