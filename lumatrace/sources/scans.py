"""Scans with column resolution and optional inputs, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatrace.operators.clocks import parse, parse_or_null


def microscope_column(columns: list[str]) -> str:
    """The first column named ``Time``, whatever its case."""
    for c in columns:
        if c.lower() == "time":
            return c
    raise ValueError(f"no Time column among {columns}")


def camera_column(columns: list[str]) -> str:
    """The first column whose name holds both ``Ref`` and ``Time``, else the first that is ``Time``."""
    for c in columns:
        if "ref" in c.lower() and "time" in c.lower():
            return c
    return microscope_column(columns)


def scan_clock(raw: DataFrame, stream: str, number: str) -> DataFrame:
    """A clock of any file: (session_id, stream, frame_idx, ts), its time column resolved by name."""
    column = microscope_column(raw.columns) if stream == "microscope" else camera_column(raw.columns)
    return raw.select("session_id", F.lit(stream).alias("stream"), F.col(number).cast("int").alias("frame_idx"), parse(F.col(column)).alias("ts"))


def scan_first_clock(sources: list[DataFrame], stream: str, number: str) -> DataFrame:
    """(session_id, stream, frame_idx, ts, source): of each session the clock of its first source that has a time column.

    ``sources`` stand in order; which of them have such a column is known from their schemas, so those that don't
    are never read. One plan: the others are scanned side by side, and a session's rows stay of the source
    that comes first among those that hold any of it, ``source`` from 0. Only those are parsed, so bad text in a
    source that isn't used is no error. No source with a time column is.
    """
    resolve = microscope_column if stream == "microscope" else camera_column
    parts = []
    for i, raw in enumerate(sources):
        try:
            column = resolve(raw.columns)
        except ValueError:
            continue
        parts.append(raw.select("session_id", F.col(number).cast("int").alias("frame_idx"), F.col(column).cast("string").alias("text"), F.lit(i).alias("source")))
    if not parts:
        raise ValueError(f"no time column for {stream} in {len(sources)} sources: {[df.columns for df in sources]}")
    every = reduce(DataFrame.union, parts)
    if len(parts) > 1:
        every = every.join(every.groupBy("session_id").agg(F.min("source").alias("source")), ["session_id", "source"], "left_semi")
    return every.select("session_id", F.lit(stream).alias("stream"), "frame_idx", parse(F.col("text")).alias("ts"), "source")


def scan_pulses(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pulses (source, pulse_idx, ts) of all sources that hold any, and (source, warning) for those that don't."""
    if not sources:
        raise ValueError("no pulse source")
    parts = [df.select(F.lit(name).alias("source"), F.col("pulse_idx").cast("int").alias("pulse_idx"), parse_or_null(F.col(microscope_column(df.columns)).cast("string")).alias("ts")) for name, df in sources.items()]
    every = reduce(DataFrame.union, parts)
    known = every.sparkSession.createDataFrame([(n,) for n in sources], "source string")
    good = every.filter("ts IS NOT NULL")
    return good, known.join(good.select("source").distinct(), "source", "left_anti").withColumn("warning", F.lit("no readable stamp"))


def scan_pulse_files(spark: SparkSession, pattern: str, source: Column | None = None, format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Pulses (source, pulse_idx, ts) of all files of a pattern, and (source, warning, n) for what could not be used.

    One scan of all files, whose column ``Time`` is found whatever its case. Warnings: ``unreadable`` for a file that
    gives no row (torn, of another format or empty), ``no readable stamp`` for one without any good row, and
    ``bad stamp`` with the number of rows left out of another. ``source`` names a file, by default its name, of
    ``_metadata``; files of one name count as one. ``format``: one with named columns (parquet, orc, json).
    """
    name = (F.col("_metadata.file_name") if source is None else source).alias("source")
    read = spark.read.format(format).schema("pulse_idx long, Time string").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = read.load(pattern).select(name, F.col("pulse_idx").cast("int").alias("pulse_idx"), parse_or_null(F.col("Time")).alias("ts"))
    listed = spark.read.format("binaryFile").load(pattern).select(name).distinct()  # names only: contents aren't read
    seen = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count("ts").alias("good"))
    said = F.when(F.col("rows").isNull(), "unreadable").when(F.col("good") == 0, "no readable stamp").when(F.col("good") < F.col("rows"), "bad stamp")
    warned = listed.join(seen, "source", "left").select("source", said.alias("warning"), F.coalesce(F.col("rows") - F.col("good"), F.lit(0)).alias("n"))
    return rows.filter("ts IS NOT NULL"), warned.filter("warning IS NOT NULL")


def optional_table(spark: SparkSession, path: str, schema: T.StructType | str, mandatory: bool = False) -> DataFrame:
    """The table at ``path``; if there is none, an error where it is mandatory and else no rows of its schema."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.read.parquet(path)
    if mandatory:
        raise FileNotFoundError(f"mandatory input is missing: {path}")
    return spark.createDataFrame([], schema)


def save_results(results: dict[str, DataFrame], folder: str, by: str | None = "session_id", mode: str = "overwrite") -> None:
    """A table for each named result, in partitions by session; overwriting replaces only the sessions that are written."""
    for name, df in results.items():
        writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")


def reuse_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at ``path``, written first by ``compute()`` if it isn't there yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def trace_export(traces: DataFrame, z: DataFrame, dff: DataFrame) -> DataFrame:
    """Raw, z and dF/F side by side."""
    keys = ["session_id", "cell_id", "frame_idx"]
    return traces.select(*keys, F.col("value").alias("raw")).join(z.select(*keys, "z"), keys).join(dff.select(*keys, "dff"), keys)
