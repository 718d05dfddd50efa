"""Comparison of two periods of a recording, by default the first five minutes and five late ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import sem
from lumatrace.operators.stats import paired_test

CELL = ["session_id", "cell_id"]
PERIODS = (("baseline", 0.0, 300.0), ("late", 1380.0, 1680.0))


def _within(rate: float, start: float, end: float) -> Column:
    t = (F.col("frame_idx") - 1) / F.lit(rate)
    return (t >= start) & (t < end)


def empty_periods(dff: DataFrame, rate: float, periods=PERIODS) -> DataFrame:
    """(session_id, period, seconds): the periods in which a session has no frame, and how long its recording is."""
    counts = dff.groupBy("session_id").agg(F.coalesce(F.max("frame_idx"), F.lit(0)).alias("last"), *[F.count_if(_within(rate, a, b)).alias(f"in_{i}") for i, (_, a, b) in enumerate(periods)])
    missing = F.array_compact(F.array(*[F.when(F.col(f"in_{i}") == 0, F.lit(n)) for i, (n, _, _) in enumerate(periods)]))
    return counts.select("session_id", F.explode(missing).alias("period"), (F.col("last") / F.lit(rate)).alias("seconds"))


def in_periods(dff: DataFrame, rate: float, periods=PERIODS, check: str | None = "error") -> DataFrame:
    """Rows of each period, with its name and minutes; start <= t < end, t = (frame - 1) / rate.

    ``check``: what becomes of a session without any frame in one of the periods. ``error``: the job fails and names
    the session, the periods and the recording's length; ``drop``: the session goes, see ``empty_periods``; None: it
    stays with the periods it has. A check is a sum over the same rows in the same plan; nothing runs before
    the caller's own action.
    """
    if check not in ("error", "drop", None):
        raise ValueError(f"unknown check: {check}")
    parts = [F.when(_within(rate, a, b), F.struct(F.lit(n).alias("period"), F.lit((b - a) / 60).alias("minutes"))) for n, a, b in periods]
    kept = dff.withColumn("in", F.explode(F.array_compact(F.array(*parts)))).select(*dff.columns, "in.period", "in.minutes")
    if check is None:
        return kept
    short = empty_periods(dff, rate, periods).groupBy("session_id").agg(F.concat_ws(", ", F.array_sort(F.collect_list("period"))).alias("missing"), F.max("seconds").alias("seconds"))
    if check == "drop":
        return kept.join(short.select("session_id"), "session_id", "left_anti").select(kept.columns)
    said = F.concat(F.lit("no frames in "), F.col("missing"), F.lit("; the recording of "), F.coalesce(F.col("session_id").cast("string"), F.lit("null")), F.lit(" has "), F.format_string("%.1f", "seconds"), F.lit(" s"))
    failed = short.select(F.raise_error(said).cast("boolean").alias("bad"))  # a row only where a period is empty
    return kept.join(failed, F.col("bad"), "left_anti").select(kept.columns)


def mean_and_peak(sliced: DataFrame) -> DataFrame:
    return sliced.groupBy(*CELL, "period").agg(F.avg("dff").alias("mean"), F.max(F.when(~F.isnan("dff"), F.col("dff"))).alias("peak"))


def thresholds(dff: DataFrame, k: float = 2.0) -> DataFrame:
    """Median + k * 1.4826 * median absolute deviation over a cell's whole trace."""
    medians = dff.groupBy(*CELL).agg(F.median("dff").alias("med"))
    spread = dff.join(medians, CELL).groupBy(*CELL, "med").agg(F.median(F.abs(F.col("dff") - F.col("med"))).alias("mad"))
    return spread.select(*CELL, (F.col("med") + k * 1.4826 * F.col("mad")).alias("threshold"))


def transients(sliced: DataFrame, limits: DataFrame) -> DataFrame:
    """Rising edges above the threshold by cell and period; a period that begins above counts one. Also per minute."""
    above = sliced.join(limits, CELL).withColumn("above", F.col("dff") > F.col("threshold"))
    before = F.lag("above", 1, False).over(Window.partitionBy(*CELL, "period").orderBy("frame_idx"))
    edges = above.withColumn("edge", (F.col("above") & ~before).cast("long"))
    counts = edges.groupBy(*CELL, "period", "minutes").agg(F.sum("edge").alias("n"))
    return counts.select(*CELL, "period", "n", (F.col("n") / F.col("minutes")).alias("rate"))


def metrics(dff: DataFrame, rate: float, periods=PERIODS, k: float = 2.0, check: str | None = None) -> DataFrame:
    """(session_id, cell_id, metric, baseline, late): mean, peak and transient rate side by side. ``check``: as in ``in_periods``."""
    sliced = in_periods(dff, rate, periods, check)
    wide = mean_and_peak(sliced).join(transients(sliced, thresholds(dff, k)).select(*CELL, "period", "rate"), [*CELL, "period"])
    long = wide.unpivot([*CELL, "period"], ["mean", "peak", "rate"], "metric", "value")
    first, second = periods[0][0], periods[1][0]
    return long.groupBy(*CELL, "metric").agg(F.max(F.when(F.col("period") == first, F.col("value"))).alias("baseline"), F.max(F.when(F.col("period") == second, F.col("value"))).alias("late"))


def compare(by_metric: DataFrame) -> DataFrame:
    """Paired test across cells for each metric of a session."""
    return paired_test(by_metric.filter("baseline IS NOT NULL AND late IS NOT NULL"), ["session_id", "metric"], "baseline", "late")


def bars(by_metric: DataFrame) -> DataFrame:
    """Mean and SEM of both periods, and the bracket's height, 1.2 times the highest value of a cell."""
    top = F.max(F.greatest("baseline", "late")) * 1.2
    return by_metric.groupBy("session_id", "metric").agg(F.avg("baseline").alias("mean_baseline"), sem("baseline").alias("sem_baseline"), F.avg("late").alias("mean_late"), sem("late").alias("sem_late"), top.alias("bracket"))
