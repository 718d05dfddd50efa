"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midpoint_percentile(ordered: Column, p: float) -> Column:
    """Percentile ``p`` of an ascending array; the k-th of n values sits at 100 (k - 0.5) / n, linear between, clamped."""
    n = F.size(ordered).cast("double")
    at = F.least(F.greatest(F.lit(p / 100.0) * n + 0.5, F.lit(1.0)), n)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low - 1), F.get(ordered, F.least(low, F.size(ordered) - 1))
    return F.when(n > 0, below + (at - low) * (above - below))


def percentiles_by(df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """Midpoint percentiles of all values of a group, one row a group.

    Sorted by a window, which spills, so that no group has to fit in memory as an array.
    """
    kept = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    ranked = kept.withColumns({"k": F.row_number().over(Window.partitionBy(*keys).orderBy("v")), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    def parts(p):
        at = F.least(F.greatest(F.lit(p / 100.0) * F.col("n") + 0.5, F.lit(1.0)), F.col("n").cast("double"))
        low = F.floor(at)
        return at, low
    aggs = []
    for name, p in named.items():
        at, low = parts(p)
        aggs += [F.max(F.when(F.col("k") == low, F.col("v"))).alias(f"{name}_lo"), F.max(F.when(F.col("k") == F.least(low + 1, F.col("n")), F.col("v"))).alias(f"{name}_hi"), F.max(at - low).alias(f"{name}_w")]
    found = ranked.groupBy(*keys).agg(*aggs)
    return found.select(*keys, *[(F.col(f"{n}_lo") + F.col(f"{n}_w") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n) for n in named])


def sem(value: str | Column) -> Column:
    """Standard error of the mean; 0 for a single value."""
    return F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))


def seconds(stamp: Column) -> Column:
    """Seconds of a zoneless timestamp since the epoch, with microseconds."""
    return seconds_between(stamp, F.lit("1970-01-01 00:00:00"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between zoneless timestamps, whatever the session's zone and its changes of the clock."""
    apart = later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")
    return apart.cast("interval second").cast("decimal(20, 6)").cast("double")
