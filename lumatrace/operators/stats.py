"""Area under the curve and paired tests."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import sem

#: Largest number of non-zero differences with an exact signed-rank distribution.
EXACT_UP_TO = 15


def sides(peri: DataFrame, pre: float = 2.0, post: float = 2.0) -> DataFrame:
    """Samples of the window before (-pre <= t < 0) and after (0 <= t <= post) the event."""
    side = F.when((F.col("t") >= -pre) & (F.col("t") < 0), "pre").when((F.col("t") >= 0) & (F.col("t") <= post), "post")
    return peri.withColumn("side", side).filter(F.col("side").isNotNull())


def trapezoid(sided: DataFrame) -> DataFrame:
    """(session_id, event_type, trial, cell_id, pre, post): areas over the sampled points; one point has area 0."""
    keys = ["session_id", "event_type", "trial", "cell_id", "side"]
    w = Window.partitionBy(*keys).orderBy("t")
    part = (F.col("t") - F.lag("t").over(w)) * (F.col("dff") + F.lag("dff").over(w)) / 2
    areas = sided.withColumn("part", part).groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("auc"))
    return areas.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("side") == "pre", F.col("auc"))).alias("pre"), F.max(F.when(F.col("side") == "post", F.col("auc"))).alias("post"))


def by_cell(auc: DataFrame) -> DataFrame:
    return auc.groupBy("session_id", "event_type", "cell_id").agg(F.avg("pre").alias("pre"), F.avg("post").alias("post"), F.count(F.lit(1)).alias("n"))


def by_trial(auc: DataFrame) -> DataFrame:
    return auc.groupBy("session_id", "event_type", "trial").agg(F.avg("pre").alias("pre"), F.avg("post").alias("post"))


def enough_trials(auc: DataFrame, least: int = 2) -> DataFrame:
    """Only event types of a session with at least ``least`` trials."""
    kept = auc.groupBy("session_id", "event_type").agg(F.countDistinct("trial").alias("trials")).filter(F.col("trials") >= least)
    return auc.join(kept.select("session_id", "event_type"), ["session_id", "event_type"], "left_semi")


def bars(trials: DataFrame) -> DataFrame:
    """Mean and SEM of both sides over trials."""
    return trials.groupBy("session_id", "event_type").agg(*[f(c).alias(f"{n}_{c}") for c in ("pre", "post") for n, f in (("mean", F.avg), ("sem", sem))])


def signed_ranks(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per group: n pairs, mean m and deviation s of the differences, nz non-zero ones, w_plus, w_minus, tie term and doubled ranks.

    Differences are rounded to 9 decimals before they are ranked, so that ties don't hang on float noise.
    Ranks are gathered only where at most EXACT_UP_TO are non-zero. Windows and sums share one shuffle by
    ``keys`` and spill.
    """
    d, nonzero = F.col("d"), F.col("d") != 0
    diff = pairs.select(*keys, F.round(F.col(b) - F.col(a), 9).alias("d")).repartition(*keys).withColumn("live", F.coalesce(nonzero, F.lit(False)))
    group = Window.partitionBy(*keys, "live")
    ranked = diff.withColumns({"ties": F.count(F.lit(1)).over(Window.partitionBy(*keys, "live", F.abs("d"))), "of": F.count(F.lit(1)).over(group)})
    ranked = ranked.withColumn("r", F.rank().over(group.orderBy(F.abs("d"))) + (F.col("ties") - 1) / 2)
    sums = ranked.groupBy(*keys).agg(
        F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count_if(nonzero).alias("nz"),
        F.sum(F.when(d > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(d < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.when(nonzero, F.col("ties") * F.col("ties") - 1)).alias("tie_term"), F.sort_array(F.collect_list(F.when(nonzero & (F.col("of") <= EXACT_UP_TO), (2 * F.col("r")).cast("int")))).alias("doubled"),
    )
    return sums


@lru_cache(maxsize=1 << 16)
def ways(doubled: tuple[int, ...], most: int) -> float:
    """How many subsets of ``doubled`` have a sum of at most ``most``."""
    counts = np.zeros(sum(doubled) + 1)
    counts[0] = 1
    for r in doubled:
        counts[r:] += counts[: len(counts) - r].copy()
    return float(counts[: most + 1].sum())


def exact_p(doubled: Column, w: Column) -> Column:
    """Two-sided exact p: the share of sign patterns whose rank sum is at most ``w``, twice. ``doubled``: whole ranks times 2."""

    def run(ranks: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * ways(tuple(r.tolist()), int(2 * m)) / 2.0 ** len(r)) if len(r) else 1.0 for r, m in zip(ranks, most, strict=True)])

    return F.pandas_udf(run, "double")(doubled, w)


def normal_two_sided(z: Column | str) -> Column:
    """2 (1 - Phi(|z|)); there is no error function among Spark's.

    For all rows at once: Simpson's rule on the density from |z| to |z| + 12, in 6,000 steps; its error is
    below 1e-12.
    """

    def run(values: pd.Series) -> pd.Series:
        out = np.full(len(values), np.nan)
        real = np.flatnonzero(values.notna())
        steps = np.linspace(0.0, 12.0, 6001)
        weights = np.where(np.arange(6001) % 2, 4.0, 2.0)
        weights[[0, -1]] = 1.0
        for part in np.array_split(real, max(1, len(real) // 200)):
            x = np.abs(values.to_numpy(float)[part])[:, None] + steps
            out[part] = 2 * (np.exp(-x * x / 2) * weights).sum(1) * (steps[1] / 3) / math.sqrt(2 * math.pi)
        return pd.Series(out)

    return F.pandas_udf(run, "double")(z)


def rank_p(r: DataFrame) -> Column:
    """Signed-rank p of the rows of ``signed_ranks``: exact up to EXACT_UP_TO non-zero differences, then normal with tie correction."""
    n = F.col("nz").cast("double")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24
    least = F.least("w_plus", "w_minus")
    z = F.when(F.col("nz") > EXACT_UP_TO, (least - n * (n + 1) / 4) / F.sqrt(variance))
    return F.when(F.col("nz") == 0, 1.0).when(F.col("nz") <= EXACT_UP_TO, exact_p("doubled", least)).otherwise(normal_two_sided(z))


def t_p() -> Column:
    """Two-sided paired t-test p for up to 4 pairs (df 1 to 3, closed forms); NaN where it isn't defined, null beyond 4."""
    t = F.abs(F.col("m") / (F.col("s") / F.sqrt("n")))
    u = t / math.sqrt(3)
    return (
        F.when(F.col("n") < 2, float("nan")).when((F.col("s") == 0) & (F.col("m") == 0), float("nan")).when(F.col("s") == 0, 0.0)
        .when(F.col("n") == 2, 1 - 2 / math.pi * F.atan(t)).when(F.col("n") == 3, 1 - t / F.sqrt(2 + t * t)).when(F.col("n") == 4, 1 - 2 / math.pi * (F.atan(u) + u / (1 + u * u)))
    )


def signed_rank_p(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Wilcoxon signed-rank p per group."""
    r = signed_ranks(pairs, keys, a, b)
    return r.select(*keys, "n", rank_p(r).alias("p_rank"))


def paired_t_p(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Paired t-test p per group of up to 4 pairs; null for larger ones, which ``paired_test`` gives to the signed-rank test."""
    stats = pairs.select(*keys, F.round(F.col(b) - F.col(a), 9).alias("d")).groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return stats.select(*keys, "n", t_p().alias("p_t"))


def stars(p: Column, alpha: float = 0.05) -> Column:
    """``***`` below .001, ``**`` below .01, ``*`` below alpha, else ``n.s.``; NaN and null are ``n.s.``."""
    real = p.isNotNull() & ~F.isnan(p)
    return F.when(real & (p < 0.001), "***").when(real & (p < 0.01), "**").when(real & (p < alpha), "*").otherwise("n.s.")


def paired_test(pairs: DataFrame, keys: list[str], a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """(keys, n, test, p, stars): signed-rank from 5 pairs on, t-test below."""
    r = signed_ranks(pairs, keys, a, b)
    both = r.select(*keys, "n", F.when(F.col("n") >= 5, rank_p(r)).otherwise(t_p()).alias("p"))
    test = F.when(F.col("n") >= 5, "signed-rank").otherwise("paired t-test")
    return both.select(*keys, "n", test.alias("test"), "p", stars(F.col("p"), alpha).alias("stars"))


def significant_count(tested: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """How many p values are below alpha; NaN doesn't count."""
    return tested.groupBy(*keys).agg(F.count_if(F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") < alpha)).alias("n_significant"), F.count(F.lit(1)).alias("n_tested"))
