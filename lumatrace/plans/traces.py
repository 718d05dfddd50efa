"""Queries over traces: dF/F, peri-event windows, areas, tests, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.operators import align, periods, peri, stats, traces
from lumatrace.plans import fixtures as fx

#: The periods of the query, in seconds of the derived recordings.
PERIODS = (("baseline", 0.0, 60.0), ("late", 120.0, 180.0))
RATE = peri.RATE
PRE, POST = peri.window_frames()


def tidy(df: DataFrame, *doubles: str) -> DataFrame:
    """Doubles rounded to 6 places, minus zero as zero, so that the order of sums doesn't show."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in doubles})


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def pct(s: str, p: float) -> str:
    """The midpoint percentile of an ascending DuckDB list."""
    at = f"least(greatest({p / 100.0!r} * len({s}) + 0.5, 1.0), CAST(len({s}) AS DOUBLE))"
    lo = f"CAST(floor({at}) AS INTEGER)"
    return f"({s}[{lo}] + ({at} - {lo}) * ({s}[least({lo} + 1, len({s}))] - {s}[{lo}]))"


def dff(spark, d):
    return traces.delta_f(fx.traces(spark, d))


def flags(spark, d):
    return align.one_hot(fx.traces(spark, d).select("session_id", "frame_idx").distinct(), fx.marks(spark, d))


def numbered(spark, d):
    lengths = fx.traces(spark, d).groupBy("session_id").agg(F.max("frame_idx").alias("n_frames"))
    return peri.trials(peri.event_frames(flags(spark, d)), lengths)


def windows(spark, d):
    return peri.peri_event(dff(spark, d), numbered(spark, d))


def auc(spark, d):
    return stats.enough_trials(stats.trapezoid(stats.sides(windows(spark, d))))


def metrics(spark, d):
    return periods.metrics(dff(spark, d), RATE, PERIODS)


def cell_pairs(spark, d):
    return auc(spark, d).select("session_id", "event_type", "cell_id", "trial", "pre", "post")


_T = "(frame_idx - 1) / 4.605"
VIEWS = {
    "dff": "SELECT session_id, cell_id, frame_idx, (value - avg(value) OVER c) / greatest(abs(avg(value) OVER c), 1.0) AS dff FROM traces WINDOW c AS (PARTITION BY session_id, cell_id)",
    "lengths": "SELECT session_id, max(frame_idx) AS n_frames FROM traces GROUP BY session_id",
    "ev": "SELECT DISTINCT session_id, label AS event_type, frame_idx FROM marks WHERE label <> 'Reaction_offset'",
    "tr": f"SELECT e.session_id, event_type, frame_idx AS event_frame, CAST(row_number() OVER (PARTITION BY e.session_id, event_type ORDER BY frame_idx) AS INTEGER) AS trial FROM ev e JOIN lengths l ON e.session_id = l.session_id WHERE frame_idx > {PRE} AND frame_idx <= n_frames - {POST}",
    "pw": f"SELECT tr.session_id, event_type, trial, event_frame, cell_id, CAST(o AS INTEGER) AS \"offset\", o / 4.605 AS t, dff FROM tr, range(-{PRE}, {POST + 1}) q(o), dff d WHERE d.session_id = tr.session_id AND d.frame_idx = event_frame + o",
    "pm": "SELECT session_id, event_type, cell_id, \"offset\", avg(dff) AS mean, coalesce(stddev_samp(dff) / sqrt(count(dff)), 0.0) AS sem, count(*) AS n_trials FROM pw GROUP BY ALL",
    "sd": "SELECT *, CASE WHEN t < 0 THEN 'pre' ELSE 'post' END AS side FROM pw WHERE t >= -2.0 AND t <= 2.0",
    "tp": "SELECT session_id, event_type, trial, cell_id, side, sum(part) AS a FROM (SELECT *, coalesce((t - lag(t) OVER k) * (dff + lag(dff) OVER k) / 2, 0.0) AS part FROM sd WINDOW k AS (PARTITION BY session_id, event_type, trial, cell_id, side ORDER BY t)) GROUP BY ALL",
    "tz": "SELECT session_id, event_type, trial, cell_id, max(CASE WHEN side = 'pre' THEN a END) AS pre, max(CASE WHEN side = 'post' THEN a END) AS post FROM tp GROUP BY ALL",
    "au": "SELECT * FROM tz WHERE (session_id, event_type) IN (SELECT (session_id, event_type) FROM tz GROUP BY session_id, event_type HAVING count(DISTINCT trial) >= 2)",
    "tt": "SELECT session_id, event_type, trial, avg(pre) AS pre, avg(post) AS post FROM au GROUP BY ALL",
    "sl": f"SELECT *, CASE WHEN {_T} < 60 THEN 'baseline' ELSE 'late' END AS period, 1.0 AS minutes FROM dff WHERE ({_T} >= 0 AND {_T} < 60) OR ({_T} >= 120 AND {_T} < 180)",
    "md": "SELECT session_id, cell_id, median(dff) AS med FROM dff GROUP BY ALL",
    "th": "SELECT d.session_id, d.cell_id, med + 2.0 * 1.4826 * median(abs(dff - med)) AS threshold FROM dff d JOIN md ON d.session_id = md.session_id AND d.cell_id = md.cell_id GROUP BY d.session_id, d.cell_id, med",
    "ab": "SELECT s.*, dff > threshold AS above FROM sl s JOIN th ON s.session_id = th.session_id AND s.cell_id = th.cell_id",
    "ed": "SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY session_id, cell_id, period ORDER BY frame_idx), false) AS edge FROM ab",
    "tn": "SELECT session_id, cell_id, period, CAST(count(*) FILTER (edge) AS BIGINT) AS n, count(*) FILTER (edge) / max(minutes) AS rate FROM ed GROUP BY ALL",
    "mp": "SELECT session_id, cell_id, period, avg(dff) AS mean, max(dff) AS peak FROM sl GROUP BY ALL",
    "ml": "SELECT mp.session_id, mp.cell_id, mp.period, m AS metric, CASE m WHEN 'mean' THEN mean WHEN 'peak' THEN peak ELSE rate END AS value FROM mp JOIN tn ON mp.session_id = tn.session_id AND mp.cell_id = tn.cell_id AND mp.period = tn.period, (VALUES ('mean'), ('peak'), ('rate')) v(m)",
    "mw": "SELECT session_id, cell_id, metric, max(CASE WHEN period = 'baseline' THEN value END) AS baseline, max(CASE WHEN period = 'late' THEN value END) AS late FROM ml GROUP BY ALL",
    # groups of pairs that are tested: 3 to 4 cells for the t-test, more for the ranks
    "pairs": "SELECT session_id, event_type, cell_id, trial, pre, post FROM au",
}
_D = "SELECT session_id, event_type, cell_id, round(post - pre, 9) AS d FROM pairs"
VIEWS |= {
    "dd": _D,
    "rk": "SELECT *, rank() OVER (PARTITION BY session_id, event_type, cell_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY session_id, event_type, cell_id, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY session_id, event_type, cell_id, abs(d)) AS ties FROM dd WHERE d <> 0",
    "ws": "SELECT session_id, event_type, cell_id, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS nz, sum(ties * ties - 1) AS tie_term, list_sort(list(CAST(2 * r AS INTEGER))) AS doubled FROM rk GROUP BY ALL",
    "ts": "SELECT session_id, event_type, cell_id, count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM dd GROUP BY ALL",
    # 2^nz sign patterns, at most 15 bits; counts of small sums
    "ex": "SELECT session_id, event_type, cell_id, least(1.0, 2.0 * (SELECT count(*) FROM range(0, CAST(pow(2, nz) AS BIGINT)) q(b) WHERE list_sum(list_transform(range(1, nz + 1), lambda i: CASE WHEN (b >> CAST(i - 1 AS BIGINT)) & 1 = 1 THEN doubled[i] ELSE 0 END)) <= 2 * least(w_plus, w_minus)) / pow(2, nz)) AS p FROM ws WHERE nz <= 15",
}


QUERIES = {
    "trc2_delta_f": lambda s, d: tidy(dff(s, d), "dff"),
    "trc3_peak_ranking": lambda s, d: tidy(traces.peak_ranking(dff(s, d)), "peak"),
    "trc4_top_traces": lambda s, d: tidy(traces.top_traces(dff(s, d), 3), "dff"),
    "trc5_z_trace": lambda s, d: tidy(traces.z_trace(fx.traces(s, d)).drop("value"), "z"),
    "trc6_time_axis": lambda s, d: tidy(traces.time_axis(fx.traces(s, d), RATE).select("session_id", "cell_id", "frame_idx", "sec"), "sec"),
    "trc7_stacked": lambda s, d: tidy(traces.stacked(dff(s, d)), "y"),
    "trc9_heatmap": lambda s, d: traces.heatmap(tidy(dff(s, d), "dff")).select("session_id", "cell_id", F.size("row").cast("long").alias("n"), F.round(F.aggregate("row", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.element_at("row", 1).alias("first"), F.element_at("row", -1).alias("last")),
    "trc10_clip_normalise": lambda s, d: tidy(traces.clip_normalise(dff(s, d).filter("frame_idx BETWEEN 20 AND 70")), "norm"),
    "trc11_population": lambda s, d: tidy(traces.population(dff(s, d)), "mean_dff"),
    "per1_event_types": lambda s, d: peri.event_frames(flags(s, d)),
    "per2_window_frames": lambda s, d: tidy(fx.marks(s, d).select("session_id", "label", F.col("frame_idx").alias("event_frame")).withColumn("offset", F.explode(F.sequence(F.lit(-PRE), F.lit(POST)))).withColumn("t", F.col("offset") / F.lit(RATE)), "t"),
    "per3_trials": numbered,
    "per4_windows": lambda s, d: tidy(windows(s, d), "t", "dff"),
    "per5_trial_mean_sem": lambda s, d: tidy(peri.cell_mean(windows(s, d)), "mean", "sem"),
    "per6_population": lambda s, d: tidy(peri.population_mean(peri.cell_mean(windows(s, d))), "pop_mean", "pop_sem"),
    "auc1_sides": lambda s, d: tidy(stats.sides(windows(s, d)).select("session_id", "event_type", "trial", "cell_id", "offset", "side", "dff"), "dff"),
    "auc2_trapezoid": lambda s, d: tidy(stats.trapezoid(stats.sides(windows(s, d))), "pre", "post"),
    "auc3_by_cell": lambda s, d: tidy(stats.by_cell(auc(s, d)), "pre", "post"),
    "auc4_by_trial": lambda s, d: tidy(stats.by_trial(auc(s, d)), "pre", "post"),
    "auc5_enough_trials": lambda s, d: tidy(auc(s, d), "pre", "post"),
    "auc6_bars": lambda s, d: tidy(stats.bars(stats.by_trial(auc(s, d))), "mean_pre", "sem_pre", "mean_post", "sem_post"),
    "auc7_significant": lambda s, d: stats.significant_count(stats.paired_test(cell_pairs(s, d), ["session_id", "event_type", "cell_id"], "pre", "post"), ["session_id", "event_type"]),
    "sta1_signed_rank": lambda s, d: tidy(stats.signed_rank_p(cell_pairs(s, d), ["session_id", "event_type", "cell_id"], "pre", "post"), "p_rank"),
    "sta1_signed_rank_normal": lambda s, d: tidy(stats.signed_rank_p(cell_pairs(s, d), ["session_id", "event_type"], "pre", "post"), "p_rank"),
    "sta2_paired_t": lambda s, d: tidy(stats.paired_t_p(cell_pairs(s, d).withColumn("block", F.expr("(trial - 1) div 4")), ["session_id", "event_type", "cell_id", "block"], "pre", "post"), "p_t"),
    "sta3_test_choice": lambda s, d: tidy(stats.paired_test(cell_pairs(s, d), ["session_id", "event_type", "cell_id"], "pre", "post").drop("stars"), "p"),
    "sta4_stars": lambda s, d: stats.paired_test(cell_pairs(s, d), ["session_id", "event_type", "cell_id"], "pre", "post").drop("p", "n"),
    "bvl1_periods": lambda s, d: tidy(periods.in_periods(dff(s, d), RATE, PERIODS, check="drop"), "dff", "minutes"),
    "bvl1_empty_periods": lambda s, d: tidy(periods.empty_periods(fx.traces(s, d), RATE, (*PERIODS, ("last", 200.0, 260.0), ("beyond", 300.0, 360.0))), "seconds"),
    "bvl2_mean_peak": lambda s, d: tidy(periods.mean_and_peak(periods.in_periods(dff(s, d), RATE, PERIODS, check=None)), "mean", "peak"),
    "bvl3_threshold": lambda s, d: tidy(periods.thresholds(dff(s, d)), "threshold"),
    "bvl4_transients": lambda s, d: periods.transients(periods.in_periods(dff(s, d), RATE, PERIODS, check=None), periods.thresholds(dff(s, d))).drop("rate"),
    "bvl5_rate": lambda s, d: tidy(periods.transients(periods.in_periods(dff(s, d), RATE, PERIODS, check=None), periods.thresholds(dff(s, d))).drop("n"), "rate"),
    "bvl6_compare": lambda s, d: tidy(periods.compare(metrics(s, d)), "p"),
    "bvl7_bars": lambda s, d: tidy(periods.bars(metrics(s, d)), "mean_baseline", "sem_baseline", "mean_late", "sem_late", "bracket"),
}

_K = "session_id, event_type, cell_id"
#: 1 - erf(x) from the series of erf whose terms are all positive, for the normal tail beyond 15 ranks.
_ERFC = "1 - 2 / sqrt(pi()) * exp(-({0}) * ({0})) * list_sum(list_transform(range(0, 400), lambda i: exp((2 * i + 1) * ln({0}) + 2 * i * ln(2) + lgamma(i + 1.0) - lgamma(2.0 * i + 2))))"
_Z = "greatest(1e-9, abs((least(w_plus, w_minus) - nz * (nz + 1) / 4.0) / sqrt((nz * (nz + 1.0) * (2 * nz + 1) - tie_term / 2.0) / 24)))"
_TAIL = {"tl": f"SELECT session_id, event_type, cell_id, greatest(0.0, {_ERFC.format('x')}) AS p FROM (SELECT session_id, event_type, cell_id, least(10.0, {_Z} / sqrt(2)) AS x FROM ws WHERE nz > 15)", "pv": "SELECT * FROM ex UNION ALL SELECT * FROM tl"}
_ANY_T = "CASE WHEN n < 2 OR (s = 0 AND m = 0) THEN 'nan'::DOUBLE WHEN s = 0 THEN 0.0 WHEN n = 2 THEN 1 - 2 / pi() * atan(abs(m / (s / sqrt(n)))) WHEN n = 3 THEN 1 - abs(m / (s / sqrt(n))) / sqrt(2 + pow(m / (s / sqrt(n)), 2)) WHEN n = 4 THEN 1 - 2 / pi() * (atan(abs(m / (s / sqrt(n))) / sqrt(3)) + abs(m / (s / sqrt(n))) / sqrt(3) / (1 + pow(m / (s / sqrt(n)), 2) / 3)) END"
_STARS = "CASE WHEN p IS NULL OR isnan(p) THEN 'n.s.' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END"
_TESTED = {"tested": f"SELECT ts.session_id, ts.event_type, ts.cell_id, ts.n, CASE WHEN n >= 5 THEN 'signed-rank' ELSE 'paired t-test' END AS test, CASE WHEN n >= 5 THEN coalesce(pv.p, 1.0) ELSE {_ANY_T} END AS p FROM ts LEFT JOIN pv ON ts.session_id = pv.session_id AND ts.event_type = pv.event_type AND ts.cell_id = pv.cell_id"}


def q(body: str, **more: str) -> str:
    return fx.sql(body, VIEWS | more)


def tested(body: str, **more: str) -> str:
    return fx.sql(body, VIEWS | _TAIL | _TESTED | more)


_RANKED = "SELECT ts.session_id, ts.event_type, ts.cell_id, n, coalesce(p, 1.0) AS p FROM ts LEFT JOIN pv ON ts.session_id = pv.session_id AND ts.event_type = pv.event_type AND ts.cell_id = pv.cell_id"
_SORTED = {"srt": "SELECT session_id, list_sort(list(dff)) AS s FROM dff GROUP BY session_id", "clip": "SELECT * FROM dff WHERE frame_idx BETWEEN 20 AND 70", "csr": "SELECT session_id, cell_id, list_sort(list(dff)) AS s FROM clip GROUP BY ALL"}

ORACLES = {
    "trc2_delta_f": q(f"SELECT session_id, cell_id, frame_idx, {r('dff')} FROM dff"),
    "trc3_peak_ranking": q(f"SELECT session_id, cell_id, {r('peak')}, CAST(place AS INTEGER) AS place FROM (SELECT session_id, cell_id, max(dff) AS peak, row_number() OVER (PARTITION BY session_id ORDER BY max(dff) DESC, cell_id) AS place FROM dff GROUP BY session_id, cell_id) WHERE place <= 50"),
    "trc4_top_traces": q(f"SELECT session_id, cell_id, frame_idx, {r('dff')} FROM dff WHERE (session_id, cell_id) IN (SELECT (session_id, cell_id) FROM (SELECT session_id, cell_id, row_number() OVER (PARTITION BY session_id ORDER BY max(dff) DESC, cell_id) AS place FROM dff GROUP BY session_id, cell_id) WHERE place <= 3)"),
    "trc5_z_trace": q("SELECT session_id, cell_id, frame_idx, round((value - avg(value) OVER c) / greatest(stddev_samp(value) OVER c, 1e-10), 6) + 0.0 AS z FROM traces WINDOW c AS (PARTITION BY session_id, cell_id)"),
    "trc6_time_axis": q("SELECT session_id, cell_id, frame_idx, round((frame_idx - 1) / 4.605::DOUBLE, 6) + 0.0 AS sec FROM traces"),
    "trc7_stacked": q(f"SELECT d.session_id, d.cell_id, frame_idx, round(dff + (i - 1) * 1.2 * greatest({pct('s', 99)} - {pct('s', 1)}, 1.0), 6) + 0.0 AS y FROM dff d JOIN srt ON d.session_id = srt.session_id JOIN (SELECT session_id, cell_id, row_number() OVER (PARTITION BY session_id ORDER BY cell_id) AS i FROM (SELECT DISTINCT session_id, cell_id FROM dff)) o ON d.session_id = o.session_id AND d.cell_id = o.cell_id", **_SORTED),
    "trc9_heatmap": q("SELECT session_id, cell_id, count(*) AS n, round(sum(round(dff, 6)), 3) AS total, arg_min(round(dff, 6) + 0.0, frame_idx) AS \"first\", arg_max(round(dff, 6) + 0.0, frame_idx) AS \"last\" FROM dff GROUP BY session_id, cell_id"),
    "trc10_clip_normalise": q(f"SELECT c.session_id, c.cell_id, frame_idx, round(least(1.0, greatest(0.0, CASE WHEN hi > lo THEN (dff - lo) / (hi - lo) ELSE dff END)), 6) + 0.0 AS norm FROM clip c JOIN (SELECT session_id, cell_id, {pct('s', 5)} AS lo, {pct('s', 99)} AS hi FROM csr) l ON c.session_id = l.session_id AND c.cell_id = l.cell_id", **_SORTED),
    "trc11_population": q("SELECT session_id, frame_idx, round(avg(dff), 6) + 0.0 AS mean_dff FROM dff GROUP BY session_id, frame_idx"),
    "per1_event_types": q("SELECT * FROM ev"),
    "per2_window_frames": q(f"SELECT session_id, label, frame_idx AS event_frame, CAST(o AS INTEGER) AS \"offset\", round(o / 4.605::DOUBLE, 6) + 0.0 AS t FROM marks, range(-{PRE}, {POST + 1}) z(o)"),
    "per3_trials": q("SELECT session_id, event_type, event_frame, trial FROM tr"),
    "per4_windows": q(f"SELECT session_id, event_type, trial, event_frame, cell_id, \"offset\", {r('t', 'dff')} FROM pw"),
    "per5_trial_mean_sem": q(f"SELECT session_id, event_type, cell_id, \"offset\", {r('mean', 'sem')}, n_trials FROM pm"),
    "per6_population": q("SELECT session_id, event_type, \"offset\", round(avg(mean), 6) + 0.0 AS pop_mean, round(coalesce(stddev_samp(mean) / sqrt(count(mean)), 0.0), 6) + 0.0 AS pop_sem FROM pm GROUP BY session_id, event_type, \"offset\""),
    "auc1_sides": q(f"SELECT session_id, event_type, trial, cell_id, \"offset\", side, {r('dff')} FROM sd"),
    "auc2_trapezoid": q(f"SELECT session_id, event_type, trial, cell_id, {r('pre', 'post')} FROM tz"),
    "auc3_by_cell": q("SELECT session_id, event_type, cell_id, round(avg(pre), 6) + 0.0 AS pre, round(avg(post), 6) + 0.0 AS post, count(*) AS n FROM au GROUP BY session_id, event_type, cell_id"),
    "auc4_by_trial": q(f"SELECT session_id, event_type, trial, {r('pre', 'post')} FROM tt"),
    "auc5_enough_trials": q(f"SELECT session_id, event_type, trial, cell_id, {r('pre', 'post')} FROM au"),
    "auc6_bars": q("SELECT session_id, event_type, round(avg(pre), 6) + 0.0 AS mean_pre, round(coalesce(stddev_samp(pre) / sqrt(count(pre)), 0.0), 6) + 0.0 AS sem_pre, round(avg(post), 6) + 0.0 AS mean_post, round(coalesce(stddev_samp(post) / sqrt(count(post)), 0.0), 6) + 0.0 AS sem_post FROM tt GROUP BY session_id, event_type"),
    "auc7_significant": tested("SELECT session_id, event_type, count(*) FILTER (NOT isnan(p) AND p < 0.05) AS n_significant, count(*) AS n_tested FROM tested GROUP BY session_id, event_type"),
    "sta1_signed_rank": tested(f"SELECT {_K}, n, round(p, 6) + 0.0 AS p_rank FROM ranked", ranked=_RANKED),
    "sta1_signed_rank_normal": tested("SELECT session_id, event_type, n, round(p, 6) + 0.0 AS p_rank FROM ranked", ranked=_RANKED, pairs="SELECT session_id, event_type, 0 AS cell_id, trial, pre, post FROM au"),
    "sta2_paired_t": q(f"SELECT {_K}, block, n, round({_ANY_T}, 6) + 0.0 AS p_t FROM (SELECT {_K}, block, count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM (SELECT *, CAST((trial - 1) // 4 AS BIGINT) AS block, round(post - pre, 9) AS d FROM au) GROUP BY {_K}, block)"),
    "sta3_test_choice": tested(f"SELECT {_K}, n, test, {r('p')} FROM tested"),
    "sta4_stars": tested(f"SELECT {_K}, test, {_STARS} AS stars FROM tested"),
    "bvl1_periods": q(f"SELECT session_id, cell_id, frame_idx, {r('dff')}, period, round(minutes, 6)::DOUBLE + 0.0 AS minutes FROM sl WHERE session_id IN (SELECT session_id FROM sl GROUP BY session_id HAVING count(DISTINCT period) = 2)"),
    "bvl1_empty_periods": q("SELECT session_id, p AS period, round(max(frame_idx) / 4.605, 6) + 0.0 AS seconds FROM (SELECT session_id, frame_idx, (frame_idx - 1) / 4.605::DOUBLE AS sec FROM traces) t, (VALUES ('baseline', 0, 60), ('late', 120, 180), ('last', 200, 260), ('beyond', 300, 360)) v(p, a, b) GROUP BY session_id, p HAVING count(*) FILTER (sec >= a AND sec < b) = 0"),
    "bvl2_mean_peak": q(f"SELECT session_id, cell_id, period, {r('mean', 'peak')} FROM mp"),
    "bvl3_threshold": q(f"SELECT session_id, cell_id, {r('threshold')} FROM th"),
    "bvl4_transients": q("SELECT session_id, cell_id, period, n FROM tn"),
    "bvl5_rate": q("SELECT session_id, cell_id, period, round(rate::DOUBLE, 6) + 0.0 AS rate FROM tn"),
    "bvl7_bars": q("SELECT session_id, metric, round(avg(baseline), 6) + 0.0 AS mean_baseline, round(coalesce(stddev_samp(baseline) / sqrt(count(baseline)), 0.0), 6) + 0.0 AS sem_baseline, round(avg(late), 6) + 0.0 AS mean_late, round(coalesce(stddev_samp(late) / sqrt(count(late)), 0.0), 6) + 0.0 AS sem_late, round(1.2::DOUBLE * max(greatest(baseline, late)), 6) + 0.0 AS bracket FROM mw GROUP BY session_id, metric"),
}
_METRIC = {"dd": "SELECT session_id, metric AS event_type, 0 AS cell_id, round(late - baseline, 9) AS d FROM mw WHERE baseline IS NOT NULL AND late IS NOT NULL"}
ORACLES["bvl6_compare"] = fx.sql(f"SELECT session_id, event_type AS metric, n, test, {r('p')}, {_STARS} AS stars FROM tested", VIEWS | _METRIC | _TAIL | _TESTED)
