"""Small cases worked out by hand."""

import itertools
import math
import random
import re
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatrace.functions.columns import midpoint_percentile, percentiles_by, sem
from lumatrace.operators import align, cells, clocks, events, frames, periods, peri, stats, traces
from lumatrace.sources import scans, segments
from lumatrace.streaming import annotations

T0 = datetime(2024, 1, 1)


def trace(spark, values, cell=1):
    return spark.createDataFrame([("s", cell, i + 1, float(v)) for i, v in enumerate(values)], "session_id string, cell_id int, frame_idx int, value double")


def test_midpoint_percentile(spark):
    df = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]).alias("a"))
    assert df.select(midpoint_percentile(F.col("a"), 25)).first()[0] == 1.5
    assert percentiles_by(trace(spark, [4, 1, 3, 2]), ["session_id"], "value", {"p": 25}).first()["p"] == 1.5
    assert df.select(midpoint_percentile(F.array().cast("array<double>"), 25)).first()[0] is None


def test_sem_of_one_value_is_zero(spark):
    assert trace(spark, [5]).agg(sem("value")).first()[0] == 0.0


def test_intervals_cross_a_change_of_the_clock(spark):
    """Stamps have no zone: an hour that a session's zone leaves out or repeats changes nothing."""
    stamps = ["2024-03-31 01:59:59.500", "2024-03-31 02:30:00.000", "2024-03-31 03:00:00.500", "2024-10-27 02:30:00.000", "2024-10-27 03:00:00.000"]
    raw = spark.createDataFrame([("s", 1, i + 1, t) for i, t in enumerate(stamps)], "session_id string, cam_id int, frame_idx int, ref_time string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        found = [r.sec for r in clocks.since_first(clocks.camera_clock(raw)).orderBy("frame_idx").collect()]
        pulses = [str(r.t) for r in raw.select(clocks.parse_or_null(F.col("ref_time")).alias("t")).collect()]
        text = [r.t for r in spark.createDataFrame([("2024-13-01 00:00:00.000",), ("12:00",), (None,)], "s string").select(clocks.parse_or_null(F.col("s")).alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    real = [datetime.fromisoformat(t) for t in stamps]
    assert found == [(t - real[0]).total_seconds() for t in real]
    assert pulses == [str(t) for t in real] and text == [None] * 3


def test_frames_of_real_size(spark):
    """One session of 130 frames of 512 x 440: statistics, template and traces against numpy."""
    h, w, n = 512, 440, 130
    px = F.expr(f"transform(sequence(0, {h * w - 1}), p -> int((p * 7 + frame_idx * 31 * (p % 13 + 1)) % 4096))")
    movie = spark.range(1, n + 1, 1, 8).select(F.lit("s").alias("session_id"), F.col("id").cast("int").alias("frame_idx"), F.lit(h).alias("h"), F.lit(w).alias("w")).withColumn("pixels", px)
    p, f = np.arange(h * w), np.arange(1, n + 1)[:, None]
    real = (p * 7 + f * 31 * (p % 13 + 1)) % 4096
    found = frames.projections(movie).toPandas().sort_values(["y", "x"])
    assert np.allclose(found["mean"], real.mean(0)) and np.allclose(found["std"], real.std(0, ddof=1)) and (found["max"] == real.max(0)).all()
    got = frames.stable_template(movie, first=10, last=125, length=100, most=11).collect()
    scores = []
    for k in range(9, 20):
        block, mu = real[k : k + 100], real[k : k + 100].mean(0)
        scores.append(round(float(np.mean([((b * mu).mean() - b.mean() * mu.mean()) / (2.0**-52 + b.std(ddof=1) * mu.std(ddof=1)) for b in block])), 9))
    assert [(r.start, r.score) for r in got] == [(int(np.argmax(scores)) + 1, pytest.approx(max(scores), abs=1e-8))]
    assert (got[0].h, got[0].w) == (h, w) and np.allclose(got[0].pixels, real[8 + got[0].start : 108 + got[0].start].mean(0))
    z = frames.z_score(movie).filter("frame_idx = 77").first().pixels
    assert np.allclose(z, (real[76] - real.mean(0)) / np.where(real.std(0, ddof=1) < 1e-6, 1, real.std(0, ddof=1)))
    shape = [("s", c, y, x, float(c + y % 3)) for c in (1, 2, 3) for y in range(40 * c, 40 * c + 20) for x in range(100, 115)] + [("s", 4, 600, 3, 1.0)]
    traced = traces.project_footprints(movie, spark.createDataFrame(shape, "session_id string, cell_id int, y int, x int, weight double"))
    values = {(r.cell_id, r.frame_idx): r.value for r in traced.collect()}
    want = {(c, k + 1): sum(real[k, (y - 1) * w + x - 1] * v for _, cc, y, x, v in shape if cc == c) for c in (1, 2, 3) for k in (0, 77, 129)}
    assert len(values) == 3 * n and all(values[k] == pytest.approx(v) for k, v in want.items())


def test_normal_tail_and_rank_sums(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 3.5, 6.0, 12.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double").select(stats.normal_two_sided("z").alias("p")).collect()]
    assert got[:-1] == [pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12) for z in zs] and got[-1] is None
    ranks = (2, 5, 5, 8)
    assert [stats.ways(ranks, m) for m in range(21)] == [sum(sum(r for r, b in zip(ranks, bits) if b) <= m for bits in itertools.product((0, 1), repeat=4)) for m in range(21)]


def test_null_pixels(spark):
    """Frames without pixels take no part in sums and stay null where each frame gives one; a null pixel is NaN."""
    schema = "session_id string, frame_idx int, h int, w int, pixels array<int>"
    movie = spark.createDataFrame([("s", 1, 1, 2, [1, 4]), ("s", 2, 1, 2, None), ("s", 3, 1, 2, [3, 8]), ("n", 1, 1, 2, None)], schema)
    assert [(r.x, r["mean"], r["max"]) for r in frames.projections(movie).orderBy("x").collect()] == [(1, 2.0, 3), (2, 6.0, 8)]
    z = {r.frame_idx: r.pixels for r in frames.z_score(movie).filter("session_id = 's'").collect()}
    assert z[2] is None and z[1] == pytest.approx([-math.sqrt(0.5)] * 2) and z[3] == pytest.approx([math.sqrt(0.5)] * 2)
    smooth = {(r.session_id, r.frame_idx): r.pixels for r in frames.smooth(movie).collect()}
    assert smooth["s", 2] is None and smooth["n", 1] is None and len(smooth["s", 1]) == 2
    found = frames.stable_template(movie, 1, 9, 2, 5).collect()
    assert [(r.session_id, r.start, r.h, r.w, r.pixels) for r in found] == [("s", 1, 1, 2, [2.0, 6.0])]
    assert frames.stable_template(movie, 1, 9, 3, 5).count() == 0
    feet = spark.createDataFrame([("s", 7, 1, 1, 2.0), ("s", 7, 1, 2, 0.5), ("s", 9, 1, 2, 1.0)], "session_id string, cell_id int, y int, x int, weight double")
    assert {(r.cell_id, r.frame_idx, r.value) for r in traces.project_footprints(movie, feet).collect()} == {(7, 1, 4.0), (9, 1, 4.0), (7, 3, 10.0), (9, 3, 8.0)}
    holes = spark.createDataFrame([("s", 1, 1, 2, [None, 4])], schema)
    assert {(r.cell_id, r.value) for r in traces.project_footprints(holes, feet).collect()} == {(7, 2.0), (9, 4.0)}
    assert frames.z_score(movie.limit(0)).count() == 0 and traces.project_footprints(movie.limit(0), feet).count() == 0


def test_sessions_in_blocks(spark, monkeypatch):
    """What belongs to a session goes to all tasks in blocks of bounded size; no frame is shuffled."""
    from lumatrace.plans import fixtures as fx

    d = "/root/testdata/sf0.1"
    movie, feet = fx.frames(spark, d), fx.footprints(spark, d)
    pixel = lambda df: sorted((r.session_id, r.frame_idx, round(sum(r.pixels), 6)) for r in df.collect())
    value = lambda df: sorted((r.session_id, r.cell_id, r.frame_idx, round(r.value, 6)) for r in df.collect())
    whole = pixel(frames.z_score(movie)), value(traces.project_footprints(movie, feet))
    plan = traces.project_footprints(movie, feet)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert "Exchange" not in frames.z_score(movie)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(frames.beside, "__defaults__", (2000,))
    assert (pixel(frames.z_score(movie)), value(traces.project_footprints(movie, feet))) == whole


def test_silent_cells(spark):
    nan = float("nan")
    both = trace(spark, [nan, nan]).union(trace(spark, [nan, 1.0], 2))
    assert {r.cell_id for r in cells.drop_silent(both, both).collect()} == {2}


def test_peak_skips_nan_and_ties_go_to_the_lower_cell(spark):
    dff = trace(spark, [1, float("nan")], 2).union(trace(spark, [1, 0], 1)).withColumnRenamed("value", "dff")
    assert [(r.cell_id, r.place) for r in traces.peak_ranking(dff).orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_nearest_frame_ties_and_tolerance(spark):
    clock = spark.createDataFrame([("s", i + 1, T0 + timedelta(seconds=2 * i)) for i in range(4)], "session_id string, frame_idx int, ts timestamp_ntz")
    at = {"tie": 1.0, "edge": 8.0, "beyond": 8.5, "before": -2.0, "on": 4.0}
    marks = spark.createDataFrame([("s", k, T0 + timedelta(seconds=v)) for k, v in at.items()], "session_id string, label string, ts timestamp_ntz")
    found = {r.label: r.neuron_frame for r in align.nearest_frame(marks, clock, 0.5).collect()}
    assert found == {"tie": 1, "edge": 4, "before": 1, "on": 3}


def test_nearest_frame_against_brute_force(spark):
    rnd = random.Random(5)
    ticks = [(i + 1, T0 + timedelta(milliseconds=rnd.randrange(100_000))) for i in range(300)]
    marks = [(i, T0 + timedelta(milliseconds=rnd.randrange(-2000, 102_000))) for i in range(200)]
    clock = spark.createDataFrame([("s", *t) for t in ticks], "session_id string, frame_idx int, ts timestamp_ntz")
    df = spark.createDataFrame([("s", *m) for m in marks], "session_id string, n int, ts timestamp_ntz")
    expected = {}
    for n, t in marks:
        gap, frame = min((abs((x - t).total_seconds()), f) for f, x in ticks)
        if gap <= 1.0:
            expected[n] = frame
    assert {r.n: r.neuron_frame for r in align.nearest_frame(df, clock, 1.0).collect()} == expected


def test_a_long_session_is_aligned_in_stretches(spark):
    """One session of many stretches, with gaps in its clock: the same as every event against every tick."""
    rnd = random.Random(8)
    ticks = sorted({rnd.randrange(4_000_000) * (1 if i % 3 else 50) for i in range(3000)})
    marks = [rnd.randrange(-5_000, 210_000_000) for _ in range(500)] + [rnd.choice(ticks) + rnd.choice((-1000, 0, 999, 1000, 1001)) for _ in range(1500)]
    at = lambda us: T0 + timedelta(microseconds=us)
    clock = spark.createDataFrame([("s", i + 1, at(t)) for i, t in enumerate(ticks)], "session_id string, frame_idx int, ts timestamp_ntz")
    df = spark.createDataFrame([("s", n, at(t)) for n, t in enumerate(marks)] + [("s", -1, None)], "session_id string, n int, ts timestamp_ntz")
    apart = np.abs(np.array(marks)[:, None] - np.array(ticks)[None, :])
    want = {n: int(row.argmin()) + 1 for n, row in enumerate(apart) if row.min() <= 1000}
    found = align.nearest_frame(df, clock, 1000.0)
    assert {r.n: r.neuron_frame for r in found.collect()} == want and 0 < len(want) < len(marks)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and all("stretch" in by for by in dealt)


def test_odd_frame_count(spark):
    movie = spark.createDataFrame([("s", i, 1, 2, [i, 10 - i]) for i in range(1, 6)], "session_id string, frame_idx int, h int, w int, pixels array<int>")
    assert [(r.frame_idx, r.pixels) for r in frames.pair_maximum(movie).orderBy("frame_idx").collect()] == [(1, [2, 9]), (2, [4, 7])]
    raw = spark.createDataFrame([("s", i, "1", "2024-01-01 00:00:0%d.000" % i) for i in range(1, 6)], "session_id string, raw_idx int, slice string, time string")
    clock = clocks.microscope_clock(raw)
    assert clock.count() == 3
    cut, _ = align.reconcile(clock, spark.createDataFrame([("s", 1), ("s", 2)], "session_id string, frame_idx int"))
    assert cut.count() == 2


def test_bad_stamp_is_an_error_but_not_for_pulses(spark):
    bad = spark.createDataFrame([("s", 1, "1", "yesterday")], "session_id string, raw_idx int, slice string, time string")
    with pytest.raises(Exception, match="yesterday|CANNOT_PARSE"):
        clocks.microscope_clock(bad).collect()
    good, warned = scans.scan_pulses({"a": bad.select(F.lit(1).alias("pulse_idx"), F.col("time").alias("TIME"))})
    assert good.count() == 0 and [r.source for r in warned.collect()] == ["a"]


def test_transients(spark):
    dff = trace(spark, [5, 5, 0, 0, 5, 0, 0, 0, 0]).withColumnRenamed("value", "dff")
    sliced = periods.in_periods(dff, 1.0, (("a", 0, 9),))
    assert periods.transients(sliced, periods.thresholds(dff)).first()["n"] == 2  # one at the first frame
    flat = trace(spark, [3, 3, 3]).withColumnRenamed("value", "dff")
    assert periods.transients(periods.in_periods(flat, 1.0, (("a", 0, 3),)), periods.thresholds(flat)).first()["n"] == 0


def test_an_empty_period_of_one_session_is_an_error(spark):
    """A long session doesn't hide a short one; nothing runs before the action."""
    long = trace(spark, range(300)).withColumnRenamed("value", "dff")
    both = long.union(spark.createDataFrame([("short", 1, 1, 1.0), ("short", 1, 2, 2.0)], long.schema))
    spans = (("a", 0, 2), ("late", 100, 200))
    assert periods.in_periods(long, 1.0, spans).count() == 102
    checked = periods.in_periods(both, 1.0, spans)
    with pytest.raises(Exception, match="no frames in late; the recording of short has 2.0 s"):
        checked.collect()
    assert {(r.session_id, r.period, r.seconds) for r in periods.empty_periods(both, 1.0, spans).collect()} == {("short", "late", 2.0)}
    assert {r.session_id for r in periods.in_periods(both, 1.0, spans, check="drop").collect()} == {"s"}
    assert {(r.session_id, r.period) for r in periods.in_periods(both, 1.0, spans, check=None).collect()} == {("s", "a"), ("s", "late"), ("short", "a")}
    assert periods.in_periods(both.limit(0), 1.0, spans).count() == 0


def pairs(spark, groups):
    return spark.createDataFrame([(g, float(a), float(b)) for g, ds in groups.items() for a, b in ds], "g string, a double, b double")


def test_signed_rank_against_enumeration(spark):
    rnd = random.Random(2)
    groups = {f"n{n}": [(0, rnd.choice([-2, -1, 0, 1, 2, 3])) for _ in range(n)] for n in (5, 6, 9, 12)}
    groups["zeros"] = [(1, 1)] * 6
    got = {r.g: r.p_rank for r in stats.signed_rank_p(pairs(spark, groups), ["g"], "a", "b").collect()}
    for name, ds in groups.items():
        d = [b - a for a, b in ds if b != a]
        if not d:
            assert got[name] == 1.0
            continue
        ranks = [sum(abs(x) < abs(v) for x in d) + (sum(abs(x) == abs(v) for x in d) + 1) / 2 for v in d]
        w = min(sum(r for r, v in zip(ranks, d) if v > 0), sum(r for r, v in zip(ranks, d) if v < 0))
        below = sum(sum(r for r, s in zip(ranks, signs) if s) <= w for signs in itertools.product((0, 1), repeat=len(d)))
        assert got[name] == pytest.approx(min(1.0, 2 * below / 2 ** len(d)))


def test_signed_rank_normal_branch(spark):
    ds = [(0, i + 1 if i % 3 else -i - 1) for i in range(16)]
    p = stats.signed_rank_p(pairs(spark, {"x": ds}), ["g"], "a", "b").first()["p_rank"]
    minus = sum(i + 1 for i in range(16) if i % 3 == 0)
    z = (min(minus, 136 - minus) - 68) / math.sqrt(16 * 17 * 33 / 24)
    assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_paired_t_closed_forms(spark):
    got = {r.g: r.p_t for r in stats.paired_t_p(pairs(spark, {"n2": [(0, 1), (0, 3)], "n3": [(0, 1), (0, 2), (0, 6)], "n4": [(0, 1), (0, 2), (0, 3), (0, 9)], "one": [(0, 1)], "same": [(0, 2), (0, 2)], "none": [(1, 1), (2, 2)]}), ["g"], "a", "b").collect()}

    def density_tail(t, df):  # numeric integration of the t density
        c = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
        steps, h = 20000, t / 20000
        area = sum((4 if k % 2 else 2) * (1 + (k * h) ** 2 / df) ** (-(df + 1) / 2) for k in range(1, steps))
        return 1 - 2 * c * h / 3 * (1 + area + (1 + t * t / df) ** (-(df + 1) / 2))

    for name, d in (("n2", [1, 3]), ("n3", [1, 2, 6]), ("n4", [1, 2, 3, 9])):
        n, m = len(d), sum(d) / len(d)
        s = math.sqrt(sum((x - m) ** 2 for x in d) / (n - 1))
        assert got[name] == pytest.approx(density_tail(m / (s / math.sqrt(n)), n - 1), abs=1e-6)
    assert math.isnan(got["one"]) and got["same"] == 0.0 and math.isnan(got["none"])


def test_stars(spark):
    ps = [0.0001, 0.005, 0.03, 0.05, float("nan"), None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    assert [r.s for r in df.orderBy("i").select(stats.stars(F.col("p")).alias("s")).collect()] == ["***", "**", "*", "n.s.", "n.s.", "n.s."]


def test_area_of_a_constant(spark):
    rows = [("s", "e", 1, 1, i / 4.0, 3.0) for i in range(5)]
    df = spark.createDataFrame(rows, "session_id string, event_type string, trial int, cell_id int, t double, dff double").withColumn("side", F.lit("post"))
    assert stats.trapezoid(df).first()["post"] == pytest.approx(3.0 * 4 / 4)


def test_peri_rows(spark):
    dff = trace(spark, range(100)).withColumnRenamed("value", "dff")
    marks = spark.createDataFrame([("s", "Soft_touch", f) for f in (5, 14, 15, 40, 77, 78)], "session_id string, event_type string, frame_idx int")
    lengths = spark.createDataFrame([("s", 100)], "session_id string, n_frames int")
    trials = peri.trials(marks, lengths)
    assert [r.event_frame for r in trials.orderBy("trial").collect()] == [15, 40, 77]
    assert peri.peri_event(dff, trials).count() == 3 * 38


LOG = [(1, "a", 5), (2, "a", 5), (3, "s", 5), (4, "x", 0), (5, "x", 0), (6, "x", 0), (7, "a", 7)]


def log(spark, rows):
    return spark.createDataFrame([("s", 1, *r) for r in rows], "session_id string, cam_id int, seq long, key string, frame_idx int")


def test_undo(spark):
    assert [(r.frame_idx, r.label) for r in events.replay(log(spark, LOG)).collect()] == [(7, "Soft_touch")]
    saved = spark.createDataFrame([("s", 1, 1, 2, "Thermo_pain")], "session_id string, cam_id int, seq long, frame_idx int, label string")
    assert events.replay(log(spark, [(9, "x", 0)]), saved).count() == 0


def streamed(spark, tmp_path, batches, seconds=None, **more):
    """What the stream writes for batches of the log, one file each; ``seconds``: stop after these, else when all is read."""
    for k, rows in enumerate(batches):
        log(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    stream = spark.readStream.schema(log(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        trigger = {"processingTime": "1 second"} if seconds else {}
        query = annotations.write(annotations.replay_stream(stream, **more), str(tmp_path / "out"), str(tmp_path / "cp"), **trigger)
        assert query.awaitTermination(seconds or 120) or seconds
        query.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    return spark.read.schema(annotations.OUT).parquet(str(tmp_path / "out"))


def standing(df):
    return sorted((r.frame_idx, r.label, r.seq) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, random.Random(i).choice("aasdfxx"), random.Random(i * 7).randrange(6)) for i in range(60)]
    updates = streamed(spark, tmp_path, [rows[k : k + 20] for k in range(0, 60, 20)])
    assert annotations.late(updates).count() == 0 and updates.filter("kind = 'version'").count() == 3
    assert standing(annotations.latest(updates)) == standing(events.replay(log(spark, rows)))


def test_late_commands_are_a_table(spark, tmp_path):
    """What comes after a later command was applied changes nothing and is listed; a saved event stands first; undo may leave nothing."""
    saved = spark.createDataFrame([("s", 1, 1, 2, "Thermo_pain")], "session_id string, cam_id int, seq long, frame_idx int, label string")
    batches = [[(10, "a", 5), (12, "s", 6)], [(11, "x", 0), (12, "d", 7), (13, "x", 0), (14, "x", 0), (15, "x", 0)]]
    updates = streamed(spark, tmp_path, batches, saved=saved)
    assert [(r.seq, r.label, r.version) for r in annotations.late(updates).orderBy("seq").collect()] == [(11, events.UNDO, 12), (12, "Mechanic_pain", 12)]
    assert annotations.latest(updates).count() == 0
    in_time = [r for batch in batches for r in batch if r not in [(11, "x", 0), (12, "d", 7)]]
    assert standing(annotations.latest(updates)) == standing(events.replay(log(spark, in_time), saved))


def test_a_log_is_forgotten_after_its_time(spark, tmp_path):
    """With one millisecond the second batch starts anew: its undo finds nothing of the first."""
    updates = streamed(spark, tmp_path, [[(1, "a", 5), (2, "s", 6)], [(3, "x", 0), (4, "d", 7)]], seconds=20, ttl_ms=1)
    assert standing(annotations.latest(updates)) == [(7, "Mechanic_pain", 4)]


def test_segment_names(spark):
    df = spark.createDataFrame([("s", n, 3) for n in ("f 10.tif", "f 2.tif", "x.tif", "a1b2.tif")], "session_id string, segment_name string, n_frames int")
    order = lambda rule: [r.segment_name for r in segments.ordered(df, rule).orderBy("ord").collect()]
    assert order("natural") == ["x.tif", "a1b2.tif", "f 2.tif", "f 10.tif"]
    assert order("digits") == ["x.tif", "f 2.tif", "f 10.tif", "a1b2.tif"]
    assert order("name") == ["a1b2.tif", "f 10.tif", "f 2.tif", "x.tif"]


def test_pick_of_folders(spark):
    rows = [("a", "cam", "x_index.tif"), ("a", "cam", "2.tiff"), ("a", "cam", "1.tiff"), ("a", "", "0.tif"), ("b", "cam", "x_index.tif"), ("b", None, "3.tif"), ("b", "old", "1.tif"), ("c", "old", "1.tif")]
    files = spark.createDataFrame(rows, "session_id string, folder string, segment_name string")
    found = {(r.session_id, r.segment_name, r.first) for r in segments.pick(files, nested="cam").collect()}
    assert found == {("a", "1.tiff", True), ("a", "2.tiff", False), ("b", "3.tif", True)}
    assert {r.segment_name for r in segments.pick(files).filter("first").collect()} == {"0.tif", "1.tif"}


def test_first_source_with_a_time(spark):
    stamp, schema = "2024-01-01 00:00:00.000", "session_id string, n int, {} string"
    none = spark.createDataFrame([("a", 1, stamp)], schema.format("Timer"))
    second = spark.createDataFrame([("a", 1, stamp)], schema.format("TIME"))
    third = spark.createDataFrame([("a", 5, "unused and bad"), ("b", 2, stamp)], schema.format("Time"))
    found = scans.scan_first_clock([none, second, third], "microscope", "n")
    assert {(r.session_id, r.frame_idx, r.source) for r in found.collect()} == {("a", 1, 1), ("b", 2, 2)}
    with pytest.raises(ValueError, match="Timer"):
        scans.scan_first_clock([none], "camera1", "n")
    with pytest.raises(Exception, match="bad|CANNOT_PARSE"):
        scans.scan_first_clock([third], "microscope", "n").collect()


def test_torn_pulse_files(spark, tmp_path):
    """A torn file, one of another format and an empty one are warnings; bad rows are counted; column names in any case."""
    stamps = [f"2024-01-01 00:00:0{i}.000" for i in range(5)]
    schema = "pulse_idx long, {} string"
    tables = {"good": ("Time", stamps), "part": ("TIME", [*stamps[:3], "n/a", None]), "none": ("time", ["x", "y"]), "torn": ("Time", stamps), "empty": ("Time", [])}
    for name, (column, values) in tables.items():
        spark.createDataFrame(list(enumerate(values)), schema.format(column)).coalesce(1).write.parquet(str(tmp_path / name))
        [file] = [f for f in (tmp_path / name).iterdir() if f.suffix == ".parquet"]
        file.rename(tmp_path / f"{name}.parquet")
    whole = (tmp_path / "torn.parquet").read_bytes()
    (tmp_path / "torn.parquet").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "text.parquet").write_text("Time\n2024")
    good, warned = scans.scan_pulse_files(spark, str(tmp_path / "*.parquet"))
    assert {(r.source, r.n) for r in good.groupBy("source").agg(F.count("ts").alias("n")).collect()} == {("good.parquet", 5), ("part.parquet", 3)}
    assert {(r.source.split(".")[0], r.warning, r.n) for r in warned.collect()} == {("part", "bad stamp", 2), ("none", "no readable stamp", 2), ("torn", "unreadable", 0), ("text", "unreadable", 0), ("empty", "unreadable", 0)}


def test_inventory_of_outputs(spark, tmp_path):
    from lumatrace.operators import validate

    scans.save_results({"a": trace(spark, range(7)), "empty": trace(spark, [1]).limit(0)}, str(tmp_path), by=None)
    (tmp_path / "hollow").mkdir()
    found = {r.output: (r.status, r.rows, r.columns) for r in validate.output_inventory(spark, str(tmp_path), ("a", "empty", "hollow", "none")).collect()}
    names = "session_id,cell_id,frame_idx,value"
    assert found == {"a": ("present", 7, names), "empty": ("present", 0, names), "hollow": ("pending", 0, ""), "none": ("pending", 0, "")}
    assert {r.status for r in validate.output_inventory(spark, str(tmp_path / "no"), ("a",)).collect()} == {"pending"}


def test_metadata_has_its_time(spark):
    flagged = spark.createDataFrame([("s", 1, *[True] * 6)], "session_id string, frame_idx int, " + ", ".join(f"{f} boolean" for f in align.FLAGS))
    row = align.metadata(flagged, trace(spark, [1]), 4.6).first()
    assert abs((datetime.now() - row.created).total_seconds()) < 3600 * 26 and row.n_cells == 1


def discs(spark):
    """Sixteen discs of known centre and radius on a 64 x 64 field."""
    rows = []
    for k in range(16):
        cy, cx, radius = 10 + 12 * (k // 4), 10 + 12 * (k % 4), 2 + k % 3
        rows += [("s", k + 1, y, x, 1.0) for y in range(1, 65) for x in range(1, 65) if (y - cy) ** 2 + (x - cx) ** 2 <= radius**2]
    return spark.createDataFrame(rows, "session_id string, cell_id int, y int, x int, weight double")


def test_discs(spark):
    parts = cells.largest_component(cells.mask(discs(spark)))
    found = {r.cell_id: r for r in cells.region_properties(parts).collect()}
    for k in range(16):
        r, radius = found[k + 1], 2 + k % 3
        area = sum(y * y + x * x <= radius**2 for y in range(-4, 5) for x in range(-4, 5))
        assert (r.area, r.row, r.col) == (area, 10 + 12 * (k // 4), 10 + 12 * (k % 4)) and r.eccentricity == pytest.approx(0, abs=1e-6)
    inside = cells.inside_field(cells.region_properties(parts), 64, 64, 12)
    assert {r.cell_id for r in inside.collect()} == {6, 7, 8, 10, 11, 12, 14, 15, 16}


def test_component_solidity_and_contour(spark):
    square = [("s", 1, y, x, 1.0) for y in range(3, 8) for x in range(3, 9)]
    u = [("s", 2, y, x, 1.0) for y in range(1, 7) for x in range(1, 7) if x in (1, 6) or y == 6]
    split = [("s", 3, y, x, 1.0) for y, x in ((1, 5), (1, 6), (9, 1), (9, 2), (20, 20))]
    df = spark.createDataFrame(square + u + split, "session_id string, cell_id int, y int, x int, weight double")
    parts = cells.largest_component(cells.mask(df))
    assert sorted((r.y, r.x) for r in parts.filter("cell_id = 3").collect()) == [(9, 1), (9, 2)]  # ties go by column
    solid = {r.cell_id: r.solidity for r in cells.solidity(parts).collect()}
    assert solid[1] == 1.0 and solid[2] < 1.0
    line = {(r.y, r.x) for r in cells.contours(df.filter("cell_id = 1"), 64, 64).collect()}
    edge = {(y, x) for y in range(3, 8) for x in range(3, 9) if y in (3, 7) or x in (3, 8)}
    assert line == {(y + a, x + b) for y, x in edge for a in (-1, 0, 1) for b in (-1, 0, 1)}


def test_components_against_a_flood(spark):
    """Random masks of many cells, all in one batch, against a flood fill of each."""
    rnd = random.Random(4)
    masks = {c: {(rnd.randrange(-2, 12), rnd.randrange(9)) for _ in range(rnd.choice((1, 8, 30, 60)))} for c in range(60)}

    def largest(px):
        left, best = sorted(px, key=lambda p: (p[1], p[0])), set()
        while left:
            part, todo = {left[0]}, [left[0]]
            while todo:
                y, x = todo.pop()
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & px - part
                part |= near
                todo += near
            left = [p for p in left if p not in part]
            best = max(best, part, key=len)
        return best

    df = spark.createDataFrame([("s", c, y, x) for c, px in masks.items() for y, x in px] * 2, "session_id string, cell_id int, y int, x int")
    found = {}
    for r in cells.largest_component(df.coalesce(1)).collect():
        found.setdefault(r.cell_id, []).append((r.y, r.x))
    assert {c: set(px) for c, px in found.items()} == {c: largest(px) for c, px in masks.items()} and all(len(px) == len(set(px)) for px in found.values())


def test_keep_rule(spark):
    assert cells.least_area() == 41
    table = spark.createDataFrame([("s", c, a, 0.5, 0.9, 0.1) for c, a in ((3, 50), (5, 40), (7, 41))], "session_id string, cell_id int, area long, eccentricity double, solidity double, peak double")
    assert [(r.cell_id, r.new_id) for r in cells.keep(table).orderBy("new_id").collect()] == [(3, 1), (7, 2)]


def test_optional_and_mandatory_input(spark, tmp_path):
    assert scans.optional_table(spark, str(tmp_path / "no"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        scans.optional_table(spark, str(tmp_path / "no"), "a int", mandatory=True)
    assert scans.camera_column(["Frame", "Ref Time", "Time"]) == "Ref Time" and scans.microscope_column(["time"]) == "time"
    with pytest.raises(ValueError):
        scans.microscope_column(["x"])


def test_overwrite_keeps_other_sessions(spark, tmp_path):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, v int")
    scans.save_results({"t": one}, str(tmp_path))
    scans.save_results({"t": one.filter("session_id = 'a'").withColumn("v", F.lit(9))}, str(tmp_path))
    assert {(r.session_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}


def test_whole_queries_against_brute_force(spark):
    """Every frame is smoothed and every camera frame is asked, not the parts that the DuckDB forms fix."""
    from lumatrace.plans import catalog
    from lumatrace.plans import fixtures as fx

    d, near, weights = "/root/testdata/sf0.001", lambda i: max(0, min(7, i)), frames.kernel(1.0)
    reach, expected = len(weights) // 2, {}
    for f in fx.frames(spark, d).collect():
        px = [[sum(w * f.pixels[y * 8 + near(x + k - reach)] for k, w in enumerate(weights)) for x in range(8)] for y in range(8)]
        expected |= {(f.session_id, f.frame_idx, y * 8 + x): sum(w * px[near(y + k - reach)][x] for k, w in enumerate(weights)) for y in range(8) for x in range(8)}
    got = {(r.session_id, r.frame_idx, r["at"]): r.v for r in catalog.queries()["frm7_smooth_whole"](spark, d).collect()}
    assert max(k[1] for k in got) > 40 and got == pytest.approx(expected, abs=1e-5)
    asked = [(r.session_id, r.cam_id, r.frame_idx) for r in fx.camera_clock(spark, d).collect()]
    events = fx.scored(spark, d).collect()
    near = [(e.session_id, e.cam_id, e.frame_idx, at, e.label) for e in events for s, c, at in asked if (s, c) == (e.session_id, e.cam_id) and abs(e.frame_idx - at) < 3]
    rows = catalog.queries()["evt6_near_frame_whole"](spark, d).select("session_id", "cam_id", "frame_idx", "at", "label").collect()
    assert any(r["at"] % 50 for r in rows) and sorted(map(tuple, rows)) == sorted(near)
