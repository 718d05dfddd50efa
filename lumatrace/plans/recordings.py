"""Queries over segments, clocks, events and their alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumatrace.operators import align, clocks, events
from lumatrace.plans import fixtures as fx
from lumatrace.plans.traces import VIEWS as TRACE_VIEWS
from lumatrace.plans.traces import dff, r, tidy
from lumatrace.session import shared_dir
from lumatrace.sources import scans, segments
from lumatrace.operators import traces

#: Frames a second of the derived microscope clock, whose stamps are 10 events apart.
RATE = 4.605


def microscope(s, d):
    return clocks.microscope_clock(fx.clock_raw(s, d))


def cameras(s, d):
    return clocks.camera_clock(fx.camera_clock(s, d))


def camera_times(s, d):
    return fx.camera_clock(s, d).select("session_id", "cam_id", "frame_idx", clocks.parse(F.col("ref_time")).alias("ts"))


def measured_rate(s, d):
    """One frame in 100 s or more: the tolerance of the derived clock, whatever its spacing."""
    return 0.01


def mapped(s, d):
    return align.nearest_frame(fx.scored(s, d), microscope(s, d).select("session_id", "ts", "frame_idx"), measured_rate(s, d))


def long_marks(s, d):
    return align.legacy_labels(mapped(s, d)).select("session_id", F.col("neuron_frame").alias("frame_idx"), "label")


def frame_list(s, d):
    return microscope(s, d).select("session_id", "frame_idx")


def flagged(s, d):
    return align.any_event(align.one_hot(frame_list(s, d), long_marks(s, d)))


def lengths(s, d):
    return fx.traces(s, d).groupBy("session_id").agg(F.max("frame_idx").alias("n_frames"))


def marks_with_seq(s, d):
    return fx.scored(s, d).withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")))


def concatenated(s, d):
    return segments.concatenated(segments.ordered(fx.segments(s, d)))


def round_trip(s, df):
    """Write to the shared folder as a session-partitioned table, and read it again."""
    folder = f"{shared_dir(s)}/results-{uuid.uuid4().hex}"
    scans.save_results({"result": df}, folder)
    return s.read.schema(df.schema).parquet(f"{folder}/result").select(df.columns)


def checkpoint_twice(s, d):
    """The second call reads what the first wrote."""
    path = f"{shared_dir(s)}/frames-{uuid.uuid4().hex}"
    scans.reuse_or_compute(s, path, lambda: fx.frames(s, d))
    return scans.reuse_or_compute(s, path, lambda: fx.frames(s, d).limit(0)).select("session_id", "frame_idx", "h", "w", F.aggregate("pixels", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


def pulses(s, d):
    """Pulses and warnings of files: a good one, one with bad stamps, one of which every other stamp is bad, and one that is no Parquet file."""
    raw = fx.clock_raw(s, d).select(F.col("raw_idx").cast("long").alias("pulse_idx"), F.col("time").alias("TIME"), "slice")
    some = F.when(F.col("slice") == "1", F.col("TIME")).otherwise("n/a")
    folder = f"{shared_dir(s)}/pulses-{uuid.uuid4().hex}"
    for name, df in {"good": raw, "bad": raw.withColumn("TIME", F.lit("n/a")), "mixed": raw.withColumn("TIME", some)}.items():
        df.drop("slice").write.parquet(f"{folder}/{name}")
    raw.limit(10).select("TIME").write.text(f"{folder}/torn")  # ten lines of text in a Parquet file's place
    good, warned = scans.scan_pulse_files(s, f"{folder}/*/part-*", F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1))
    every = good.select("source", F.lit("").alias("warning"), F.lit(1).alias("k")).union(warned.select("source", "warning", "n"))
    return every.groupBy("source", "warning").agg(F.sum("k").alias("n"))


def optional(s, d):
    """Camera flags with the second camera's events missing: the table isn't there, so its flags are all false."""
    none = scans.optional_table(s, f"{d}/no_such_events.parquet", "session_id string, frame_idx int, label string")
    one = fx.marks(s, d).filter(F.col("label").isin(*align.FLAGS[:4]))
    return align.one_hot(fx.traces(s, d).select("session_id", "frame_idx").distinct(), one.unionByName(none))


def resolved(s, d):
    """Camera 1 by three sources: the first has no time, the second only even sessions, the third stamps that are an hour off."""
    cam = fx.camera_clock(s, d).filter("cam_id = 1").select("session_id", F.col("frame_idx").alias("n"), F.col("ref_time").alias("stamp"))
    late = F.date_format(clocks.parse(F.col("stamp")) + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss.SSS")
    second = cam.filter(F.substring("session_id", 2, 20).cast("long") % 2 == 0).select("session_id", "n", F.lit("x").alias("Time"), F.col("stamp").alias("Ref Time (abs)"))
    return scans.scan_first_clock([cam.withColumnRenamed("stamp", "Other"), second, cam.select("session_id", "n", late.alias("TIME"))], "camera1", "n")


def named_files(s, d):
    """Segments of which some are index files or of the second pattern, some in folder ``cam`` and some in another."""
    name = "CASE WHEN n_frames % 3 = 0 THEN replace(segment_name, '.tif', '_index.tif') WHEN n_frames % 3 = 1 THEN replace(segment_name, '.tif', '.tiff') ELSE segment_name END"
    return fx.segments(s, d).withColumns({"segment_name": F.expr(name), "folder": F.expr("CASE WHEN n_frames % 5 = 0 AND right(session_id, 1) IN ('1', '2') THEN 'cam' WHEN n_frames % 5 = 1 THEN 'old' ELSE '' END")})


QUERIES = {
    "src1_natural_order": lambda s, d: segments.ordered(fx.segments(s, d)).select("session_id", "segment_name", "ord"),
    "src2_all_digits_order": lambda s, d: segments.ordered(fx.segments(s, d), "digits").select("session_id", "segment_name", "ord"),
    "src3_name_order": lambda s, d: segments.ordered(fx.segments(s, d), "name").select("session_id", "segment_name", "ord"),
    "src4_pick": lambda s, d: segments.pick(named_files(s, d), nested="cam").select("session_id", "folder", "segment_name", "first"),
    "src5_concat": lambda s, d: concatenated(s, d).select("session_id", "segment_name", "ord", "first_frame", "last_frame"),
    "src6_locate": lambda s, d: segments.locate(fx.segments(s, d).select("session_id", F.expr("int(n_frames * 37)").alias("at"), F.col("segment_name").alias("asked")).distinct(), concatenated(s, d)),
    "src7_frame_range": lambda s, d: segments.frame_range(fx.frames(s, d), 11, 60).select("session_id", "frame_idx", "h", "w"),
    "src8_batch": lambda s, d: round_trip(s, fx.traces(s, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("frame_idx").alias("last")),
    "src9_clock_columns": resolved,
    "src10_pulses": pulses,
    "src11_optional": optional,
    "snk1_results": lambda s, d: round_trip(s, tidy(traces.population(dff(s, d)), "mean_dff")),
    "snk2_checkpoint": checkpoint_twice,
    "snk3_trace_export": lambda s, d: round_trip(s, tidy(scans.trace_export(fx.traces(s, d), traces.z_trace(fx.traces(s, d)), dff(s, d)), "raw", "z", "dff")),
    "trc8_cell_partitions": lambda s, d: round_trip(s, fx.traces(s, d)).filter("cell_id = 3"),
    "clk1_parse": lambda s, d: fx.clock_raw(s, d).select("session_id", "raw_idx", clocks.parse(F.col("time")).alias("ts")),
    "clk2_pairs": lambda s, d: microscope(s, d).drop("stream"),
    "clk3_since_first": lambda s, d: tidy(clocks.since_first(cameras(s, d)).drop("ts"), "sec"),
    "clk4_median_rate": lambda s, d: tidy(clocks.median_rate(microscope(s, d).unionByName(cameras(s, d))), "rate"),
    "clk5_length_warnings": lambda s, d: clocks.length_warnings(cameras(s, d).filter("stream = 'camera1'"), fx.traces(s, d)),
    "clk6_summary": lambda s, d: tidy(clocks.summary(microscope(s, d).unionByName(cameras(s, d))), "rate"),
    "evt1_dictionary": lambda s, d: events.named(fx.log(s, d)).select("session_id", "cam_id", "seq", "frame_idx", "label", F.element_at("color", 1).alias("red")),
    "evt2_first_marks": lambda s, d: events.first_marks(events.named(fx.log(s, d))).select("session_id", "cam_id", "seq", "frame_idx", "label"),
    "evt3_replay": lambda s, d: events.replay(fx.log(s, d)),
    "evt4_stamp": lambda s, d: events.stamp(marks_with_seq(s, d).drop("ts"), camera_times(s, d)),
    "evt5_counts": lambda s, d: events.label_counts(fx.marks(s, d).select("session_id", F.expr("CASE WHEN label IN ('Mouse_reaction', 'Reaction_offset') THEN 2 ELSE 1 END").alias("cam_id"), "label")),
    "evt6_near_frame": lambda s, d: events.near_frame(fx.scored(s, d).drop("ts"), fx.camera_clock(s, d).select("session_id", "cam_id", F.col("frame_idx").alias("at"))),
    "evt6_near_frame_whole": lambda s, d: events.near_frame(fx.scored(s, d).drop("ts"), fx.camera_clock(s, d).select("session_id", "cam_id", F.col("frame_idx").alias("at"))),
    "aln1_nearest_frame": mapped,
    "aln2_reconcile": lambda s, d: align.reconcile(microscope(s, d), fx.traces(s, d).filter("frame_idx <= 900"))[0].select("session_id", "frame_idx", "ts"),
    "aln3_by_ratio": lambda s, d: align.by_ratio(fx.scored(s, d), lengths(s, d)),
    "aln4_label_filter": lambda s, d: align.with_label(fx.scored(s, d), "Soft_touch"),
    "aln5_one_hot": lambda s, d: align.one_hot(frame_list(s, d), long_marks(s, d)),
    "aln6_legacy": lambda s, d: align.legacy_labels(fx.scored(s, d).withColumn("label", F.expr("CASE label WHEN 'Soft_touch' THEN 'A' WHEN 'Strong_touch' THEN 'Stimuli_given' ELSE label END"))).select("session_id", "cam_id", "frame_idx", "label"),
    "aln7_any_event": lambda s, d: flagged(s, d).select("session_id", "frame_idx", "any_event"),
    "aln8_originals": lambda s, d: align.originals(fx.scored(s, d)).select("session_id", "cam_id", F.size("events").cast("long").alias("n"), F.element_at("events", 1)["frame_idx"].alias("first_frame"), F.element_at("events", -1)["label"].alias("last_label")),
    "aln9_metadata": lambda s, d: align.metadata(flagged(s, d), fx.traces(s, d), RATE).drop("created"),
    "aln10_merged": lambda s, d: tidy(align.merged(dff(s, d), microscope(s, d).drop("stream"), flagged(s, d)), "dff"),
}

_TS = "strptime({}, '%Y-%m-%d %H:%M:%S.%g')"
_NUM = "coalesce(TRY_CAST(list_last(regexp_extract_all(segment_name, '([0-9]+)', 1)) AS BIGINT), 0)"
_DIG = "coalesce(TRY_CAST(nullif(regexp_replace(segment_name, '[^0-9]', '', 'g'), '') AS BIGINT), 0)"
_DEF = ", ".join(f"({c}, '{k}', '{n}', {rgb[0]}::DOUBLE)" for c, k, n, rgb in events.DEFINITIONS)
_FLAGS = ", ".join(f"coalesce(bool_or(m.label = '{f}'), false) AS {f}" for f in align.FLAGS)


def _order(key: str) -> str:
    return f"SELECT session_id, segment_name, CAST(row_number() OVER (PARTITION BY session_id ORDER BY {key}segment_name) AS INTEGER) AS ord FROM segments"


VIEWS = TRACE_VIEWS | {
    "mclk": f"SELECT session_id, 'microscope' AS stream, CAST((raw_idx + 1) // 2 AS INTEGER) AS frame_idx, {_TS.format('time')} AS ts FROM clock_raw WHERE raw_idx % 2 = 1",
    "cclk": f"SELECT session_id, 'camera' || cam_id AS stream, frame_idx, {_TS.format('ref_time')} AS ts FROM camera_clock",
    "every": "SELECT * FROM mclk UNION ALL SELECT * FROM cclk",
    "gaps": "SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id, stream ORDER BY frame_idx) AS gap FROM every",
    "rates": "SELECT session_id, stream, CASE WHEN median(gap) > 0 THEN 1 / (median(gap) / 1e6) END AS rate FROM gaps GROUP BY ALL",
    "cat": "SELECT *, CAST(sum(n_frames) OVER k AS BIGINT) AS last_frame, CAST(row_number() OVER k AS INTEGER) AS ord FROM segments WINDOW k AS (PARTITION BY session_id ORDER BY " + _NUM + ", segment_name)",
    "defs": f"SELECT * FROM (VALUES {_DEF}) v(cam_id, key, label, red)",
    "marked": "SELECT l.session_id, l.cam_id, l.seq, l.frame_idx, label, red FROM log l JOIN defs ON l.cam_id = defs.cam_id AND l.key = defs.key",
    "near": "SELECT *, row_number() OVER (PARTITION BY session_id, cam_id, frame_idx, label, ts ORDER BY gap, neuron_frame) AS k FROM (SELECT s.*, c.frame_idx AS neuron_frame, abs(epoch_us(c.ts) - epoch_us(s.ts)) AS gap FROM scored s JOIN mclk c ON s.session_id = c.session_id)",
    "mapd": "SELECT session_id, ts, cam_id, frame_idx, label, neuron_frame FROM near WHERE k = 1 AND gap / 1e6 <= 100.0",
    "hot": f"SELECT f.session_id, f.frame_idx, {_FLAGS} FROM mclk f LEFT JOIN mapd m ON f.session_id = m.session_id AND f.frame_idx = m.neuron_frame GROUP BY f.session_id, f.frame_idx",
    "flg": f"SELECT *, {' OR '.join(align.FLAGS)} AS any_event FROM hot",
}


def q(body: str, **more: str) -> str:
    return fx.sql(body, VIEWS | more)


#: A log command by command, with what stands as a list: undo drops its last, a mark that stands adds nothing.
_REPLAY = {
    "commands": "SELECT l.session_id, l.cam_id, seq, frame_idx, CASE WHEN l.key = 'x' THEN 'undo' ELSE label END AS label, row_number() OVER (PARTITION BY l.session_id, l.cam_id ORDER BY seq) AS k FROM log l LEFT JOIN defs ON l.cam_id = defs.cam_id AND l.key = defs.key WHERE l.key = 'x' OR label IS NOT NULL",
    "standing": "SELECT DISTINCT session_id, cam_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(f INTEGER, n VARCHAR, s BIGINT)[]) AS st FROM commands UNION ALL SELECT c.session_id, c.cam_id, c.k, CASE WHEN c.label = 'undo' THEN list_slice(st, 1, greatest(len(st) - 1, 0)) WHEN len(list_filter(st, lambda e: e.f = c.frame_idx AND e.n = c.label)) > 0 THEN st ELSE list_append(st, CAST({'f': c.frame_idx, 'n': c.label, 's': c.seq} AS STRUCT(f INTEGER, n VARCHAR, s BIGINT))) END FROM standing s JOIN commands c ON c.session_id = s.session_id AND c.cam_id = s.cam_id AND c.k = s.k + 1",
}
_OLD = {"old": "SELECT session_id, cam_id, frame_idx, CASE label WHEN 'Soft_touch' THEN 'A' WHEN 'Strong_touch' THEN 'Stimuli_given' ELSE label END AS label FROM scored"}
ORACLES = {
    "src1_natural_order": q(_order(_NUM + ", ")),
    "src2_all_digits_order": q(_order(_DIG + ", ")),
    "src3_name_order": q(_order("")),
    "src4_pick": q("SELECT session_id, folder, nm AS segment_name, row_number() OVER (PARTITION BY session_id ORDER BY nm) = 1 AS first FROM pk WHERE rank = (SELECT min(rank) FROM pk p WHERE p.session_id = pk.session_id)", pk="SELECT session_id, folder, nm, CASE WHEN folder = 'cam' THEN 0 ELSE 2 END + CASE WHEN nm LIKE '%.tif' THEN 0 ELSE 1 END AS rank FROM (SELECT session_id, CASE WHEN n_frames % 5 = 0 AND right(session_id, 1) IN ('1', '2') THEN 'cam' WHEN n_frames % 5 = 1 THEN 'old' ELSE '' END AS folder, CASE WHEN n_frames % 3 = 0 THEN replace(segment_name, '.tif', '_index.tif') WHEN n_frames % 3 = 1 THEN replace(segment_name, '.tif', '.tiff') ELSE segment_name END AS nm FROM segments) WHERE nm NOT LIKE '%\\_index%' ESCAPE '\\' AND folder <> 'old'"),
    "src5_concat": q("SELECT session_id, segment_name, ord, last_frame - n_frames + 1 AS first_frame, last_frame FROM cat"),
    "src6_locate": q("SELECT w.session_id, w.at, w.asked, c.segment_name, g - (c.last_frame - c.n_frames) AS local_frame FROM (SELECT DISTINCT session_id, CAST(n_frames * 37 AS INTEGER) AS at, segment_name AS asked, least(greatest(n_frames * 37, 1), (SELECT max(last_frame) FROM cat x WHERE x.session_id = segments.session_id)) AS g FROM segments) w JOIN cat c ON w.session_id = c.session_id AND g > c.last_frame - c.n_frames AND g <= c.last_frame"),
    "src7_frame_range": q("SELECT session_id, frame_idx, h, w FROM frames WHERE frame_idx BETWEEN 11 AND 60"),
    "src8_batch": q("SELECT session_id, count(*) AS n, max(frame_idx) AS last FROM traces GROUP BY session_id"),
    "src9_clock_columns": q("SELECT session_id, stream, frame_idx, CASE WHEN even THEN ts ELSE ts + INTERVAL 1 HOUR END AS ts, CASE WHEN even THEN 1 ELSE 2 END AS source FROM (SELECT *, CAST(substr(session_id, 2) AS BIGINT) % 2 = 0 AS even FROM cclk WHERE stream = 'camera1')"),
    "src10_pulses": q("SELECT source, warning, count(*) FILTER (used) AS n FROM (SELECT 'good' AS source, '' AS warning, true AS used FROM clock_raw UNION ALL SELECT 'bad', 'no readable stamp', true FROM clock_raw UNION ALL SELECT 'mixed', '', true FROM clock_raw WHERE slice = '1' UNION ALL SELECT 'mixed', 'bad stamp', true FROM clock_raw WHERE slice = '2' UNION ALL SELECT 'torn', 'unreadable', false) GROUP BY ALL"),
    "src11_optional": q("SELECT f.session_id, f.frame_idx, " + ", ".join(f"coalesce(bool_or(m.label = '{x}'), false) AS {x}" if x in align.FLAGS[:4] else f"false AS {x}" for x in align.FLAGS) + " FROM (SELECT DISTINCT session_id, frame_idx FROM traces) f LEFT JOIN marks m ON f.session_id = m.session_id AND f.frame_idx = m.frame_idx GROUP BY f.session_id, f.frame_idx"),
    "snk1_results": q("SELECT session_id, frame_idx, round(avg(dff), 6) + 0.0 AS mean_dff FROM dff GROUP BY session_id, frame_idx"),
    "snk2_checkpoint": q("SELECT session_id, frame_idx, h, w, CAST(list_sum(pixels) AS BIGINT) AS total FROM frames"),
    "snk3_trace_export": q("SELECT t.session_id, t.cell_id, t.frame_idx, round(value, 6) + 0.0 AS raw, round((value - avg(value) OVER c) / greatest(stddev_samp(value) OVER c, 1e-10), 6) + 0.0 AS z, round((value - avg(value) OVER c) / greatest(abs(avg(value) OVER c), 1.0), 6) + 0.0 AS dff FROM traces t WINDOW c AS (PARTITION BY session_id, cell_id)"),
    "trc8_cell_partitions": q("SELECT session_id, cell_id, frame_idx, value FROM traces WHERE cell_id = 3"),
    "clk1_parse": q(f"SELECT session_id, raw_idx, {_TS.format('time')} AS ts FROM clock_raw"),
    "clk2_pairs": q("SELECT session_id, frame_idx, ts FROM mclk"),
    "clk3_since_first": q("SELECT session_id, stream, frame_idx, round((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY session_id, stream ORDER BY frame_idx)) / 1e6, 6) + 0.0 AS sec FROM cclk"),
    "clk4_median_rate": q(f"SELECT session_id, stream, {r('rate')} FROM rates"),
    "clk5_length_warnings": q("SELECT * FROM (SELECT session_id, count(*) AS n_clock FROM cclk WHERE stream = 'camera1' GROUP BY 1) a JOIN (SELECT session_id, count(DISTINCT frame_idx) AS n_frames FROM traces GROUP BY 1) b USING (session_id) WHERE n_clock <> n_frames"),
    "clk6_summary": q(f"SELECT e.session_id, e.stream, count(*) AS n_frames, arg_min(ts, frame_idx) AS \"first\", arg_max(ts, frame_idx) AS \"last\", round(any_value(rate), 6) + 0.0 AS rate FROM every e JOIN rates ON e.session_id = rates.session_id AND e.stream = rates.stream GROUP BY e.session_id, e.stream"),
    "evt1_dictionary": q("SELECT * FROM marked"),
    "evt2_first_marks": q("SELECT session_id, cam_id, min(seq) AS seq, frame_idx, label FROM marked GROUP BY session_id, cam_id, frame_idx, label"),
    "evt3_replay": "WITH RECURSIVE " + q("SELECT session_id, cam_id, e.f AS frame_idx, e.n AS label, e.s AS seq FROM (SELECT session_id, cam_id, unnest(st) AS e FROM (SELECT *, row_number() OVER (PARTITION BY session_id, cam_id ORDER BY k DESC) AS z FROM standing) WHERE z = 1)", **_REPLAY).removeprefix("WITH "),
    "evt4_stamp": q("SELECT s.session_id, s.cam_id, s.frame_idx, label, epoch_us(s.ts) AS seq, c.ts, CAST(row_number() OVER (PARTITION BY s.session_id, s.cam_id ORDER BY s.frame_idx, epoch_us(s.ts)) AS INTEGER) AS place FROM scored s LEFT JOIN cclk c ON s.session_id = c.session_id AND 'camera' || s.cam_id = c.stream AND s.frame_idx = c.frame_idx"),
    "evt5_counts": q("SELECT p.session_id, defs.cam_id, defs.label, count(c.label) AS n FROM (SELECT DISTINCT session_id, cam_id FROM cm) p JOIN defs ON p.cam_id = defs.cam_id LEFT JOIN cm c ON c.session_id = p.session_id AND c.label = defs.label GROUP BY ALL UNION ALL SELECT session_id, cam_id, 'all', count(*) FROM cm GROUP BY ALL", cm="SELECT session_id, CASE WHEN label IN ('Mouse_reaction', 'Reaction_offset') THEN 2 ELSE 1 END AS cam_id, label FROM marks"),
    "evt6_near_frame": q("SELECT s.session_id, s.cam_id, s.frame_idx, c.frame_idx AS at, label FROM scored s JOIN camera_clock c ON s.session_id = c.session_id AND s.cam_id = c.cam_id AND abs(s.frame_idx - c.frame_idx) < 3"),
    "evt6_near_frame_whole": q("SELECT s.session_id, s.cam_id, s.frame_idx, c.frame_idx AS at, label FROM scored s JOIN camera_clock c ON s.session_id = c.session_id AND s.cam_id = c.cam_id AND abs(s.frame_idx - c.frame_idx) < 3"),
    "aln1_nearest_frame": q("SELECT * FROM mapd"),
    "aln2_reconcile": q("SELECT session_id, frame_idx, ts FROM mclk WHERE frame_idx <= least(900, (SELECT max(frame_idx) FROM mclk m WHERE m.session_id = mclk.session_id))"),
    "aln3_by_ratio": q("SELECT DISTINCT s.session_id, cam_id, label, CAST(round(frame_idx / (30.0::DOUBLE / 4.605)) AS INTEGER) AS neuron_frame FROM scored s JOIN lengths l ON s.session_id = l.session_id WHERE round(frame_idx / (30.0::DOUBLE / 4.605)) BETWEEN 1 AND n_frames"),
    "aln4_label_filter": q("SELECT * FROM scored WHERE label = 'Soft_touch'"),
    "aln5_one_hot": q("SELECT * FROM hot"),
    "aln6_legacy": q("SELECT o.session_id, cam_id, frame_idx, CASE WHEN NOT soft AND cam_id = 1 AND label IN ('Stimuli_given', 'A') THEN 'Soft_touch' WHEN NOT mouse AND cam_id = 2 AND label = 'A' THEN 'Mouse_reaction' ELSE label END AS label FROM old o JOIN (SELECT session_id, bool_or(label = 'Soft_touch') AS soft, bool_or(label = 'Mouse_reaction') AS mouse FROM old GROUP BY 1) h ON o.session_id = h.session_id", **_OLD),
    "aln7_any_event": q("SELECT session_id, frame_idx, any_event FROM flg"),
    "aln8_originals": q("SELECT session_id, cam_id, count(*) AS n, arg_min(frame_idx, (frame_idx, label, ts)) AS first_frame, arg_max(label, (frame_idx, label, ts)) AS last_label FROM scored GROUP BY session_id, cam_id"),
    "aln9_metadata": q("SELECT f.session_id, count(*) AS n_frames, " + ", ".join(f"count(*) FILTER ({x}) AS n_{x}" for x in align.FLAGS) + ", (SELECT count(DISTINCT cell_id) FROM traces t WHERE t.session_id = f.session_id) AS n_cells, 4.605::DOUBLE AS rate, 30.0::DOUBLE AS camera_rate, '" + ",".join(align.FLAGS) + "' AS columns FROM flg f GROUP BY f.session_id"),
    "aln10_merged": q(f"SELECT d.session_id, d.frame_idx, d.cell_id, round(dff, 6) + 0.0 AS dff, ts, {', '.join(align.FLAGS)}, any_event FROM dff d JOIN mclk m ON d.session_id = m.session_id AND d.frame_idx = m.frame_idx JOIN flg ON d.session_id = flg.session_id AND d.frame_idx = flg.frame_idx"),
}
