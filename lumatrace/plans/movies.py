"""Queries over frames, cells, synchronised views and checks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from lumatrace.operators import align, cells, clocks, frames, sync, traces, validate
from lumatrace.plans import fixtures as fx
from lumatrace.plans import recordings as rec
from lumatrace.plans.traces import pct, r, tidy
from lumatrace.session import shared_dir
from lumatrace.sources import scans, segments

#: A block range that the derived movies, of 500 frames, have.
BLOCK = {"first": 101, "last": 150, "length": 30}
#: Thresholds for the derived cells, which are pixels of noise on an 8 x 8 field.
LOOSE = {"min_area": 3, "max_eccentricity": 0.98, "min_solidity": 0.3, "min_peak": 0.0}


def pixels(df, *more):
    """Frames in long form, with rounded values, so that they compare."""
    return df.select("session_id", "frame_idx", F.posexplode("pixels").alias("at", "v"), *more).withColumn("v", F.round(F.col("v").cast("double"), 6) + F.lit(0.0))


def movie(s, d):
    return fx.frames(s, d)


def projected(s, d):
    return traces.project_footprints(movie(s, d), fx.footprints(s, d))


def parts(s, d):
    return cells.largest_component(cells.mask(fx.footprints(s, d)))


def quality(s, d):
    return cells.quality_table(fx.footprints(s, d), projected(s, d))


def with_gaps(s, d):
    """Traces of which cell 2 is NaN throughout and cell 3 in every other frame."""
    t = fx.traces(s, d)
    return t.withColumn("value", F.when((F.col("cell_id") == 2) | (F.col("cell_id") == 3) & (F.col("frame_idx") % 2 == 0), float("nan")).otherwise(F.col("value")))


def kept(s, d):
    return cells.keep(quality(s, d), **LOOSE)


def lengths(s, d):
    return rec.lengths(s, d)


def shown(s, d):
    return sync.schedule(sync.clip_ranges(lengths(s, d), seconds=60.0), seconds=60.0)


def camera_segments(s, d):
    """Four segments of 200 camera frames a camera and session, and a long last one, in order of their names."""
    base = lengths(s, d).select("session_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("cam_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    named = base.select("session_id", "cam_id", F.concat(F.lit("cam"), "cam_id", F.lit("_"), "k", F.lit(".avi")).alias("segment_name"), F.when(F.col("k") < 5, 200 + F.col("cam_id")).otherwise(90000).alias("n_frames"))
    return segments.concatenated(segments.ordered(named, "name", ("session_id", "cam_id")), ("session_id", "cam_id"))


def flag_table(s, d):
    return align.one_hot(fx.traces(s, d).select("session_id", "frame_idx").distinct(), fx.marks(s, d))


def both_clocks(s, d):
    return rec.microscope(s, d).unionByName(clocks.camera_clock(fx.camera_clock(s, d)).withColumn("frame_idx", F.expr("int((frame_idx + 2) div 3)")))


def inventory(s, d):
    return validate.movie_inventory(segments.ordered(fx.segments(s, d)))


def camera_one(s, d):
    return both_clocks(s, d).filter("stream = 'camera1'")


def all_checks(s, d):
    return validate.movie_checks(inventory(s, d)).union(validate.interleaved(fx.clock_raw(s, d))).union(validate.duration_check(both_clocks(s, d))).union(validate.ratio_check(rec.microscope(s, d), camera_one(s, d)))


def outputs(s, d):
    folder = f"{shared_dir(s)}/outputs-{uuid.uuid4().hex}"
    scans.save_results({"traces": fx.traces(s, d)}, folder)
    scans.save_results({"frames": fx.frames(s, d)}, folder, by=None)
    return validate.output_inventory(s, folder, ("traces", "frames", "merged"))


QUERIES = {
    "frm1_deinterleave": lambda s, d: frames.deinterleave(movie(s, d)).select("session_id", "frame_idx", "pair", "plane"),
    "frm2_pair_maximum": lambda s, d: pixels(frames.pair_maximum(movie(s, d))),
    "frm3_channel": lambda s, d: pixels(frames.channel(movie(s, d))),
    "frm4_downsample": lambda s, d: pixels(frames.bin_mean(movie(s, d), 3, whole=True)),
    "frm5_bin_mean": lambda s, d: pixels(frames.bin_mean(movie(s, d), 4)),
    "frm6_z_score": lambda s, d: pixels(frames.z_score(movie(s, d))),
    "frm7_smooth": lambda s, d: pixels(frames.smooth(movie(s, d), 1.0)),
    "frm7_smooth_whole": lambda s, d: pixels(frames.smooth(movie(s, d), 1.0)),
    "frm8_projections": lambda s, d: tidy(frames.projections(movie(s, d)), "mean", "std"),
    "frm9_template": lambda s, d: tidy(frames.stable_template(movie(s, d), **BLOCK), "score").withColumn("pixels", F.transform("pixels", lambda v: F.round(v, 6) + F.lit(0.0))),
    "frm10_contrast": lambda s, d: tidy(frames.contrast_limits(movie(s, d)), "lo", "hi"),
    "frm11_rescale": lambda s, d: pixels(frames.rescale(movie(s, d), frames.contrast_limits(movie(s, d)), 40)),
    "trc1_projection": lambda s, d: tidy(projected(s, d), "value"),
    "cel1_drop_silent": lambda s, d: cells.drop_silent(with_gaps(s, d), with_gaps(s, d)).groupBy("session_id", "cell_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("value")).alias("n_nan")),
    "cel2_mask": lambda s, d: cells.mask(fx.footprints(s, d)),
    "cel3_component": parts,
    "cel4_regions": lambda s, d: tidy(cells.region_properties(parts(s, d)), "row", "col", "eccentricity"),
    "cel5_solidity": lambda s, d: tidy(cells.solidity(parts(s, d)), "solidity"),
    "cel6_inside_field": lambda s, d: tidy(cells.inside_field(cells.region_properties(cells.mask(fx.footprints(s, d))), 8, 8, 3), "row", "col", "eccentricity"),
    "cel7_trace_quality": lambda s, d: tidy(cells.trace_quality(fx.traces(s, d)), "f0", "scale", "peak", "mean", "snr"),
    "cel8_keep": kept,
    "cel9_quality": lambda s, d: tidy(quality(s, d), "peak", "mean", "snr", "row", "col", "eccentricity", "solidity"),
    "cel10_funnel": lambda s, d: cells.funnel(with_gaps(s, d), with_gaps(s, d), with_gaps(s, d).filter("cell_id > 4")),
    "cel10_ranges": lambda s, d: tidy(cells.ranges(quality(s, d)), *[f"{n}_{c}" for c in ("eccentricity", "solidity", "peak", "snr") for n in ("min", "max")]),
    "cel11_curated": lambda s, d: cells.curated(fx.traces(s, d), fx.choices(s, d)),
    "cel12_source": lambda s, d: traces.pick_source(fx.traces(s, d), cells.curated(fx.traces(s, d), fx.choices(s, d)), "signal_sorter").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")),
    "cel13_contours": lambda s, d: cells.contours(fx.footprints(s, d), 8, 8),
    "syn1_clip": lambda s, d: sync.clip_ranges(lengths(s, d), 11),
    "syn2_schedule": shown,
    "syn3_active": lambda s, d: sync.active_flags(flag_table(s, d)),
    "syn4_view": lambda s, d: sync.view_table(shown(s, d), flag_table(s, d), camera_segments(s, d)),
    "val1_movies": inventory,
    "val2_spot_check": lambda s, d: tidy(validate.projection_spot_check(movie(s, d)), "mean"),
    "val3_interleave": lambda s, d: validate.interleaved(fx.clock_raw(s, d)),
    "val4_two_point_rate": lambda s, d: tidy(validate.two_point_rate(both_clocks(s, d)), "rate", "plane_rate"),
    "val5_durations": lambda s, d: validate.duration_check(both_clocks(s, d)),
    "val6_cameras": lambda s, d: tidy(validate.camera_inventory(fx.segments(s, d)), "mb"),
    "val7_intervals": lambda s, d: tidy(validate.interval_stability(rec.microscope(s, d)), "mean_dt", "std_dt", "rate", "length"),
    "val8_ratio": lambda s, d: validate.ratio_check(rec.microscope(s, d), camera_one(s, d)),
    "val9_outputs": outputs,
    "val10_verdict": lambda s, d: validate.verdict(all_checks(s, d)),
}

_K = frames.kernel(1.0)
_H = len(_K) // 2
_PX = "CAST(unnest(range(0, len(pixels))) AS INTEGER) AS at, unnest(pixels) AS v"
_FLAGS = align.FLAGS
_MM = "greatest(1, least(8, {}))"
VIEWS = rec.VIEWS | {
    "px": f"SELECT session_id, frame_idx, {_PX} FROM frames",
    "zs": "SELECT session_id, at, avg(v) AS m, CASE WHEN stddev_samp(v) < 1e-6 THEN 1.0 ELSE stddev_samp(v) END AS s FROM px GROUP BY session_id, at",
    "kn": "SELECT * FROM (VALUES " + ", ".join(f"({i - _H}, {w!r}::DOUBLE)" for i, w in enumerate(_K)) + ") q(o, k)",
    "sm1": "SELECT p.session_id, p.frame_idx, p.at, sum(n.v * k) AS v FROM px p, kn JOIN px n ON true WHERE n.session_id = p.session_id AND n.frame_idx = p.frame_idx AND n.at = p.at // 8 * 8 + greatest(0, least(7, p.at % 8 + o)) GROUP BY ALL",
    "sm2": "SELECT p.session_id, p.frame_idx, p.at, sum(n.v * k) AS v FROM sm1 p, kn JOIN sm1 n ON true WHERE n.session_id = p.session_id AND n.frame_idx = p.frame_idx AND n.at = greatest(0, least(7, p.at // 8 + o)) * 8 + p.at % 8 GROUP BY ALL",
    "blk": f"SELECT session_id, s AS start, frame_idx, at, CAST(v AS DOUBLE) AS v FROM px, range(1, {BLOCK['last'] - BLOCK['first'] + 2 - BLOCK['length'] + 1}) q(s) WHERE frame_idx BETWEEN {BLOCK['first']} - 1 + s AND {BLOCK['first']} + {BLOCK['length']} - 2 + s",
    "mu": "SELECT session_id, start, at, avg(v) AS m FROM blk GROUP BY ALL",
    "cor": "SELECT b.session_id, b.start, frame_idx, (avg(v * m) - avg(v) * avg(m)) / (pow(2, -52) + stddev_samp(v) * stddev_samp(m)) AS c FROM blk b JOIN mu ON b.session_id = mu.session_id AND b.start = mu.start AND b.at = mu.at GROUP BY ALL",
    "tpl": "SELECT session_id, start, round(avg(c), 9) AS score FROM cor GROUP BY ALL",
    "nfs": "SELECT session_id, max(frame_idx) AS nf FROM frames GROUP BY session_id",
    "smp": "SELECT DISTINCT session_id, CAST(round(1 + i * (nf - 1) / (least(nf, 20) - 1)::DOUBLE) AS INTEGER) AS frame_idx FROM nfs, range(0, 20) q(i) WHERE i < least(nf, 20)",
    "lim": f"SELECT session_id, lo, CASE WHEN hi <= lo THEN lo + 1 ELSE hi END AS hi FROM (SELECT session_id, {pct('s', 1)} AS lo, {pct('s', 99.5)} AS hi FROM (SELECT px.session_id, list_sort(list(CAST(v AS DOUBLE))) AS s FROM px JOIN smp ON px.session_id = smp.session_id AND px.frame_idx = smp.frame_idx GROUP BY px.session_id))",
    "prj": "SELECT px.session_id, cell_id, frame_idx, sum(v * weight) AS value FROM px JOIN footprints f ON px.session_id = f.session_id AND px.at = (y - 1) * 8 + x - 1 GROUP BY ALL",
    "gap": "SELECT session_id, cell_id, frame_idx, CASE WHEN cell_id = 2 OR (cell_id = 3 AND frame_idx % 2 = 0) THEN 'nan'::DOUBLE ELSE value END AS value FROM traces",
    "msk": "SELECT session_id, cell_id, y, x FROM (SELECT *, max(weight) OVER (PARTITION BY session_id, cell_id) AS top FROM footprints) WHERE weight > top * 0.2",
    "msc": "SELECT session_id, cell_id, y, x FROM (SELECT *, max(weight) OVER (PARTITION BY session_id, cell_id) AS top FROM footprints) WHERE weight > top * 0.15",
    "rch": "SELECT session_id, cell_id, y AS sy, x AS sx, y, x FROM msk UNION SELECT r.session_id, r.cell_id, sy, sx, m.y, m.x FROM rch r JOIN msk m ON r.session_id = m.session_id AND r.cell_id = m.cell_id AND abs(r.y - m.y) <= 1 AND abs(r.x - m.x) <= 1",
    "cmp": "SELECT session_id, cell_id, y, x, count(*) AS size, min((sx, sy)) AS first FROM rch GROUP BY ALL",
    "prt": "SELECT session_id, cell_id, y, x FROM (SELECT *, rank() OVER (PARTITION BY session_id, cell_id ORDER BY size DESC, first) AS k FROM cmp) WHERE k = 1",
    "ql": "SELECT session_id, cell_id, list_sort(list(value)) AS s, list_sort(list(abs(value))) AS a, avg(value) AS m FROM traces GROUP BY ALL",
    "qm": f"SELECT session_id, cell_id, m, {pct('s', 20)} AS f0, {pct('s', 25)} AS q1, {pct('s', 75)} AS q3, {pct('s', 99)} AS top, {pct('a', 50)} AS mid FROM ql",
    "qs": "SELECT *, greatest(abs(f0), mid, 1.0) AS scale FROM qm",
    "cur": "SELECT t.session_id, CAST(dense_rank() OVER (PARTITION BY t.session_id ORDER BY t.cell_id) AS INTEGER) AS cell_id, frame_idx, value FROM traces t JOIN choices c ON t.cell_id = c.cell_id WHERE choice > 0",
    "bord": "SELECT DISTINCT m.session_id, m.cell_id, m.y, m.x FROM msc m, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(dy, dx) WHERE NOT EXISTS (SELECT 1 FROM msc n WHERE n.session_id = m.session_id AND n.cell_id = m.cell_id AND n.y = m.y + dy AND n.x = m.x + dx)",
    "clp": "SELECT session_id, n_frames, 1 AS start_nf, least(n_frames, CAST(round(60.0::DOUBLE * 4.605) AS INTEGER)) AS end_nf FROM lengths",
    "sch": "SELECT session_id, CAST(o AS INTEGER) AS out_frame, least(1 + CAST(round((o - 1) * (5.0::DOUBLE / 30) * 4.605) AS INTEGER), end_nf) AS neuron_frame, least(1 + CAST(round((o - 1) * (5.0::DOUBLE / 30) * 30) AS INTEGER), CAST(round(end_nf * (30.0::DOUBLE / 4.605)) AS INTEGER)) AS camera_frame FROM clp, range(1, 361) q(o)",
    "fl": "SELECT f.session_id, f.frame_idx, " + ", ".join(f"coalesce(bool_or(m.label = '{x}'), false) AS {x}" for x in _FLAGS) + " FROM (SELECT DISTINCT session_id, frame_idx FROM traces) f LEFT JOIN marks m ON f.session_id = m.session_id AND f.frame_idx = m.frame_idx GROUP BY ALL",
    "act": "SELECT session_id, frame_idx, " + ", ".join(f"bool_or({x}) OVER w AS {x}" for x in _FLAGS) + " FROM fl WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "csg": "SELECT session_id, CAST(c AS INTEGER) AS cam_id, 'cam' || c || '_' || k || '.avi' AS segment_name, (k - 1) * (200 + c) + 1 AS f0, CASE WHEN k < 5 THEN k * (200 + c) ELSE 4 * (200 + c) + 90000 END AS f1 FROM lengths, range(1, 3) a(c), range(1, 6) b(k)",
    "bc": "SELECT session_id, stream, frame_idx, ts FROM mclk UNION ALL SELECT session_id, stream, CAST((frame_idx + 2) // 3 AS INTEGER), ts FROM cclk",
    "inv": "SELECT session_id, count(*) AS n_segments, CAST(sum(n_frames) AS BIGINT) AS n_frames, count(*) FILTER (h <> fh OR w <> fw) AS n_other_size FROM (SELECT *, first_value(h) OVER k AS fh, first_value(w) OVER k AS fw FROM cat WINDOW k AS (PARTITION BY session_id ORDER BY ord)) GROUP BY session_id",
    "tpr": "SELECT session_id, stream, CASE WHEN t2 > t1 THEN 1e6 / (epoch_us(t2) - epoch_us(t1)) ELSE 0.0 END AS rate, n FROM (SELECT session_id, stream, max(CASE WHEN frame_idx = 1 THEN ts END) AS t1, max(CASE WHEN frame_idx = 2 THEN ts END) AS t2, count(*) AS n FROM bc GROUP BY ALL)",
    "iv": "SELECT session_id, avg(g) AS mean_dt, stddev_pop(g) AS std_dt FROM (SELECT session_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY frame_idx)) / 1e6 AS g FROM mclk WHERE frame_idx <= 100) GROUP BY session_id",
    "chk": "SELECT session_id, 'movie_pairs' AS \"check\", CASE WHEN n_frames % 2 = 0 THEN 'OK' ELSE 'WARNING' END AS status, CAST(n_frames // 2 AS VARCHAR) AS detail FROM inv UNION ALL SELECT session_id, 'movie_sizes', CASE WHEN n_other_size = 0 THEN 'OK' ELSE 'WARNING' END, CAST(n_other_size AS VARCHAR) FROM inv UNION ALL SELECT session_id, 'movie_total', CASE WHEN n_frames = 18000 THEN 'OK' ELSE 'NOTE' END, CAST(n_frames AS VARCHAR) FROM inv UNION ALL SELECT * FROM il UNION ALL SELECT * FROM du UNION ALL SELECT * FROM ra",
    "il": "SELECT session_id, 'interleave' AS \"check\", CASE WHEN bool_or(slice = '1') AND bool_or(slice = '2') THEN 'OK' ELSE 'WARNING' END AS status, concat_ws(',', CASE WHEN bool_or(slice = '1') THEN '1' END, CASE WHEN bool_or(slice = '2') THEN '2' END) AS detail FROM clock_raw WHERE raw_idx <= 10 GROUP BY session_id",
    "du": "SELECT m.session_id, 'durations' AS \"check\", CASE WHEN abs(CASE WHEN c.rate > 0 THEN c.n / c.rate ELSE 0 END - CASE WHEN m.rate > 0 THEN m.n / m.rate ELSE 0 END) < 60 THEN 'OK' ELSE 'WARNING' END AS status, format('{:.1f}', CASE WHEN m.rate > 0 THEN c.rate / m.rate ELSE 0.0 END) AS detail FROM tpr m JOIN tpr c ON m.session_id = c.session_id WHERE m.stream = 'microscope' AND c.stream = 'camera1'",
    "ra": "SELECT session_id, 'rate_ratio' AS \"check\", CASE WHEN q > 5 AND q < 8 THEN 'OK' ELSE 'NOTE' END AS status, format('{:.1f}', q) AS detail FROM (SELECT iv.session_id, CASE WHEN mean_dt > 0 THEN rate * mean_dt ELSE 0.0 END AS q FROM iv JOIN tpr ON iv.session_id = tpr.session_id WHERE stream = 'camera1')",
}


def q(body: str, **more: str) -> str:
    text = re.sub(r'(?<!")\bat\b(?!")', '"at"', fx.sql(body, VIEWS | more))  # a keyword
    return text.replace("WITH ", "WITH RECURSIVE ", 1) if "rch AS" in text else text


_PIX = "session_id, frame_idx, at, round(CAST(v AS DOUBLE), 6) + 0.0 AS v"
_SQ = "sqrt(pow(xx - yy, 2) + 4 * pow(xy, 2))"
_ECC = f"sqrt(greatest(0.0, 1 - (xx + yy - {_SQ}) / (xx + yy + {_SQ})))"
_REG = "SELECT session_id, cell_id, count(*) AS area, avg(y) AS row, avg(x) AS col, var_pop(x) + 1 / 12.0::DOUBLE AS xx, var_pop(y) + 1 / 12.0::DOUBLE AS yy, covar_pop(x, y) AS xy FROM {} GROUP BY session_id, cell_id"
_ROUND_REG = f"SELECT session_id, cell_id, area, round(row, 6) + 0.0 AS row, round(col, 6) + 0.0 AS col, round({_ECC}, 6) + 0.0 AS eccentricity FROM "

_G = "session_id, cell_id"
#: Solidity by the half-planes of all pairs of pixel corners that have every corner on one side.
VIEWS |= {
    "crn": "SELECT DISTINCT session_id, cell_id, y + dy AS cy, x + dx AS cx FROM prt, (VALUES (-0.5::DOUBLE), (0.5::DOUBLE)) a(dy), (VALUES (-0.5::DOUBLE), (0.5::DOUBLE)) b(dx)",
    "hul": "SELECT a.session_id, a.cell_id, a.cy AS y0, a.cx AS x0, b.cy AS y1, b.cx AS x1 FROM crn a JOIN crn b ON a.session_id = b.session_id AND a.cell_id = b.cell_id AND (a.cy <> b.cy OR a.cx <> b.cx) JOIN crn p ON p.session_id = a.session_id AND p.cell_id = a.cell_id GROUP BY ALL HAVING min((b.cy - a.cy) * (p.cx - a.cx) - (b.cx - a.cx) * (p.cy - a.cy)) >= 0",
    "ins": f"SELECT g.session_id, g.cell_id, gy, gx FROM (SELECT {_G}, min(y) AS ya, max(y) AS yb, min(x) AS xa, max(x) AS xb FROM prt GROUP BY {_G}) g JOIN hul h ON h.session_id = g.session_id AND h.cell_id = g.cell_id, range(1, 9) r(gy), range(1, 9) c(gx) WHERE gy BETWEEN ya AND yb AND gx BETWEEN xa AND xb GROUP BY ALL HAVING min((y1 - y0) * (gx - x0) - (x1 - x0) * (gy - y0)) >= -1e-9",
    "sol": f"SELECT p.session_id, p.cell_id, area / greatest(1, coalesce(n, 0)) AS solidity FROM (SELECT {_G}, count(*) AS area FROM prt GROUP BY {_G}) p LEFT JOIN (SELECT {_G}, count(*) AS n FROM ins GROUP BY {_G}) i ON i.session_id = p.session_id AND i.cell_id = p.cell_id",
    "qt": f"SELECT q.session_id, q.cell_id, (top - f0) / scale AS peak, (m - f0) / scale AS mean, (top - f0) / scale / greatest((q3 - q1) / scale, 1e-3) AS snr, coalesce(area, 0) AS area, coalesce(row, 0.0) AS row, coalesce(col, 0.0) AS col, coalesce({_ECC}, 0.0) AS eccentricity, coalesce(solidity, 0.0) AS solidity FROM qs q LEFT JOIN ({_REG.format('prt')}) g ON g.session_id = q.session_id AND g.cell_id = q.cell_id LEFT JOIN sol ON sol.session_id = q.session_id AND sol.cell_id = q.cell_id",
}
_OF_MOVIE = {"ql": VIEWS["ql"].replace("FROM traces", "FROM prj")}

ORACLES = {
    "frm1_deinterleave": q("SELECT session_id, frame_idx, CAST((frame_idx + 1) // 2 AS INTEGER) AS pair, CASE WHEN frame_idx % 2 = 1 THEN 'A' ELSE 'B' END AS plane FROM frames"),
    "frm2_pair_maximum": q(f"SELECT {_PIX} FROM (SELECT session_id, CAST((frame_idx + 1) // 2 AS INTEGER) AS frame_idx, at, max(v) AS v FROM px GROUP BY ALL HAVING count(*) = 2)"),
    "frm3_channel": q(f"SELECT {_PIX} FROM (SELECT session_id, CAST((frame_idx + 1) // 2 AS INTEGER) AS frame_idx, at, v FROM px WHERE frame_idx % 2 = 1)"),
    "frm4_downsample": q(f"SELECT {_PIX} FROM (SELECT session_id, CAST((frame_idx - 1) // 3 + 1 AS INTEGER) AS frame_idx, at, round(sum(v) / 3.0::DOUBLE) AS v FROM px GROUP BY ALL HAVING count(*) = 3)".replace("GROUP BY ALL", "GROUP BY session_id, (frame_idx - 1) // 3, at")),
    "frm5_bin_mean": q(f"SELECT {_PIX} FROM (SELECT session_id, CAST((frame_idx - 1) // 4 + 1 AS INTEGER) AS frame_idx, at, avg(v) AS v FROM px GROUP BY session_id, (frame_idx - 1) // 4, at HAVING count(*) = 4)"),
    "frm6_z_score": q("SELECT px.session_id, frame_idx, px.at, round((v - m) / s, 6) + 0.0 AS v FROM px JOIN zs ON px.session_id = zs.session_id AND px.at = zs.at"),
    "frm7_smooth": q(f"SELECT {_PIX} FROM sm2"),
    "frm7_smooth_whole": q(f"SELECT {_PIX} FROM sm2"),
    "frm8_projections": q("SELECT session_id, CAST(at // 8 + 1 AS INTEGER) AS y, CAST(at % 8 + 1 AS INTEGER) AS x, round(avg(v), 6) + 0.0 AS mean, max(v) AS max, round(coalesce(stddev_samp(v), 0.0), 6) + 0.0 AS std FROM px GROUP BY session_id, at"),
    "frm9_template": q("SELECT b.session_id, CAST(b.start AS INTEGER) AS start, round(any_value(score), 6) + 0.0 AS score, 8 AS h, 8 AS w, list(round(m, 6) + 0.0 ORDER BY mu.at) AS pixels FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, start) AS k FROM tpl) b JOIN mu ON mu.session_id = b.session_id AND mu.start = b.start WHERE k = 1 GROUP BY b.session_id, b.start"),
    "frm10_contrast": q(f"SELECT session_id, {r('lo', 'hi')} FROM lim"),
    "frm11_rescale": q("SELECT px.session_id, frame_idx, at, round(least(1.0, greatest(0.0, (v - lo) / (hi - lo))), 6) + 0.0 AS v FROM px JOIN lim ON px.session_id = lim.session_id WHERE frame_idx <= 40"),
    "trc1_projection": q(f"SELECT session_id, cell_id, frame_idx, {r('value')} FROM prj"),
    "cel1_drop_silent": q("SELECT session_id, cell_id, count(*) AS n, count(*) FILTER (isnan(value)) AS n_nan FROM gap GROUP BY session_id, cell_id HAVING count(*) > count(*) FILTER (isnan(value))"),
    "cel2_mask": q("SELECT * FROM msk"),
    "cel3_component": q("SELECT * FROM prt"),
    "cel4_regions": q(_ROUND_REG + "(" + _REG.format("prt") + ")"),
    "cel5_solidity": q("SELECT session_id, cell_id, round(solidity, 6) + 0.0 AS solidity FROM sol"),
    "cel8_keep": q("SELECT session_id, cell_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY cell_id) AS INTEGER) AS new_id FROM qt WHERE area >= 3 AND eccentricity <= 0.98 AND solidity >= 0.3 AND peak >= 0.0", **_OF_MOVIE),
    "cel9_quality": q(f"SELECT session_id, cell_id, area, {r('peak', 'mean', 'snr', 'row', 'col', 'eccentricity', 'solidity')} FROM qt", **_OF_MOVIE),
    "cel10_ranges": q("SELECT session_id, min(area) AS min_area, max(area) AS max_area, " + ", ".join(f"round({f}({c}), 6) + 0.0 AS {f}_{c}" for c in ("eccentricity", "solidity", "peak", "snr") for f in ("min", "max")) + " FROM qt GROUP BY session_id", **_OF_MOVIE),
    "cel6_inside_field": q(_ROUND_REG + "(" + _REG.format("msk") + ") WHERE row > 3 AND row < 5 AND col > 3 AND col < 5"),
    "cel7_trace_quality": q("SELECT session_id, cell_id, round(f0, 6) + 0.0 AS f0, round(scale, 6) + 0.0 AS scale, round((top - f0) / scale, 6) + 0.0 AS peak, round((m - f0) / scale, 6) + 0.0 AS mean, round((top - f0) / scale / greatest((q3 - q1) / scale, 1e-3), 6) + 0.0 AS snr FROM qs"),
    "cel10_funnel": q("SELECT session_id, count(DISTINCT cell_id) AS n_raw, count(DISTINCT cell_id) FILTER (NOT isnan(value)) AS n_real, count(DISTINCT cell_id) FILTER (cell_id > 4) AS n_kept FROM gap GROUP BY session_id"),
    "cel11_curated": q("SELECT * FROM cur"),
    "cel12_source": q("SELECT session_id, count(*) AS n FROM cur GROUP BY session_id"),
    "cel13_contours": q("SELECT DISTINCT session_id, y + dy AS y, x + dx AS x FROM bord, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) WHERE y + dy BETWEEN 1 AND 8 AND x + dx BETWEEN 1 AND 8"),
    "syn1_clip": q("SELECT session_id, n_frames, 11 AS start_nf, e AS end_nf, CAST(greatest(1, round(10 * (30.0::DOUBLE / 4.605)) + 1) AS INTEGER) AS start_bf, CAST(round(e * (30.0::DOUBLE / 4.605)) AS INTEGER) AS end_bf FROM (SELECT *, least(n_frames, 11 + CAST(round(180.0::DOUBLE * 4.605) AS INTEGER) - 1) AS e FROM lengths)"),
    "syn2_schedule": q("SELECT * FROM sch"),
    "syn3_active": q("SELECT * FROM act"),
    "syn4_view": q("SELECT s.*, " + ", ".join(f"a.{x}" for x in _FLAGS) + ", c1.segment_name AS cam1_segment, camera_frame - c1.f0 + 1 AS cam1_frame, c2.segment_name AS cam2_segment, camera_frame - c2.f0 + 1 AS cam2_frame FROM sch s LEFT JOIN act a ON s.session_id = a.session_id AND s.neuron_frame = a.frame_idx JOIN csg c1 ON c1.session_id = s.session_id AND c1.cam_id = 1 AND camera_frame BETWEEN c1.f0 AND c1.f1 JOIN csg c2 ON c2.session_id = s.session_id AND c2.cam_id = 2 AND camera_frame BETWEEN c2.f0 AND c2.f1"),
    "val1_movies": q("SELECT session_id, n_segments, n_frames, n_frames // 2 AS n_pairs, n_frames % 2 = 1 AS odd, n_other_size FROM inv"),
    "val2_spot_check": q("SELECT session_id, kind, frame_idx, round(avg(v), 6) + 0.0 AS mean, max(v) AS max FROM (SELECT session_id, 'frame' AS kind, frame_idx, at, v FROM px WHERE frame_idx <= 4 UNION ALL SELECT session_id, 'pair', CAST((frame_idx + 1) // 2 AS INTEGER), at, max(v) FROM px WHERE frame_idx <= 4 GROUP BY session_id, (frame_idx + 1) // 2, at) GROUP BY ALL"),
    "val3_interleave": q("SELECT * FROM il"),
    "val4_two_point_rate": q("SELECT session_id, stream, round(rate, 6) + 0.0 AS rate, round(rate / 2, 6) + 0.0 AS plane_rate FROM tpr"),
    "val5_durations": q("SELECT * FROM du"),
    "val6_cameras": q("SELECT session_id, cam_id, count(*) AS n_segments, CAST(sum(n_frames) AS BIGINT) AS n_frames, round(sum(bytes) / 1e6, 6) + 0.0 AS mb FROM segments GROUP BY session_id, cam_id"),
    "val7_intervals": q("SELECT iv.session_id, round(mean_dt, 6) + 0.0 AS mean_dt, round(std_dt, 6) + 0.0 AS std_dt, round(CASE WHEN mean_dt > 0 THEN 1 / mean_dt ELSE 0.0 END, 6) + 0.0 AS rate, round(n * mean_dt, 6) + 0.0 AS length FROM iv JOIN (SELECT session_id, count(*) AS n FROM mclk GROUP BY 1) c ON iv.session_id = c.session_id"),
    "val8_ratio": q("SELECT * FROM ra"),
    "val9_outputs": q("SELECT 'traces' AS output, 'present' AS status, count(*) AS rows, 'cell_id,frame_idx,value,session_id' AS columns, 'int,int,double,string' AS types FROM traces UNION ALL SELECT 'frames', 'present', count(*), 'session_id,frame_idx,h,w,pixels', 'string,int,int,int,array<int>' FROM frames UNION ALL SELECT 'merged', 'pending', 0, '', ''"),
    "val10_verdict": q("SELECT session_id, bool_and(status <> 'WARNING') AS passed, count(*) FILTER (status = 'WARNING') AS n_warnings FROM chk GROUP BY session_id"),
}
