"""Recordings derived from the driver's tables, once for Spark and once as DuckDB views in a WITH list.

1,000 frames make a session, so that sessions grow in number with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("g", F.expr("event_id div 10")).withColumns({"session_id": F.expr(f"concat('s', g div {FRAMES})"), "frame": F.expr(f"int(g % {FRAMES} + 1)")})


def traces(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("session_id", F.expr("int(event_id % 10 + 1)").alias("cell_id"), F.col("frame").alias("frame_idx"), "value")


def clock_raw(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_id % 5 = 0").withColumn("k", F.expr("event_id div 5"))
    return e.select("session_id", F.expr(f"int(k % {2 * FRAMES} + 1)").alias("raw_idx"), F.expr("string(k % 2 + 1)").alias("slice"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"))


def label_of(column="event_type"):
    return F.expr(f"CASE {column} WHEN 'click' THEN 'Soft_touch' WHEN 'view' THEN 'Strong_touch' WHEN 'purchase' THEN 'Mechanic_pain' WHEN 'signup' THEN 'Thermo_pain' ELSE 'Mouse_reaction' END")


def marks(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir).filter("value > 100 AND event_id % 10 IN (0, 1)")
    return e.select("session_id", F.col("frame").alias("frame_idx"), F.when(F.expr("event_id % 10 = 0"), label_of()).otherwise("Reaction_offset").alias("label"))


def scored(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir).filter("value > 80 AND event_id % 10 IN (3, 7)")
    return e.select("session_id", F.expr("CASE WHEN event_type = 'error' THEN 2 ELSE 1 END").alias("cam_id"), F.expr(f"int(event_id % {10 * FRAMES} + 1)").alias("frame_idx"), label_of().alias("label"), "ts")


def camera_clock(spark, sf_dir) -> DataFrame:
    """Camera frame n of a session is its n-th event; every third stands for camera 1, the next for camera 2."""
    e = _events(spark, sf_dir)
    return e.filter("event_id % 3 < 2").select("session_id", F.expr("int(event_id % 3 + 1)").alias("cam_id"), F.expr(f"int(event_id % {10 * FRAMES} + 1)").alias("frame_idx"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ref_time"))


def frames(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.expr("concat('m', vec_id div 500)").alias("session_id"), F.expr("int(vec_id % 500 + 1)").alias("frame_idx"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda e: F.round((e.cast("double") + 1) * 1000).cast("int")).alias("pixels"))


def footprints(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    long = v.select(F.expr("concat('m', vec_id div 500)").alias("session_id"), (F.col("label") + 1).alias("cell_id"), F.posexplode("embedding").alias("p", "e"))
    mean = long.groupBy("session_id", "cell_id", "p").agg(F.round(F.avg(F.col("e").cast("double")), 6).alias("weight")).filter("weight > 0")
    return mean.select("session_id", "cell_id", F.expr("int(p div 8 + 1)").alias("y"), F.expr("int(p % 8 + 1)").alias("x"), "weight")


def segments(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("session_id"), F.expr("concat(p_name, ' ', p_partkey, '.tif')").alias("segment_name"), F.col("p_size").cast("int").alias("n_frames"), F.lit(512).alias("h"), F.when(F.expr("p_partkey % 50 = 0"), 441).otherwise(440).alias("w"), F.expr("int(p_partkey % 2 + 1)").alias("cam_id"), F.expr("p_partkey * 1000").alias("bytes"))


def choices(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "labels")
    mean = q.agg(F.avg("quality").alias("m"))
    cells = q.groupBy(F.expr("int(doc_id % 10 + 1)").alias("cell_id")).agg(F.avg("quality").alias("a"))
    return cells.join(F.broadcast(mean)).select("cell_id", F.when(F.col("a") >= F.col("m"), 1).otherwise(0).alias("choice"))  # the mean is one row


def log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("concat('u', user_id)").alias("session_id"), F.lit(1).alias("cam_id"), F.col("event_id").alias("seq"), F.floor("value").cast("int").alias("v"), "event_type").select("session_id", "cam_id", "seq", (F.col("v") + 1).alias("frame_idx"), F.expr("CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 's' WHEN 'purchase' THEN 'd' WHEN 'signup' THEN 'f' ELSE 'x' END").alias("key"))


_LABEL = "CASE event_type WHEN 'click' THEN 'Soft_touch' WHEN 'view' THEN 'Strong_touch' WHEN 'purchase' THEN 'Mechanic_pain' WHEN 'signup' THEN 'Thermo_pain' ELSE 'Mouse_reaction' END"
_SESSION = f"'s' || (event_id // 10 // {FRAMES}) AS session_id"
_FRAME = f"CAST(event_id // 10 % {FRAMES} + 1 AS INTEGER)"
_MOVIE = "'m' || (vec_id // 500) AS session_id"

#: The same as views, by name.
SQL = {
    "traces": f"SELECT {_SESSION}, CAST(event_id % 10 + 1 AS INTEGER) AS cell_id, {_FRAME} AS frame_idx, value FROM events",
    "clock_raw": f"SELECT {_SESSION}, CAST(event_id // 5 % {2 * FRAMES} + 1 AS INTEGER) AS raw_idx, CAST(event_id // 5 % 2 + 1 AS VARCHAR) AS slice, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS time FROM events WHERE event_id % 5 = 0",
    "marks": f"SELECT {_SESSION}, {_FRAME} AS frame_idx, CASE WHEN event_id % 10 = 0 THEN {_LABEL} ELSE 'Reaction_offset' END AS label FROM events WHERE value > 100 AND event_id % 10 IN (0, 1)",
    "scored": f"SELECT {_SESSION}, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS cam_id, CAST(event_id % {10 * FRAMES} + 1 AS INTEGER) AS frame_idx, {_LABEL} AS label, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE value > 80 AND event_id % 10 IN (3, 7)",
    "camera_clock": f"SELECT {_SESSION}, CAST(event_id % 3 + 1 AS INTEGER) AS cam_id, CAST(event_id % {10 * FRAMES} + 1 AS INTEGER) AS frame_idx, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ref_time FROM events WHERE event_id % 3 < 2",
    "frames": f"SELECT {_MOVIE}, CAST(vec_id % 500 + 1 AS INTEGER) AS frame_idx, 8 AS h, 8 AS w, list_transform(embedding, lambda e: CAST(round((CAST(e AS DOUBLE) + 1) * 1000) AS INTEGER)) AS pixels FROM embeddings",
    "footprints": f"SELECT session_id, cell_id, CAST((p - 1) // 8 + 1 AS INTEGER) AS y, CAST((p - 1) % 8 + 1 AS INTEGER) AS x, weight FROM (SELECT {_MOVIE}, label + 1 AS cell_id, p, round(avg(CAST(embedding[p] AS DOUBLE)), 6) AS weight FROM embeddings, range(1, 65) r(p) GROUP BY ALL) WHERE weight > 0",
    "segments": "SELECT p_brand AS session_id, p_name || ' ' || p_partkey || '.tif' AS segment_name, CAST(p_size AS INTEGER) AS n_frames, 512 AS h, CASE WHEN p_partkey % 50 = 0 THEN 441 ELSE 440 END AS w, CAST(p_partkey % 2 + 1 AS INTEGER) AS cam_id, p_partkey * 1000 AS bytes FROM part",
    "choices": "SELECT CAST(doc_id % 10 + 1 AS INTEGER) AS cell_id, CASE WHEN avg(quality) >= (SELECT avg(quality) FROM labels) THEN 1 ELSE 0 END AS choice FROM labels GROUP BY 1",
    "log": "SELECT 'u' || user_id AS session_id, 1 AS cam_id, event_id AS seq, CAST(floor(value) AS INTEGER) + 1 AS frame_idx, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 's' WHEN 'purchase' THEN 'd' WHEN 'signup' THEN 'f' ELSE 'x' END AS key FROM events",
}


def sql(body: str, views: dict[str, str] | None = None) -> str:
    """``body`` with a WITH list of the fixtures and further views that it or they name, in the order given."""
    known = SQL | (views or {})
    need: list[str] = []
    open_: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in known and name not in need and name not in open_:
                open_.append(name)
                visit(known[name])
                need.append(name)

    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in need) + "\n" if need else "") + body
