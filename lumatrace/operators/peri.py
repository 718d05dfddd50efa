"""Peri-event windows: trials x offsets x cells in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import sem

EVENT_TYPES = ("Soft_touch", "Strong_touch", "Mechanic_pain", "Thermo_pain", "Mouse_reaction")
RATE, PRE_SECONDS, POST_SECONDS = 4.605, 3.0, 5.0
TRIAL = ["session_id", "event_type", "trial"]


def window_frames(rate: float = RATE, pre: float = PRE_SECONDS, post: float = POST_SECONDS) -> tuple[int, int]:
    """Frames before and after an event; halves round away from zero."""
    return int(pre * rate + 0.5), int(post * rate + 0.5)


def event_frames(flags: DataFrame, types=EVENT_TYPES) -> DataFrame:
    """Wide frame flags become (session_id, event_type, frame_idx); types without a column are skipped."""
    present = [t for t in types if t in flags.columns]
    long = flags.select("session_id", "frame_idx", *present).unpivot(["session_id", "frame_idx"], present, "event_type", "on")
    return long.filter("on").select("session_id", "event_type", "frame_idx").distinct()


def offsets(rate: float = RATE) -> list[tuple[int, float]]:
    pre, post = window_frames(rate)
    return [(o, o / rate) for o in range(-pre, post + 1)]


def trials(events: DataFrame, lengths: DataFrame, rate: float = RATE) -> DataFrame:
    """Events whose whole window lies in the recording, numbered by frame; (session_id, n_frames) gives its length."""
    pre, post = window_frames(rate)
    inside = events.join(lengths, "session_id").filter((F.col("frame_idx") > pre) & (F.col("frame_idx") <= F.col("n_frames") - post))
    place = F.row_number().over(Window.partitionBy("session_id", "event_type").orderBy("frame_idx"))
    return inside.select("session_id", "event_type", F.col("frame_idx").alias("event_frame"), place.alias("trial"))


def peri_event(dff: DataFrame, numbered: DataFrame, rate: float = RATE) -> DataFrame:
    """(session_id, event_type, trial, event_frame, cell_id, offset, t, dff): an equi-join on the window's frames."""
    pre, post = window_frames(rate)
    wanted = numbered.withColumn("offset", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn("frame_idx", F.col("event_frame") + F.col("offset"))
    return wanted.join(dff, ["session_id", "frame_idx"]).select(*TRIAL, "event_frame", "cell_id", "offset", (F.col("offset") / F.lit(rate)).alias("t"), "dff")


def cell_mean(peri: DataFrame) -> DataFrame:
    """Mean and SEM over trials by cell and offset."""
    return peri.groupBy("session_id", "event_type", "cell_id", "offset").agg(F.avg("dff").alias("mean"), sem("dff").alias("sem"), F.count(F.lit(1)).alias("n_trials"))


def population_mean(means: DataFrame) -> DataFrame:
    """Mean and SEM over cells of the cells' means."""
    return means.groupBy("session_id", "event_type", "offset").agg(F.avg("mean").alias("pop_mean"), sem("mean").alias("pop_sem"))
