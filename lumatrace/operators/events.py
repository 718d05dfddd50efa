"""Scored events and the annotation log that they come from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key, label and colour of each event by camera.
DEFINITIONS = (
    (1, "a", "Soft_touch", (0.2, 0.8, 0.2)), (1, "s", "Strong_touch", (1.0, 0.6, 0.0)), (1, "d", "Mechanic_pain", (1.0, 0.2, 0.2)), (1, "f", "Thermo_pain", (0.8, 0.2, 1.0)),
    (2, "a", "Mouse_reaction", (0.2, 0.8, 0.2)), (2, "s", "Reaction_offset", (0.2, 0.6, 1.0)),
)
UNDO = "x"


def definitions(spark: SparkSession) -> DataFrame:
    """(cam_id, key, label, color): six rows."""
    return spark.createDataFrame([(c, k, n, list(rgb)) for c, k, n, rgb in DEFINITIONS], "cam_id int, key string, label string, color array<double>")


def named(log: DataFrame) -> DataFrame:
    """Marks of a log with label and colour; keys that a camera doesn't know go."""
    return log.join(F.broadcast(definitions(log.sparkSession)), ["cam_id", "key"])  # six fixed rows


def first_marks(marks: DataFrame) -> DataFrame:
    """The first mark of each label on a frame; a second one adds nothing."""
    place = F.row_number().over(Window.partitionBy("session_id", "cam_id", "frame_idx", "label").orderBy("seq"))
    return marks.withColumn("place", place).filter("place = 1").drop("place")


def apply_commands(survivors: list[tuple[int, str, int]], commands: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Marks (frame, label, seq) after commands (frame, label or UNDO, seq) in order.

    A mark that stands is not added again; undo takes back the last mark that was added and stands.
    """
    out = list(survivors)
    there = {(f, n) for f, n, _ in out}
    for frame, label, seq in commands:
        if label == UNDO:
            if out:
                f, n, _ = out.pop()
                there.discard((f, n))
        elif (frame, label) not in there:
            there.add((frame, label))
            out.append((frame, label, seq))
    return out


def labelled_commands(log: DataFrame) -> DataFrame:
    """(session_id, cam_id, seq, frame_idx, label): labels for known keys, UNDO for undo; other keys do nothing."""
    known = F.broadcast(definitions(log.sparkSession).select("cam_id", "key", "label"))  # six fixed rows
    joined = log.join(known, ["cam_id", "key"], "left").withColumn("label", F.when(F.col("key") == UNDO, UNDO).otherwise(F.col("label")))
    return joined.filter("label IS NOT NULL").select("session_id", "cam_id", "seq", "frame_idx", "label")


def replay(log: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """The events (session_id, cam_id, frame_idx, label, seq) that an annotation log leaves.

    ``saved``: events of an earlier sitting, of the same columns; they stand first and undo reaches them.
    One log is one scorer at one camera of one session, tens to thousands of commands, and is
    replayed in one group; sessions and cameras are spread.
    """
    commands = labelled_commands(log).withColumn("old", F.lit(0))
    if saved is not None:
        commands = commands.unionByName(saved.select("session_id", "cam_id", "seq", "frame_idx", "label").withColumn("old", F.lit(1)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["old", "seq"], ascending=[False, True], kind="stable")
        left = apply_commands([], list(zip(group["frame_idx"], group["label"], group["seq"], strict=True)))
        out = pd.DataFrame(left, columns=["frame_idx", "label", "seq"])
        out.insert(0, "session_id", group["session_id"].iloc[0])
        out.insert(1, "cam_id", group["cam_id"].iloc[0])
        return out

    return commands.groupBy("session_id", "cam_id").applyInPandas(run, "session_id string, cam_id int, frame_idx int, label string, seq long")


def stamp(events: DataFrame, clock: DataFrame) -> DataFrame:
    """Camera time by frame number; frames past the clock have none. ``place`` is the order by frame, then entry."""
    times = clock.select("session_id", "cam_id", "frame_idx", "ts")
    place = F.row_number().over(Window.partitionBy("session_id", "cam_id").orderBy("frame_idx", "seq"))
    return events.join(times, ["session_id", "cam_id", "frame_idx"], "left").withColumn("place", place)


def label_counts(events: DataFrame) -> DataFrame:
    """Count of each label of each session and camera, zeros included, and the total as ``all``."""
    spark = events.sparkSession
    pairs = events.select("session_id", "cam_id").distinct().join(F.broadcast(definitions(spark).select("cam_id", "label")), "cam_id")  # six fixed rows
    counts = events.groupBy("session_id", "cam_id", "label").agg(F.count(F.lit(1)).alias("n"))
    full = pairs.join(counts, ["session_id", "cam_id", "label"], "left").select("session_id", "cam_id", "label", F.coalesce("n", F.lit(0)).alias("n"))
    return full.union(events.groupBy("session_id", "cam_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", "cam_id", F.lit("all"), "n"))


def near_frame(events: DataFrame, frames: DataFrame, within: int = 3) -> DataFrame:
    """Events closer than ``within`` frames to each wanted (session_id, cam_id, at): an equi-join on the few frames around."""
    around = frames.withColumn("frame_idx", F.explode(F.sequence(F.col("at") - (within - 1), F.col("at") + (within - 1))))
    return around.join(events, ["session_id", "cam_id", "frame_idx"])
