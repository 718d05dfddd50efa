"""Tables behind a synchronised view of microscope and cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.operators.align import FLAGS
from lumatrace.sources.segments import locate


def clip_ranges(lengths: DataFrame, start: int = 1, seconds: float = 180.0, rate: float = 4.605, camera_rate: float = 30.0) -> DataFrame:
    """First and last microscope and camera frame of a clip of (session_id, n_frames)."""
    ratio = camera_rate / rate
    end = F.least(F.col("n_frames"), F.lit(start) + F.round(F.lit(seconds * rate)).cast("int") - 1)
    first = F.greatest(F.lit(1), F.round(F.lit((start - 1) * ratio)).cast("int") + 1)
    return lengths.withColumns({"start_nf": F.lit(start), "end_nf": end}).withColumns({"start_bf": first, "end_bf": F.round(F.col("end_nf") * ratio).cast("int")})


def schedule(clips: DataFrame, seconds: float = 180.0, speed: float = 5.0, fps: float = 30.0, rate: float = 4.605, camera_rate: float = 30.0) -> DataFrame:
    """Microscope and camera frame that each output frame shows, held at the clip's end."""
    total = int(seconds / speed * fps + 0.5)
    out = clips.withColumn("out_frame", F.explode(F.sequence(F.lit(1), F.lit(total))))
    elapsed = (F.col("out_frame") - 1) * F.lit(speed / fps)
    at = lambda first, r, last: F.least(F.col(first) + F.round(elapsed * F.lit(r)).cast("int"), F.col(last))
    return out.select("session_id", "out_frame", at("start_nf", rate, "end_nf").alias("neuron_frame"), at("start_bf", camera_rate, "end_bf").alias("camera_frame"))


def active_flags(flagged: DataFrame, flags=FLAGS) -> DataFrame:
    """Each flag of a frame or one of its neighbours."""
    near = Window.partitionBy("session_id").orderBy("frame_idx").rangeBetween(-1, 1)
    return flagged.select("session_id", "frame_idx", *[F.max(f).over(near).alias(f) for f in flags])


def view_table(shown: DataFrame, flagged: DataFrame, camera_segments: DataFrame) -> DataFrame:
    """The schedule with active flags and, for each camera, segment and local frame; segments have cam_id and frame numbers."""
    placed = shown.join(active_flags(flagged).withColumnRenamed("frame_idx", "neuron_frame"), ["session_id", "neuron_frame"], "left")
    for cam in (1, 2):
        asked = shown.select("session_id", F.col("camera_frame").alias("at"), "out_frame")
        found = locate(asked, camera_segments.filter(F.col("cam_id") == cam)).select("session_id", "out_frame", F.col("segment_name").alias(f"cam{cam}_segment"), F.col("local_frame").alias(f"cam{cam}_frame"))
        placed = placed.join(found, ["session_id", "out_frame"], "left")
    return placed
