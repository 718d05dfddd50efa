"""Alignment of scored events to microscope frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions.columns import seconds_between

FLAGS = ("Soft_touch", "Strong_touch", "Mechanic_pain", "Thermo_pain", "Mouse_reaction", "Reaction_offset")
CAMERA_FLAGS = {1: FLAGS[:4], 2: FLAGS[4:]}


def nearest_frame(events: DataFrame, clock: DataFrame, rate: float, ticks_together: int = 64) -> DataFrame:
    """Add ``neuron_frame``, the frame nearest in time, to events (session_id, ..., ts); further off than 1/rate they go.

    Ticks and events are laid on one time line; the last tick before and the first after an event are the candidates,
    and the earlier one wins a tie. No event meets all ticks. A session's line is cut into stretches of about
    ``ticks_together`` intervals, so that a long session spreads over many tasks; since nothing further off than
    1/rate counts, a tick is given to the stretch beside its own only that close to the cut. Events without time go,
    as nothing is near them, and so do ticks.
    """
    keep = [c for c in events.columns if c not in ("session_id", "ts")]
    reach, width = math.ceil(1e6 / rate) + 1, max(1, math.ceil(ticks_together * 1e6 / rate))
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    stretch = lambda us: F.floor(us / F.lit(float(width)))
    ticks = clock.filter("ts IS NOT NULL").select("session_id", F.explode(F.sequence(stretch(at - reach), stretch(at + reach))).alias("stretch"), "ts", F.struct("ts", "frame_idx").alias("tick"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in keep], F.lit(0).alias("kind"))
    marks = events.filter("ts IS NOT NULL").select("session_id", stretch(at).alias("stretch"), "ts", F.lit(None).cast(ticks.schema["tick"].dataType).alias("tick"), *keep, F.lit(1).alias("kind"))
    part = Window.partitionBy("session_id", "stretch")
    line = part.orderBy("ts", "kind", F.col("tick.frame_idx").desc())
    back = part.orderBy(F.col("ts").desc(), F.col("kind"), F.col("tick.frame_idx").desc())
    both = ticks.unionByName(marks).withColumns({"before": F.last("tick", True).over(line), "after": F.last("tick", True).over(back)}).filter("kind = 1")
    to_before, to_after = seconds_between(F.col("ts"), F.col("before.ts")), seconds_between(F.col("after.ts"), F.col("ts"))
    use_before = F.col("after").isNull() | (F.col("before").isNotNull() & (to_before <= to_after))
    chosen = both.withColumn("neuron_frame", F.when(use_before, F.col("before.frame_idx")).otherwise(F.col("after.frame_idx"))).withColumn("gap", F.when(use_before, to_before).otherwise(to_after))
    return chosen.filter(F.col("gap") <= F.lit(1.0 / rate)).select("session_id", "ts", *keep, "neuron_frame")


def reconcile(clock: DataFrame, dff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both cut to the shorter length of their session."""
    a = clock.groupBy("session_id").agg(F.max("frame_idx").alias("a"))
    b = dff.groupBy("session_id").agg(F.max("frame_idx").alias("b"))
    n = a.join(b, "session_id").select("session_id", F.least("a", "b").alias("n_common"))
    cut = lambda df: df.join(n, "session_id").filter(F.col("frame_idx") <= F.col("n_common")).drop("n_common")
    return cut(clock), cut(dff)


def by_ratio(events: DataFrame, lengths: DataFrame, camera_rate: float = 30.0, rate: float = 4.605) -> DataFrame:
    """Frames from camera frames by the ratio of rates, for events without time; inside the recording, once each."""
    frame = F.round(F.col("frame_idx") / F.lit(camera_rate / rate)).cast("int")
    mapped = events.withColumn("neuron_frame", frame).join(lengths, "session_id")
    return mapped.filter("neuron_frame BETWEEN 1 AND n_frames").select("session_id", "cam_id", "label", "neuron_frame").distinct()


def with_label(events: DataFrame, label: str | None) -> DataFrame:
    """Events of a label, or all without one."""
    return events if label is None else events.filter(F.col("label") == label)


def legacy_labels(mapped: DataFrame) -> DataFrame:
    """Old label names: without Soft_touch in a session, ``Stimuli_given`` and ``A`` of camera 1 stand for it; without Mouse_reaction, ``A`` of camera 2 does."""
    has = mapped.groupBy("session_id").agg(F.max((F.col("label") == "Soft_touch").cast("int")).alias("soft"), F.max((F.col("label") == "Mouse_reaction").cast("int")).alias("mouse"))
    first = (F.col("soft") == 0) & (F.col("cam_id") == 1) & F.col("label").isin("Stimuli_given", "A")
    second = (F.col("mouse") == 0) & (F.col("cam_id") == 2) & (F.col("label") == "A")
    label = F.when(first, "Soft_touch").when(second, "Mouse_reaction").otherwise(F.col("label"))
    return mapped.join(has, "session_id").withColumn("label", label).drop("soft", "mouse")


def one_hot(frames: DataFrame, marks: DataFrame, flags=FLAGS) -> DataFrame:
    """A boolean column for each flag over all (session_id, frame_idx); repeated marks count once."""
    known = marks.filter(F.col("label").isin(*flags))
    wide = known.groupBy("session_id", "frame_idx").agg(*[F.bool_or(F.col("label") == f).alias(f) for f in flags])
    joined = frames.select("session_id", "frame_idx").join(wide, ["session_id", "frame_idx"], "left")
    return joined.select("session_id", "frame_idx", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


def any_event(flagged: DataFrame, flags=FLAGS) -> DataFrame:
    found = F.lit(False)
    for f in flags:
        found = found | F.col(f)
    return flagged.withColumn("any_event", found)


def originals(events: DataFrame) -> DataFrame:
    """The scored events of each session and camera as one sorted array of (frame, label, ts)."""
    return events.groupBy("session_id", "cam_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "label", "ts"))).alias("events"))


def metadata(flagged: DataFrame, dff: DataFrame, rate: float, camera_rate: float = 30.0, flags=FLAGS) -> DataFrame:
    """One row a session: rates, frames, cells, count of each flag, the names of the flags and when it was ``created``."""
    counts = flagged.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_frames"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])
    cells = dff.select("session_id", "cell_id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return counts.join(cells, "session_id", "left").withColumns({"rate": F.lit(rate), "camera_rate": F.lit(camera_rate), "columns": F.lit(",".join(flags)), "created": F.current_timestamp()})


def merged(dff: DataFrame, clock: DataFrame, flagged: DataFrame) -> DataFrame:
    """dF/F with time and flags on (session_id, frame_idx)."""
    return dff.join(clock, ["session_id", "frame_idx"]).join(flagged, ["session_id", "frame_idx"])
