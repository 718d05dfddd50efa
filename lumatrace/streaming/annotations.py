"""The annotation log as a stream: the table of standing events of each session and camera, and the late commands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumatrace.operators.events import apply_commands, labelled_commands

KEY = ["session_id", "cam_id"]
#: kind: ``version`` (one for each key that a batch touched), ``event`` (stands in that version) or ``late`` (a command).
OUT = "session_id string, cam_id int, kind string, version long, frame_idx int, label string, seq long"
EVENT = "frame_idx int, label string, seq long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Replay(StatefulProcessor):
    """Standing events of a key as list state, and the ``seq`` that was applied last as value state."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.standing = handle.getListState("standing", EVENT, self.ttl_ms)
        self.last = handle.getValueState("last", "seq long", self.ttl_ms)

    def keep(self, standing: list[tuple[int, str, int]], last: int) -> None:
        if standing:
            self.standing.put(standing)
        else:
            self.standing.clear()
        self.last.update((last,))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("seq", kind="stable")
        self.keep([(int(f), n, int(s)) for f, n, s in zip(rows["frame_idx"], rows["label"], rows["seq"], strict=True)], -1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last = self.last.get()[0] if self.last.exists() else -1
        standing = [tuple(e) for e in self.standing.get()] if self.standing.exists() else []
        applied = last
        fresh, late = batch[batch["seq"] > last], batch[~(batch["seq"] > last)]
        if len(fresh):
            standing = apply_commands(standing, [(int(f), n, int(s)) for f, n, s in zip(fresh["frame_idx"], fresh["label"], fresh["seq"], strict=True)])
            last = int(fresh["seq"].max())
            self.keep(standing, last)
        out = [("version", None, None, None)] if len(fresh) else []
        out += [("event", *e) for e in standing] if len(fresh) else []
        out += [("late", *e) for e in zip(late["frame_idx"], late["label"], late["seq"], strict=True)]
        table = pd.DataFrame(out, columns=["kind", "frame_idx", "label", "seq"]).astype({"frame_idx": "Int32", "seq": "Int64"})
        table.insert(0, "session_id", key[0])
        table.insert(1, "cam_id", key[1])
        table.insert(3, "version", table["kind"].map({"late": applied}).fillna(last).astype("int64"))
        yield table

    def close(self) -> None:
        pass


def replay_stream(log: DataFrame, saved: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Rows (``OUT``) for each session and camera that a batch touched, see ``latest`` and ``late`` for the two tables in them.

    Commands of a batch apply in order of ``seq``. Undo depends on order, so a command whose ``seq`` isn't above
    what was applied before, or is null, changes nothing: it comes out as a row of kind ``late``. ``saved``: events
    of an earlier sitting, as in ``events.replay``; they stand first. State is the standing events of a key, tens to
    thousands; ``ttl_ms`` after its last command a key is forgotten, if given. Needs the RocksDB state store,
    which this sets for the session.
    """
    spark = log.sparkSession
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    first = None if saved is None else saved.select(*KEY, *[c.split()[0] for c in EVENT.split(", ")]).groupBy(*KEY)
    return labelled_commands(log).groupBy(*KEY).transformWithStateInPandas(Replay(ttl_ms), OUT, "update", "ProcessingTime" if ttl_ms else "None", first)


def write(updates: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream into ``folder``, a folder for each batch: one that is repeated after a failure replaces its own rows."""

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(**(trigger or {"availableNow": True})).start()


def latest(updates: DataFrame) -> DataFrame:
    """The standing events (session_id, cam_id, frame_idx, label, seq): those of the newest version of each key."""
    newest = updates.filter("kind = 'version'").groupBy(*KEY).agg(F.max("version").alias("version"))
    return updates.filter("kind = 'event'").join(newest, [*KEY, "version"]).select(*KEY, "frame_idx", "label", "seq")


def late(updates: DataFrame) -> DataFrame:
    """The commands that came too late to count, with the ``seq`` that had been applied before them as ``version``."""
    return updates.filter("kind = 'late'").select(*KEY, "frame_idx", "label", "seq", "version")
