"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatrace.session import shared_dir

#: Bytes of text that one step of vectorised work holds at a time.
CHUNK_BYTES = 1 << 20
#: Rows in a batch that a Python worker gets: texts may be long, and a worker's share of memory is small.
BATCH_ROWS = 1000


class Folders(threading.local):
    """Folders that ``materialize`` has written in this thread and ``discard`` hasn't removed: queries that run side by side don't see each other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)

    def __getitem__(self, at):
        return self.paths[at]


WRITTEN = Folders()


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/lumatrace-{uuid.uuid4().hex}"
    WRITTEN.paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders of ``materialize``: all of ``WRITTEN`` once the results are written, or what nothing refers to any more."""
    for path in list(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.paths.remove(path)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers, and the next task's may be others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_ROWS rows; a smaller setting of the session stays.

    A worker's memory is given back at the end of each task.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))
    return df.mapInArrow(whole, schema)


def text_key(text: str = "text"):
    """A hash of a text that tells null from empty; with doc_id it names a document's content.

    Rows with the same doc_id and text have the same result, so the pair serves as a key even if
    rows repeat.
    """
    return F.xxhash64(F.col(text), F.col(text).isNull())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hash_sample(rows: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """At most ``most`` of ``n`` rows, by the least hash of ``key``.

    Rows beyond one and a half times the share that is wanted go by a filter, so that what tasks hand to
    the driver is about the sample, however many tasks there are.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    near = rows.filter(place < int((1 << 30) * min(1.0, 1.5 * most / max(1, n))) + 1)
    return near.orderBy(place, key).limit(most)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with a column ``name``: each row's place, from 0, in the order of all rows; written once.

    Rows are dealt by range and sorted within partitions; a partition's first place is the number of rows in
    those before it, one number for each partition. Equal rows stand in any order. For ties that hold many
    rows, let ``order`` end in something that tells them apart, or they meet in one partition.
    """
    spark = rows.sparkSession
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    firsts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "__part long, __first long")
    joined = placed.join(F.broadcast(firsts), part == F.col("__part"))
    return joined.withColumn(name, F.col("__at") - F.shiftleft(part, 33) + F.col("__first")).drop("__at", "__part", "__first")


def blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without copies, and its n + 1 offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about ``most`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
