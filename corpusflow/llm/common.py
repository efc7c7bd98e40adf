"""Helpers that the operators of this package share: shared-folder tables, Arrow limits, folds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; with MAX_BATCH_BYTES it bounds a worker's memory.
MAX_BATCH_ROWS = 2000
MAX_BATCH_BYTES = 4 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, so long texts cannot fill their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MAX_BATCH_BYTES))


#: Folders of our own, by application: Spark's setting can't be changed while it runs.
_OWN: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only in local mode with none set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='corpusflow-')}"
        atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), True)
    return _OWN[app]


_SCRATCH: list[list[Stored]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for lasting ones."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for table in _SCRATCH.pop():
            table.drop()


class Stored:
    """A table written once to the shared folder: lineage is cut, and every reader sees the same rows."""

    def __init__(self, df: DataFrame, name: str, lasting: bool = False) -> None:
        self.spark = df.sparkSession
        if _SCRATCH and not lasting:
            _SCRATCH[-1].append(self)
        self.path = f"{checkpoint_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path, compression="zstd")
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once no DataFrame that reads them will run again."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A table of up to so many bytes goes out as a broadcast, more is joined.
BROADCAST_BYTES = 32 << 20


def sized(small: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A stored table of rows of at most ``row_bytes`` as a broadcast if it is small enough, else as it is."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    return Stored(df, name, lasting).read()


class Bucketed(Stored):
    """A table stored in buckets of one column: joins on it shuffle the other side only."""

    def __init__(self, df: DataFrame, column: str, name: str) -> None:
        self.spark, self.schema = df.sparkSession, df.schema
        if _SCRATCH:
            _SCRATCH[-1].append(self)
        self.table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_dir(self.spark).rstrip('/')}/{self.table}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(buckets, column).option("path", self.path).option("compression", "zstd").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        super().drop()


def by_fewer_keys(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings in which tables that lie by some of a join's keys aren't shuffled
    for it; the caller's own session stays as it is."""
    other = spark.newSession()
    for row in spark.sql("SET").collect():
        if row.key.startswith("spark.sql.") and spark.conf.isModifiable(row.key):
            other.conf.set(row.key, row.value)
    other.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return other


def distinct_texts(df: DataFrame, text: str, least_bytes: int = 0) -> Bucketed:
    """tkey, text, copies: every text of ``least_bytes`` or more once, in buckets of its 16-byte name.

    A task sends a text at most once, so a text that a third of the rows hold makes no large group.
    """
    rows = df.select(text_key(F.col(text)).alias("tkey"), F.col(text).alias("text")).where(F.octet_length("text") >= least_bytes)
    return Bucketed(rows.groupBy("tkey").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "tkey", "texts")


#: Vectors that one step of a sum adds, and their bytes.
FAN_IN, FAN_IN_BYTES = 64, 64 << 20


def summed(df: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], size: int, parts: int | None = None) -> np.ndarray:
    """The sum of ``count`` over all batches of ``df``, a vector of ``size``: by task, then in a tree whose
    steps, the driver's last one among them, add a bounded number of vectors.  ``parts``: partitions, if known."""
    fan_in = max(2, min(FAN_IN, FAN_IN_BYTES // (8 * size)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += count(batch)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "counts": [total.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py()) for c in table["counts"])
        return pa.table({"part": pa.array([table["part"][0].as_py() // fan_in], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts, sums = parts or df.rdd.getNumPartitions(), df.mapInArrow(local, "part long, counts binary")
    while parts > fan_in:
        sums = sums.groupBy(F.floor(F.col("part") / fan_in)).applyInArrow(add, "part long, counts binary")
        parts = -(-parts // fan_in)
    return sum((np.frombuffer(r.counts) for r in sums.collect()), np.zeros(size))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column, folds: int, fold_no: int = 2) -> Column:
    """True for rows of the held-out fold; a row without an id belongs to the training part."""
    return F.coalesce(fold(doc_id, folds) == fold_no, F.lit(False))


def text_key(text: Column) -> Column:
    """16 bytes that name a text's content; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))
