"""Tables that a job leaves for the next one, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application: Spark's setting can't be changed while it runs.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; local mode with none set gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='corpusflow-')}"
        atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), True)
    return _OWN[app]


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_place(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch that a Python worker gets.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, so long rows can't fill their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class SharedTable:
    """Rows written once; ``drop`` once nothing that reads them will run again."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = new_place(self.spark, name)
        df.write.parquet(self.path, compression="zstd")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_place(self.spark, self.path)


def shared_path(where: str) -> str:
    """The path of a place on a file system that every machine mounts."""
    scheme, _, rest = where.partition("://")
    if rest and scheme != "file":
        raise ValueError(f"{where} isn't on a mounted file system")
    path = rest if rest else where.removeprefix("file:")
    return "/" + path.lstrip("/") if where.startswith("file:") else path
