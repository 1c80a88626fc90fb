"""Tables written to the folder that a cluster shares, which cut lineage and survive lost executors."""

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "file:///tmp/checkpoints"
_RECORDS: ContextVar[tuple] = ContextVar("records", default=())


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that the driver and all executors share; it goes when the application ends.

    The folder is the session's spark.checkpoint.dir. A folder of our own serves
    only where that is unset and all runs in one process; on a cluster each
    executor would write to its own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_FOLDER
    folder = f"{base.rstrip('/')}/lexweft-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/{label}"


def write_shared(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``materialize`` with the path of what it wrote, for ``discard``."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    for record in _RECORDS.get():
        record.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that ``write_shared`` wrote, when nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def recorded():
    """A list of the paths of all tables that this thread writes to the shared folder meanwhile, for ``discard``."""
    paths: list[str] = []
    token = _RECORDS.set((*_RECORDS.get(), paths))
    try:
        yield paths
    finally:
        _RECORDS.reset(token)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read and not a recomputation of all that
    came before.
    """
    return write_shared(df, label)[0]
