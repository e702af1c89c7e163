"""Settings and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()
#: Arrow batches of this size at most, where the session says nothing else: whole texts are held twice.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, which may not have it on their path."""
    if ARROW_BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*ARROW_BATCH)
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        root = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(os.path.realpath(tempfile.mkdtemp()) + f"/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)


def release() -> None:
    """Gives freed memory back to the system; allocators keep it for a process that may wait for long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with release() at the end of each task: Spark keeps its Python workers for later tasks,
    and where a task runs two of them, more are kept than work at a time."""
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()
    return through


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. It is set here only where it is unset and the
    master is local, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a checkpoint in the shared folder, so that they are worked out once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))
    return df.checkpoint()


def settle(df: DataFrame) -> DataFrame:
    """The rows of df from a table written in the shared folder.

    For loops: unlike a checkpoint, a table does not bring along the constraints of the plan that
    made it, which grow with every round. The tables stay until drop() or until the folder is cleared.
    """
    folder = shared_dir(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that settle() wrote, and whose rows nothing reads any more."""
    for table_ in tables:
        jvm, conf = table_.sparkSession.sparkContext._jvm, table_.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table_.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def only(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns alone, so that other columns of the input cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
