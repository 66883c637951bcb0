"""Tables written to the shared folder, used where a plan must be cut.

Every operator that reads an intermediate result more than once writes it as Parquet under the
folder named by ``spark.checkpoint.dir``; a lost executor then costs a reread, never a result.
"""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests, local runs).
LOCAL_DEFAULT = "/tmp/checkpoints"

#: Characters that separate words, as the body of a Java or Python character class.
SPACE_CLASS = r"\x20\x09-\x0D"


#: While a table is written, this setting has Spark delete the shuffle files of its plan at the end; nobody
#: runs that plan again, since all that follows reads the table. A query of the same session that another
#: thread starts meanwhile loses its shuffle files at its end too, which costs it nothing but reuse.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Scopes(threading.local):
    """Of each thread, the open scopes and the paths staged in them."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()
_writing: dict[int, tuple[int, str]] = {}  # of each session that writes: how many writes, and the setting before them
_lock = threading.Lock()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The setting stands from the first of a session's writes under way to the end of the last."""
    with _lock:
        count, before = _writing.get(id(spark), (0, spark.conf.get(SHUFFLE_CLEANUP, "false")))
        _writing[id(spark)] = count + 1, before
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, before = _writing.pop(id(spark))
            if count > 1:
                _writing[id(spark)] = count - 1, before
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def shared_dir(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", "") or LOCAL_DEFAULT).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Write ``df`` to a new folder and return it reread, with the folder's path.

    The folder goes with the application, if nobody drops it earlier: what a returned result is
    read from has no other owner.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", codec)
    if _scopes.open:
        _scopes.open[-1].append(path)
    with _shuffles_dropped(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    drop_at_end(spark, path)
    _relieve(spark)
    return spark.read.schema(df.schema).parquet(path), path


def _place(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _relieve(spark: SparkSession) -> None:
    """Where the driver's heap has grown past half of what it may take, collect what nobody holds any more: frames here
    let go of their plans, and Spark's cleaner, which works behind the collector alone, of broadcasts and shuffles."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        gc.collect()
        runtime.gc()


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads."""
    store, target = _place(spark, path)
    store.delete(target, True)
    store.cancelDeleteOnExit(target)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    store, target = _place(spark, path)
    store.deleteOnExit(target)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[tuple[DataFrame, str]], DataFrame]]:
    """Deletes, at its end and also after an error, all tables staged inside it but those passed to the function it gives."""
    kept: list[str] = []

    def keep(staged: tuple[DataFrame, str]) -> DataFrame:
        kept.append(staged[1])
        return staged[0]

    _scopes.open.append([])
    try:
        yield keep
    finally:
        for path in _scopes.open.pop():
            if path in kept:
                if _scopes.open:
                    _scopes.open[-1].append(path)
            else:
                drop_stage(spark, path)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Adds to ``paths`` the tables staged inside that are still there at its end."""
    _scopes.open.append([])
    try:
        yield
    finally:
        paths += _scopes.open.pop()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
