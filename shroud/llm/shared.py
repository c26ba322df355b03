"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own_dir: list[str] = []


class _Written(threading.local):
    """Folders that this thread staged, so that queries in several threads never remove each other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()
#: A leaf of the plan that says it has so many bytes doesn't know.
_UNKNOWN = 1 << 58


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode (tests) one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="shroud-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Removes tables that staged() wrote, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def staged_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, staged; the tables that were staged on the way are removed."""
    before = len(_written.paths)
    out = staged(make(), name)
    on_the_way, _written.paths[before:] = _written.paths[before:-1], _written.paths[-1:]
    for path in on_the_way:
        _delete(out.sparkSession, path)
    return out


def clear(spark: SparkSession) -> None:
    """Removes all tables that staged() wrote in this thread: for after a result is written, as it is read from them."""
    while _written.paths:
        _delete(spark, _written.paths.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions for a shuffle in proportion to the input: a task's share stays the same at any size.

    The input is what the leaves of the plan say of themselves, which for files is their bytes; estimates of joins are not
    used. Where a leaf doesn't know its size (rows of the driver), spark.sql.shuffle.partitions is the least.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(n for n in sizes if n < _UNKNOWN)
    least = 1 if len(sizes) and max(sizes) < _UNKNOWN else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-known // each))


def id_text(col: Column) -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def fold(col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(id_text(col).cast("binary")) % parts


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Rows of an Arrow batch: texts can be long, and workers share an executor's memory with the JVM.
BATCH_ROWS = 1000


def release() -> None:
    """Gives a worker's freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS at most (a setting of the session, lowered here), with memory released at each end."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def lean(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(lean, schema)
