"""Shared plumbing: tables in the shared folder, salted group joins, Arrow batch sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated input of a task that maps a table's rows.
SCAN_BYTES = 64 << 20
#: Sub-groups into which the rows of one key are dealt; a key with a third of all rows then gives 1/192 of them to a task.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="tidelane-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Stages of this Python process that still hold tables, and lists that also note new ones.
_LIVE: list[Stage] = []
_NOTED: list[list[Stage]] = []


@contextlib.contextmanager
def noted(into: list[Stage]):
    """Adds every stage that is made inside to the list: its owner closes them once it has written what reads them."""
    _NOTED.append(into)
    try:
        yield
    finally:
        _NOTED.remove(into)


class Stage:
    """Tables of one run in the shared folder. They survive the loss of executors and cut the lineage; drop() removes one that nothing reads any more, the rest go when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidelane-{uuid.uuid4().hex}"
        for held in (_LIVE, *_NOTED):
            held.append(self)

    def write(self, df: DataFrame, name: str, few: bool = False, scan: bool = False) -> DataFrame:
        """df as a table.

        few: in a file for every four partitions of a shuffle, or one a core, for narrow results of many small partitions. scan: for what only maps the rows of a
        table and holds none, in one file a core or for each SCAN_BYTES of what it reads. Tasks then take several partitions one after the other.
        """
        cores = self.spark.sparkContext.defaultParallelism
        if few:
            df = df.coalesce(max(cores, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
        if scan:
            size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            df = df.coalesce(min(max(cores, -(-size // SCAN_BYTES)), (1 << 31) - 1))  # an unknown size counts as huge
        # nobody looks for the mark of a complete table: its reader comes after its writer
        df.write.options(**{"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        if self in _LIVE:
            _LIVE.remove(self)
        try:
            _delete(self.spark, self.root)
        except Exception:  # the JVM may be gone already
            pass


@atexit.register
def _close_all() -> None:
    for stage in list(_LIVE):
        stage.close()


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on after a task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(batches_function):
    """A function from batches to batches that gives freed memory back when its task ends."""

    @functools.wraps(batches_function)
    def run(*args, **kwargs):
        try:
            yield from batches_function(*args, **kwargs)
        finally:
            trim()

    return run


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nobody holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_limits(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that very long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def attach_group(rows: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], salt_on: list[str]) -> DataFrame:
    """rows with aggregates of their key, without bringing the rows of one key into one task.

    partial aggregates rows, final aggregates the partial results. keys must not be null. Each key is dealt into SALTS
    sub-groups: aggregates go up from sub-groups to keys and come back down on (key, sub-group), so a hot key costs a
    task SALTS rows, not all of its rows. rows is read three times: pass a narrow table.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    total = part.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])
    routed = part.select(*keys, "_salt").join(total, keys)
    return salted.join(routed, [*keys, "_salt"]).drop("_salt")
