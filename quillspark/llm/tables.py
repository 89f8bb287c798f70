"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a Parquet table, never by a local checkpoint, so a lost executor
costs a re-read and not a failed job.
"""

from __future__ import annotations

import ctypes
import inspect
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of Parquet, that is sent to every executor.  Beyond it the same
#: join is left to Spark, which shuffles both sides.
BROADCAST_BYTES = 24 << 20

#: Column of a row's key.
KEY = "__row"

#: Bytes of an Arrow batch that holds texts; one longer text is a batch of its own.
BATCH_BYTES = 8 << 20

_RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, the warehouse of a session that runs in one process; a cluster must
    name a folder that all its machines see.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillspark-tables"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillspark-{_RUN}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` and return what reads it back, with its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes stored under ``path``, on any file system that Hadoop reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_measured(small: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` written and read again, marked for broadcast only if it has at most ``limit`` bytes."""
    kept, path = stored(small, name)
    return F.broadcast(kept) if size_of(small.sparkSession, path) <= limit else kept


def join_measured(large: DataFrame, small: DataFrame, on: str, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Left join with ``small`` written and measured first.

    At most ``limit`` bytes are broadcast; a larger table takes Spark's own join, so the
    result is the same at every size.
    """
    return large.join(broadcast_measured(small, name, limit), on, "left")


def keyed(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with a key: whether the id is null, the id, and 128 bits hashed from every column.

    Only rows that are equal in every column share a key.  Keys sort by id, null last.
    """
    every = [x for c in rows.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    one, two = F.xxhash64(*every).alias("a"), F.xxhash64(F.lit(1), *every).alias("b")
    return rows.withColumn(KEY, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), one, two))


def join_rows(rows: DataFrame, small: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """Keyed ``rows`` joined with ``small`` on the 128 bits of the key, written and measured first."""
    kept = broadcast_measured(small.withColumns({"__a": F.col(f"{KEY}.a"), "__b": F.col(f"{KEY}.b")}).drop(KEY), name)
    return rows.join(kept, (rows[KEY]["a"] == kept["__a"]) & (rows[KEY]["b"] == kept["__b"]), how)


def one_of_equal(rows: DataFrame, name: str) -> DataFrame:
    """Keyed ``rows``, one of those that are equal in every column."""
    again, _ = stored(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(KEY), f"{name}-again")
    if not again.isEmpty():
        twice = join_rows(rows, again, f"{name}-twice", "left_semi").dropDuplicates([KEY])
        rows = join_rows(rows, again, f"{name}-once", "left_anti").unionByName(twice)
    return rows


def all_but_gone(docs: DataFrame, gone: DataFrame, id_col: str, name: str) -> DataFrame:
    """``docs`` without the rows whose keys ``gone`` has; rows equal in every column become one."""
    rows = join_rows(keyed(docs, id_col), gone.select(KEY).distinct(), name, "left_anti")
    return one_of_equal(rows, name).drop(KEY)


def all_but_least(docs: DataFrame, placed: DataFrame, id_col: str, name: str) -> DataFrame:
    """Of the rows of each ``component`` in ``placed`` (keys with their component), the least key's."""
    placed, _ = stored(placed, f"{name}-placed")
    least, _ = stored(placed.groupBy("component").agg(F.min(KEY).alias("__least")), f"{name}-least")
    return all_but_gone(docs, placed.join(least, "component").filter(~F.col(KEY).eqNullSafe(F.col("__least"))), id_col, name)


def hold_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` where the session has Spark's default of 64 MB.

    The setting stays in the session, as plans are run after they are made.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Give memory that is no longer used back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rested(f: Callable) -> Callable:
    """An Arrow function that gives back what it no longer uses when a task ends.

    Workers outlive their tasks and wait for others; what each of them keeps adds up beside the
    executor's own memory.
    """
    if next(iter(inspect.signature(f).parameters.values())).name == "table":

        def whole(table: pa.Table) -> pa.Table:
            try:
                return f(table)
            finally:
                give_back()

        return whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
