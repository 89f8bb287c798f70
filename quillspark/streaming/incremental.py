"""Keeping the index in step with a folder that grows: a file stream that runs what is new.

Each micro-batch is what ``operators.sync`` classifies against the current snapshot, so a batch
that is run again after a failure finds its notes unchanged and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sync

NOTE = "note_id string, path string, title string, body string, content_hash string, updated timestamp"


def note_stream(spark: SparkSession, path: str, schema: str = NOTE) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest(notes: DataFrame) -> DataFrame:
    """The last version of each note in a batch."""
    w = Window.partitionBy("note_id").orderBy(F.desc("updated"), F.desc("content_hash"))
    return notes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(snapshots: sync.Snapshots, batch: DataFrame) -> str | None:
    """Publish the snapshot with the batch's new and changed notes; null if there are none."""
    fresh = latest(batch)
    if snapshots.current() is None:
        return snapshots.publish(sync.entries(fresh))
    old = snapshots.read()
    known = old.filter("granularity = 'document'").select("note_id", "path", "content_hash", "schema_version")
    due = sync.plan(fresh, known).filter("action IN ('add', 'update')").select("note_id")
    changed = fresh.join(due, "note_id", "left_semi")
    if changed.isEmpty():
        return None
    rows = sync.entries(changed)
    return snapshots.publish(old.join(due, "note_id", "left_anti").unionByName(rows, allowMissingColumns=True))


def run(spark: SparkSession, source: str, root: str, checkpoint: str, told: Callable[[int, str | None], None] | None = None) -> StreamingQuery:
    """Take in all files that are new since the checkpoint, then stop."""
    snapshots = sync.Snapshots(spark, root)

    def each(batch: DataFrame, number: int) -> None:
        version = upsert(snapshots, batch)
        if told:
            told(number, version)

    return note_stream(spark, source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and type; windows close when the watermark passes them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    told = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return told.select(F.col("window.start").alias("start"), "event_type", "n", "total")
