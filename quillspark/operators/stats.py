"""Counts of an index of notes and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stats(notes: DataFrame) -> DataFrame:
    """One row: notes, folders, tags, dated notes and notes by provenance.

    Tags are counted as a set per task first, so one pass serves all counts.
    """
    tags = notes.select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag")).scalar()
    return notes.agg(
        F.count(F.lit(1)).alias("notes"), F.count_distinct("folder").alias("folders"), F.count_if(F.col("updated").isNotNull()).alias("dated"),
        F.count_if(F.col("provenance") == "human").alias("human"), F.count_if(F.col("provenance") == "reference").alias("reference"),
    ).withColumn("tags", tags)


def provenance_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("provenance").agg(F.count(F.lit(1)).alias("n"))


def reader_stats(entries: DataFrame, contextual: bool = True) -> DataFrame:
    """One row about an index of ``sync.entries``: notes, entries, sections, folders, tags, dated notes, and how well summaries cover it.

    ``entries`` also have context_eligible and context_status.  Where summaries are off nothing is stale.
    """
    whole, part = F.col("granularity") == "document", F.col("granularity") == "section"
    eligible, ready = F.count_if(part & F.col("context_eligible")), F.count_if(part & (F.col("context_status") == "ready"))
    tags = entries.filter(whole).select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag")).scalar()
    stale = F.greatest(F.lit(0), eligible - ready) if contextual else F.lit(0)
    cover = F.when(eligible > 0, F.round(ready / eligible, 4)).otherwise(1.0) if contextual else F.lit(1.0)
    told = entries.agg(
        F.count_if(whole).alias("total_documents"), F.count(F.lit(1)).alias("total_entries"), F.count_if(part).alias("section_entries"), F.count_distinct(F.when(whole & (F.col("folder") != ""), F.col("folder"))).alias("unique_folders"),
        F.count_if(whole & (F.coalesce("date", F.lit("")) != "")).alias("dated_notes"), eligible.alias("eligible_sections"), ready.alias("ready_sections"), stale.alias("stale_sections"), cover.alias("context_coverage"),
        F.count_if(whole & (F.col("context_status") == "missing")).alias("missing_notes"), F.count_if(whole & (F.col("context_status") == "stale")).alias("stale_notes"),
    )
    return told.withColumn("unique_tags", tags)
