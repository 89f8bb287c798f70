"""Keeping an index of entries in step with the notes: what changed, what is reused, snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking

#: Version of the section layout; entries of another version are cut anew.
SCHEMA_VERSION = 2


def plan(notes: DataFrame, indexed: DataFrame, refresh: bool = False) -> DataFrame:
    """note_id, path, action and reason of every note on either side.

    ``notes``: note_id, path, content_hash, and context_key where summaries are used.
    ``indexed``: the same and schema_version, one row per note.  The first reason that holds
    is told: refresh, context, rechunk (only where nothing else changed), update.
    """
    have = {c: F.col(c).alias(f"old_{c}") for c in ("path", "content_hash", "schema_version", "context_key")}
    for df in (notes, indexed):
        if "context_key" not in df.columns:
            have["context_key"] = F.lit(None).cast("string").alias("old_context_key")
    old = indexed.select("note_id", F.lit(True).alias("in_index"), *have.values())
    new = notes.select("note_id", F.lit(True).alias("on_disk"), "path", "content_hash", F.col("context_key") if "context_key" in notes.columns else F.lit(None).cast("string").alias("context_key"))
    both = new.join(old, "note_id", "full_outer")
    changed = (F.col("content_hash") != F.col("old_content_hash")) | (F.col("path") != F.col("old_path"))
    context = ~F.col("context_key").eqNullSafe(F.col("old_context_key"))
    stale = F.col("old_schema_version") != SCHEMA_VERSION
    reason = (
        F.when(F.col("on_disk").isNull(), "delete").when(F.col("in_index").isNull(), "add").when(F.lit(refresh), "refresh").when(context, "context")
        .when(stale & ~changed, "rechunk").when(changed, "update").otherwise("unchanged")
    )
    action = F.when(reason.isin("delete", "add", "unchanged"), reason).otherwise("update")
    return both.select("note_id", F.coalesce("path", "old_path").alias("path"), action.alias("action"), reason.alias("reason"))


def dry_run(planned: DataFrame) -> DataFrame:
    """action, reason and number of notes; ``planned`` itself has their paths."""
    return planned.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


def _listed(rows: DataFrame, column: str, label: str) -> Column:
    """A line of the header, or null where there is nothing to say."""
    if column not in rows.columns:
        return F.lit(None).cast("string")
    value = F.array_join(column, ", ") if dict(rows.dtypes)[column].startswith("array") else F.col(column).cast("string")
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def lexical_text(rows: DataFrame, text: str = "body", contextual: bool = False) -> Column:
    """What keyword search reads of an entry: a header and its own text.

    ``rows`` have granularity and title; a whole note's header also names its path, tags and
    date, a section's its heading.  A summary counts only if ``contextual``, as it is the same
    in all sections of a note.
    """
    title = F.concat(F.lit("# "), F.coalesce("title", F.lit("")))
    summary = [_listed(rows, "context", "Note summary")] if contextual else []
    own = F.coalesce(F.col(text), F.lit(""))
    whole = F.concat_ws("\n\n", title, _listed(rows, "path", "Path"), _listed(rows, "tags", "Tags"), _listed(rows, "date", "Date"), *summary, F.nullif(T.strip(own), F.lit("")))
    part = F.concat_ws("\n\n", title, F.concat(F.lit("Section: "), F.coalesce(F.nullif("heading", F.lit("")), F.lit("(intro)"))), *summary, own)
    return F.when(F.col("granularity") == "document", T.strip(whole)).otherwise(part)


def entries(notes: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One row per note and one per section: entry_id, granularity, place, text for vectors, text for keywords, offset of the source, hashes, metadata.

    ``context``: note_id and context, a summary that is put before the text that is embedded.
    """
    meta = [c for c in ("note_id", "path", "title", "note_type", "tags", "created", "updated", "date", "provenance", "content_hash") if c in notes.columns]
    rows = notes if context is None else notes.join(context.select("note_id", "context"), "note_id", "left")
    rows = rows if context is not None else rows.withColumn("context", F.lit(None).cast("string"))
    folder = F.regexp_replace("path", "/?[^/]*$", "").alias("folder")
    none = F.lit(None)
    whole = rows.select(
        *meta, "context", folder, F.concat("note_id", F.lit("::doc")).alias("entry_id"), F.lit("document").alias("granularity"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("heading_path"),
        none.cast("string").alias("parent_section_id"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), none.cast("int").alias("token_count"), F.col("body").alias("source"),
    )
    cut = chunking.sections(rows).select(
        *meta, "context", folder, F.col("s.chunk_id").alias("entry_id"), F.lit("section").alias("granularity"), F.col("s.heading").alias("heading"), F.col("s.heading_path").alias("heading_path"),
        F.concat("note_id", F.lit("::p"), F.lpad(F.col("s.parent").cast("string"), 3, "0")).alias("parent_section_id"), F.col("s.line_start").alias("line_start"), F.col("s.line_end").alias("line_end"),
        F.col("s.token_count").alias("token_count"), F.col("s.text").alias("source"),
    )
    out = whole.unionByName(cut)
    text = lexical_text(out, "source", contextual=True)
    out = out.withColumns({"text": text, "lexical": lexical_text(out, "source")})
    # Where the source begins in the text: its header and what separates the two come first.
    own = F.coalesce("source", F.lit(""))
    offset = F.length("text") - F.length(F.when(F.col("granularity") == "document", T.strip(own)).otherwise(own))
    return out.withColumns({"source_offset": offset, "entry_hash": T.sha256(F.col("text")), "section_hash": T.sha256(F.col("source")), "schema_version": F.lit(SCHEMA_VERSION)})


def with_vectors(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """``fresh`` with the vector of a stored entry that has the same text; null where one is needed."""
    old = stored.select("entry_hash", "embedding").filter("embedding IS NOT NULL").dropDuplicates(["entry_hash"])
    return fresh.join(old, "entry_hash", "left")


def reuse(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """How many entries keep a vector and how many need one."""
    kept = with_vectors(fresh, stored)
    return kept.agg(F.count_if(F.col("embedding").isNotNull()).alias("reused"), F.count_if(F.col("embedding").isNull()).alias("needed"))


class Snapshots:
    """Versions of the entries under one folder; a reader sees a whole version or the one before.

    A version is written to a folder of its own, partitioned by granularity so that a search
    reads one of them.  After everything else has succeeded a pointer file is renamed into
    place under the next free number.  Pointers are never changed or taken away, so a reader
    always finds one, and of two writers one gets the number.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _last(self) -> int:
        """Number of the newest pointer; 0 without one."""
        fs, where = self._fs(f"{self.root}/pointers")
        if not fs.exists(where):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _put(self, path: str, value: str) -> None:
        fs, where = self._fs(path)
        out = fs.create(where, True)
        out.write(bytearray(value, "utf-8"))
        out.close()

    def _pointer(self) -> dict | None:
        last = self._last()
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{last:08d}", wholetext=True).first()[0]) if last else None

    def current(self) -> str | None:
        found = self._pointer()
        return found["version"] if found else None

    def publish(self, rows: DataFrame, settings: dict | None = None) -> str:
        version = uuid.uuid4().hex
        rows.write.partitionBy("granularity").parquet(f"{self.root}/{version}")
        self._put(f"{self.root}/next-{version}", json.dumps({"version": version} | (settings or {})))
        fs, source = self._fs(f"{self.root}/next-{version}")
        fs.mkdirs(self._fs(f"{self.root}/pointers")[1])
        while True:
            target = self._fs(f"{self.root}/pointers/{self._last() + 1:08d}")[1]
            if not fs.exists(target) and fs.rename(source, target):
                return version

    def settings(self) -> dict:
        return self._pointer() or {}

    def check(self, **wanted: object) -> None:
        """Raise if the index was made with other settings (model, contextual text)."""
        have = self.settings()
        if odd := {k: (have.get(k), v) for k, v in wanted.items() if have.get(k) != v}:
            raise ValueError(f"the index was made with other settings: {odd}")

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no snapshot under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{version}")
