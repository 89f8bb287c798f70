"""Where notes come from: a folder of Markdown, the star-schema tables, golden queries, summaries."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import frontmatter as fm
from ..functions import text as T
from ..operators.evaluation import shape_problems

GOLDEN = (
    "id string, query string, answerable boolean, category string, slices array<string>, filters map<string,string>, "
    "relevant_evidence array<struct<note_id:string,path:string,heading:string,grade:int>>, required_evidence_groups array<array<string>>, "
    "gold_facts array<string>, forbidden_facts array<string>, _corrupt_record string"
)
SUMMARY = "schema_version int, note_id string, source_fingerprint string, title string, summary string, generated_by string, generator_model string, generated_at string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: provenance from labels, time from events."""
    docs, labels, events = (table(spark, sf_dir, n) for n in ("documents", "labels", "events"))
    origin = F.when(F.col("quality") == 1, "human").when(F.col("quality") == 0, "reference").otherwise("")
    return (
        docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
        .join(events.select(F.col("event_id").alias("doc_id"), F.col("ts").alias("updated")), "doc_id", "left")
        .select(
            "doc_id", F.col("doc_id").cast("string").alias("note_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.col("source").alias("folder"),
            F.col("lang").alias("note_type"), F.array("lang", "source").alias("tags"), F.col("text").alias("body"),
            F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), origin.alias("provenance"), "updated",
        )
    )


def _files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files under ``root`` with their paths below it; those that lead out of it by a link are not there."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/") + "/"
    return reader.load(root).withColumn("file", F.expr(f"substring(path, instr(path, '{base}') + {len(base)})"))


def scan_vault(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = (), ignore_tags: tuple[str, ...] = ("ignore",)) -> DataFrame:
    """Every readable Markdown file under ``root``, with ``skipped``: whether it is no note.

    Files in a skipped or hidden folder and files that are no UTF-8 are not there at all.
    Drawings and files with an ignore tag are skipped.  A block that is no YAML gives no fields
    and stays in the body.  Times are kept as text; ``recency`` is the first of ``updated``,
    ``date`` and ``created`` that is a time; ``date`` falls back from the field ``date`` to
    ``created``, to a date in the file's name and to its modification time.
    """
    files = _files(spark, root, "*.md").filter(~T.skipped_path(F.col("file"), skip_dirs))
    rows = files.filter(F.is_valid_utf8(F.col("content").cast("string"))).select(
        F.col("file").alias("path"), F.decode("content", "UTF-8").alias("raw"), F.col("modificationTime").alias("mtime")
    )
    rows = rows.withColumn("parsed", fm.as_json(fm.block(F.col("raw"))))
    rows = rows.withColumns({"body": fm.body(F.col("raw"), F.col("parsed")), "fields": F.coalesce("parsed", F.lit("{}"))})
    fields = F.col("fields")
    tags = fm.tags_of(fields)
    lowered = F.transform(tags, lambda t: F.lower(F.regexp_replace(t, "^#+", "")))
    ignored = T.has_ignore_tag(F.col("body"), ignore_tags) | F.arrays_overlap(lowered, F.array(*map(F.lit, ignore_tags)))
    drawing = F.lower("path").endswith(".excalidraw.md") | F.array_contains(fm.keys_of(fields), "excalidraw-plugin")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.md$", "")
    named = F.when(stem.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_timestamp(F.concat(stem, F.lit("T00:00:00Z"))))
    own_id = F.when(~F.get_json_object(fields, "$.id").rlike("^[\\[{]"), F.nullif(F.trim(fm.when_field(fields, "id")), F.lit("")))
    text = lambda name: F.coalesce(F.trim(fm.when_field(fields, name)), F.lit("")).alias(name)
    return rows.select(
        F.coalesce(own_id, T.hash62(F.col("path"))).alias("note_id"), own_id.alias("id"), T.is_ulid(own_id).alias("id_is_ulid"),
        "path", F.coalesce(F.nullif(fm.when_field(fields, "title"), F.lit("")), stem).alias("title"), stem.alias("stem"), tags.alias("tags"), fm.aliases_of(fields).alias("aliases"),
        fm.when_field(fields, "created").alias("created"), fm.when_field(fields, "updated").alias("updated"), fm.when_field(fields, "date").alias("date_field"),
        F.date_format(F.coalesce(fm.first_time(fields, "date", "created"), named, F.col("mtime")), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"),
        fm.first_time(fields, "updated", "date", "created").alias("recency"),
        F.coalesce(fm.when_field(fields, "type"), F.lit("")).alias("note_type"), F.lower(text("provenance")).alias("provenance"), text("source_url"), text("source_type"), "raw", "mtime",
        "body", F.when(F.col("parsed").isNotNull(), fm.block(F.col("raw"))).otherwise("").alias("frontmatter_text"), "fields", fm.keys_of(fields).alias("field_names"),
        (F.col("parsed").isNull()).alias("unparsed"), T.sha256(F.col("raw")).alias("content_hash"), F.coalesce(ignored | drawing, F.lit(False)).alias("skipped"),
    )


def read_vault(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = (), ignore_tags: tuple[str, ...] = ("ignore",)) -> DataFrame:
    """Notes of every Markdown file under ``root`` that the rules of ``scan_vault`` leave."""
    return scan_vault(spark, root, skip_dirs, ignore_tags).filter("NOT skipped").drop("skipped")


def vault_counts(scanned: DataFrame) -> DataFrame:
    """One row: notes, and files skipped by a rule."""
    return scanned.agg(F.count_if(~F.col("skipped")).alias("notes"), F.count_if("skipped").alias("ignored"))


def read_attachments(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """Paths of everything but notes, drawings included; contents are not read."""
    rel = _files(spark, root).select(F.col("file").alias("path"))
    low = F.lower("path")
    return rel.filter((~low.endswith(".md") | low.endswith(".excalidraw.md")) & ~T.skipped_path(F.col("path"), skip_dirs))


def read_note(notes: DataFrame, path: str) -> DataFrame:
    """The one note at a path; none for a path that is invalid, missing or left out."""
    return notes.filter((F.col("path") == path) & T.valid_path(F.lit(path)))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries, one JSON object a line; a line that is none has ``_corrupt_record``."""
    return spark.read.schema(GOLDEN).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def _shape(lines: pd.Series) -> pd.Series:
    return lines.map(shape_problems)


def golden_problems(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and problem of what is wrong with the form of the golden queries of one file; blank lines do not count."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    return lines.select((F.col("line") + 1).alias("line"), F.explode(_shape("text")).alias("problem"))


#: The version of a manifest, the keys it must have, and those it may have.
MANIFEST_VERSION = 1
MANIFEST_KEYS = ("eval_schema_version", "name", "corpus_root", "queries_file")
MANIFEST_MORE = ("description", "expected_note_count", "expected_query_count", "privacy", "timestamp_policy", "license_note")


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, list[str]]:
    """The manifest of a golden set, with paths made absolute, and its unknown keys; raises where it is unusable."""
    base = path.rstrip("/").rsplit("/", 1)[0] if path.endswith((".yaml", ".yml")) else path.rstrip("/")
    file = path if path.endswith((".yaml", ".yml")) else f"{base}/dataset.yaml"
    try:
        found = yaml.safe_load(spark.read.text(file, wholetext=True).first()[0])
    except yaml.YAMLError as e:
        raise ValueError(f"{file} is no YAML") from e
    if not isinstance(found, dict):
        raise ValueError(f"{file} is no mapping")
    if gone := [k for k in MANIFEST_KEYS if k not in found]:
        raise ValueError(f"{file} lacks {', '.join(gone)}")
    if found["eval_schema_version"] != MANIFEST_VERSION:
        raise ValueError(f"{file} has version {found['eval_schema_version']!r}, not {MANIFEST_VERSION}")
    whole = {k: v if str(v).startswith("/") or "://" in str(v) else f"{base}/{v}" for k, v in found.items() if k in ("corpus_root", "queries_file")}
    return found | whole, sorted(set(found) - set(MANIFEST_KEYS) - set(MANIFEST_MORE))


CANDIDATES = (
    "candidates array<struct<note_id:string,path:string,title:string,type:string,provenance:string,heading:string,chunk_id:string,line_start:int,line_end:int,excerpt:string,"
    "scores:struct<bm25:double,semantic:double,fused:double,reranker:double,final:double>,why:string>>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of a search that was saved, as they were or in an envelope, in order: their fields, final and place.

    Raises where a candidate has no finite final score or no excerpt.
    """
    whole = spark.read.schema(f"query string, {CANDIDATES}, result struct<query:string,{CANDIDATES.replace(' ', ':', 1)}>").option("multiLine", "true").json(path)
    listed = F.coalesce("candidates", "result.candidates")
    if whole.isEmpty() or whole.filter(listed.isNull()).count():
        raise ValueError(f"{path} holds no results of a search")
    rows = whole.select(F.coalesce("query", "result.query").alias("query"), F.posexplode(listed).alias("place", "c")).select("query", (F.col("place") + 1).alias("place"), "c.*", F.col("c.scores.final").alias("final"))
    bad = rows.filter(F.col("final").isNull() | F.isnan("final") | (F.abs("final") == float("inf")) | F.col("excerpt").isNull()).select("place").limit(1).collect()
    if bad:
        raise ValueError(f"candidate {bad[0].place} of {path} has no finite final score or no excerpt")
    return rows


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary records; ``problem`` names a wrong file name or a repeated note."""
    rows = spark.read.schema(SUMMARY).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_name"))
    many = rows.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("file") == F.concat(T.sha256(F.col("note_id")), F.lit(".json"))
    problem = F.when(~named, "file name").when(F.col("n") > 1, "duplicate")
    return rows.join(many, "note_id").withColumn("problem", problem).drop("n", "file")
