"""What the star-schema tables do not hold, made from their rows: a vault with links, and a few scores.

Each column is an expression that Spark and DuckDB both read, so a query and its SQL twin start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID, _TEN, _TWENTY = "cast(doc_id AS STRING)", "cast(cast(floor(doc_id / 10) AS BIGINT) % 5 AS STRING)", "cast(cast(floor(doc_id / 20) AS BIGINT) AS STRING)"

#: Links that stand in the body of a note: to titles, stems, paths, aliases, itself, files, nothing, and inside code.
_LINKS = f"""
  '[[Doc ' || cast(doc_id * 7 % 1000 AS STRING) || ']] and [[doc ' || cast(doc_id * 11 % 1000 AS STRING) || '|shown]] ' ||
  CASE WHEN doc_id % 6 = 0 THEN '[[alias ' || cast(doc_id + 1 AS STRING) || '#part]] [[' || cast(doc_id + 2 AS STRING) || ']]' ELSE '' END || chr(10) ||
  CASE WHEN doc_id % 4 = 1 THEN '[[f' || {_TEN} || '/' || {_ID} || ']] ![[pic' || cast(doc_id % 70 AS STRING) || '.png]] [[Ghost ' || cast(doc_id % 50 AS STRING) || ']]' ELSE '' END || chr(10) ||
  CASE WHEN doc_id % 8 = 3 THEN '```' || chr(10) || '[[Hidden ' || {_ID} || ']]' || chr(10) || '```' || chr(10) || '`[[Inline]]` [[Ghost]]' ELSE '' END
"""

VAULT = {
    "doc_id": "doc_id",
    "path": f"CASE WHEN doc_id % 50 = 7 THEN 'f' || {_TEN} || '/' || cast(doc_id - 1 AS STRING) || ' 2.md' ELSE 'f' || {_TEN} || '/' || {_ID} || '.md' END",
    "title": f"CASE WHEN doc_id % 20 = 0 THEN 'Pair ' || {_TWENTY} WHEN doc_id % 20 = 1 THEN 'PAIR ' || {_TWENTY} ELSE 'Doc ' || {_ID} END",
    "alias": f"CASE WHEN doc_id % 7 = 0 THEN 'Alias ' || {_ID} END",
    "id": "CASE WHEN doc_id % 12 <> 5 THEN 'id' || cast(CASE WHEN doc_id % 60 = 2 THEN doc_id - 1 ELSE doc_id END AS STRING) END",
    "created": "CASE WHEN doc_id % 15 = 4 THEN 'some day' WHEN doc_id % 15 = 6 THEN '2024-01-02T03:04:05' WHEN doc_id % 15 <> 8 THEN '2024-01-02T03:04:05Z' END",
    "updated": "CASE WHEN doc_id % 14 <> 3 THEN '2024-02-03T04:05:06+02:00' END",
    "note_type": "CASE WHEN doc_id % 9 = 0 THEN 'distilled' ELSE lang END",
    "provenance": "CASE WHEN doc_id % 27 = 1 THEN 'distilled' WHEN quality = 1 THEN 'human' WHEN quality = 0 THEN 'reference' ELSE '' END",
    "source_url": "CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN 'https://x.example' END",
    "source_type": "CASE WHEN doc_id % 11 = 2 THEN 'LLM ' WHEN doc_id % 11 = 3 THEN 'web' ELSE '' END",
    "recency": "ts",
    "frontmatter_text": "CASE WHEN doc_id % 10 = 9 THEN 'type: note' || chr(10) || 'parents: \"[[Doc ' || cast(doc_id * 3 % 1000 AS STRING) || ']]\"' ELSE '' END",
    "body": f"""CASE WHEN doc_id % 10 = 8 THEN ' short ' ELSE coalesce(text, '') || chr(10) || {_LINKS} END ||
      CASE WHEN doc_id % 9 = 0 OR doc_id % 27 = 1 THEN chr(10) || '## Sources' || chr(10) || '- [[Doc ' || cast(doc_id * 13 % 1000 AS STRING) || ']]' || chr(10) || '- [[Lost ' || {_ID} || ']]' || chr(10) ||
        '# After' || chr(10) || '[[Doc 3]]' ELSE '' END""",
}

VAULT_SQL = f"SELECT {', '.join(f'{v} AS {k}' for k, v in VAULT.items())} FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN (SELECT event_id AS doc_id, ts FROM events) AS e USING (doc_id)"

#: Files that are no notes: a picture for each page.
FILES_SQL = "SELECT 'img/Pic' || cast(page_id AS STRING) || '.png' AS path FROM pages"


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault with the columns that the health checks need."""
    docs, labels, events = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "events"))
    rows = docs.join(labels, "doc_id", "left").join(events.select(F.col("event_id").alias("doc_id"), "ts"), "doc_id", "left")
    rows = rows.selectExpr(*(f"{v} AS `{k}`" for k, v in VAULT.items()))
    own = F.struct(*(F.col(c) for c in ("id", "created", "updated")))
    names = F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("id", "created", "updated"))), lambda c: c.isNotNull())
    aliases = F.array_compact(F.array("alias"))
    return rows.withColumns({"aliases": aliases, "fields": F.to_json(own), "field_names": names, "note_id": F.coalesce("id", F.col("doc_id").cast("string"))})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("img/Pic"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
