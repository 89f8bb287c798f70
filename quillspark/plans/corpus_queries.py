"""More registered queries over whole tables: frontmatter, links, entries, summaries, plans, answers, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import text as T
from ..operators import backfill, dense, enrich, evaluation, health, links, stats, summaries, sync, synthesis
from ..sources.notes import notes_view, table
from ..streaming import incremental
from . import planted
from .catalog import _LINKS, _NOTES, _VAULT
from .registry import query

# --- frontmatter and small functions ---------------------------------------------------------------

_RAW = """CASE doc_id % 7 WHEN 0 THEN '---' || chr(10) || 'title: "Note ' || {id} || '"' || chr(10) || 'tags: [a, " b ", ""]' || chr(10) || '---' || chr(10) || chr(10) || text
  WHEN 1 THEN '---' || chr(10) || 'a: [' || chr(10) || '---' || chr(10) || text WHEN 2 THEN '---' || chr(10) || '- a' || chr(10) || '  ---  ' || chr(10) || text
  WHEN 3 THEN '---' || chr(10) || 'never closed' || chr(10) || text WHEN 4 THEN '---' || chr(10) || '---' || chr(10) || text
  WHEN 5 THEN '---' || chr(10) || 'tags: x, y ,,z' || chr(10) || 'aliases: Two words' || chr(10) || 'updated: 2024-05-06' || chr(10) || '---' || chr(10) || text ELSE text END""".format(id="cast(doc_id AS STRING)")


def _raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_RAW} AS raw")
    return rows.withColumn("parsed", fm.as_json(fm.block(F.col("raw"))))


@query(f"""WITH r AS (SELECT doc_id, text, {_RAW} AS raw FROM documents)
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'title: "Note ' || doc_id || '"' || chr(10) || 'tags: [a, " b ", ""]' || chr(10) WHEN 1 THEN 'a: [' || chr(10) WHEN 2 THEN '- a' || chr(10)
  WHEN 5 THEN 'tags: x, y ,,z' || chr(10) || 'aliases: Two words' || chr(10) || 'updated: 2024-05-06' || chr(10) ELSE '' END AS block,
sha256(CASE WHEN doc_id % 7 IN (0, 2, 4, 5) THEN ltrim(text, chr(10)) ELSE raw END) AS body_sha256, doc_id % 7 = 1 AS unparsed FROM r WHERE doc_id % 7 <> 3 OR NOT regexp_matches(text, '(?m)^[ \\t]*---[ \\t]*$')""")
def frontmatter_split(spark, sf_dir):
    rows = _raws(spark, sf_dir)
    return rows.select("doc_id", fm.block(F.col("raw")).alias("block"), T.sha256(fm.body(F.col("raw"), F.col("parsed"))).alias("body_sha256"), F.col("parsed").isNull().alias("unparsed"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'a|b' WHEN 5 THEN 'x|y|z' ELSE '' END AS tags, CASE doc_id % 7 WHEN 5 THEN 'Two words' ELSE '' END AS aliases,
CASE doc_id % 7 WHEN 0 THEN 'Note ' || doc_id END AS title, CASE doc_id % 7 WHEN 5 THEN '2024-05-06' END AS updated FROM documents""")
def frontmatter_fields(spark, sf_dir):
    fields = F.coalesce("parsed", F.lit("{}"))
    rows = _raws(spark, sf_dir)
    return rows.select(
        "doc_id", F.array_join(fm.tags_of(fields), "|").alias("tags"), F.array_join(fm.aliases_of(fields), "|").alias("aliases"), fm.when_field(fields, "title").alias("title"),
        F.date_format(fm.first_time(fields, "updated", "date"), "yyyy-MM-dd").alias("updated"),
    )


@query("""SELECT doc_id, list_filter(list_transform(CASE WHEN doc_id % 2 = 0 THEN string_split(lang || ', ' || source || ' ,', ',') ELSE regexp_split_to_array(' ' || lang || '  ' || source, '\\s+') END, lambda t: trim(t)), lambda t: t <> '') AS tags FROM documents""")
def split_tags(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(", "), "source", F.lit(" ,"))).otherwise(F.concat(F.lit(" "), "lang", F.lit("  "), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.split_tags(raw).alias("tags"))


_CJK = "[\\x{2e80}-\\x{2eff}\\x{3000}-\\x{303f}\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"


@query(f"""WITH t AS (SELECT doc_id, text || ' 日本語' || doc_id || 'テスト、漢 字' AS text FROM documents)
SELECT doc_id, list_sum(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'), lambda w: greatest(len(regexp_extract_all(w, '{_CJK}')), 1)))::BIGINT AS tokens FROM t""")
def token_counts_cjk(spark, sf_dir):
    text = F.concat("text", F.lit(" 日本語"), F.col("doc_id").cast("string"), F.lit("テスト、漢 字"))
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(text).cast("long").alias("tokens"))


@query("""WITH s AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '' ELSE ' ago' END AS raw, ts FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN left(raw, 10) ELSE strftime(ts, '%-d %b %Y') END AS short, CASE WHEN event_id % 3 = 2 THEN 'unparseable' WHEN event_id % 3 = 1 THEN 'naive' END AS problem FROM s""")
def time_problems(spark, sf_dir):
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "").otherwise(" ago"))
    return table(spark, sf_dir, "events").select("event_id", T.short_date(raw).alias("short"), T.timestamp_problem(raw, "offset").alias("problem"))


@query("""WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '01ARZ3NDEKTSV4RRFFQ69G5FAV' WHEN 1 THEN upper(left(md5(text), 26)) WHEN 2 THEN left(md5(text), 26) END AS id FROM documents)
SELECT doc_id, coalesce(length(id) = 26 AND length(translate(id, '0123456789ABCDEFGHJKMNPQRSTVWXYZ', '')) = 0, false) AS ulid FROM i""")
def ulid_ids(spark, sf_dir):
    n = F.col("doc_id") % 4
    made = F.substring(F.md5("text"), 1, 26)
    own = F.when(n == 0, "01ARZ3NDEKTSV4RRFFQ69G5FAV").when(n == 1, F.upper(made)).when(n == 2, made)
    return table(spark, sf_dir, "documents").select("doc_id", T.is_ulid(own).alias("ulid"))


@query(f"""{_VAULT}, l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS x, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM v_notes),
h AS (SELECT doc_id, arg_min(trim(regexp_extract(x, '^#{{1,6}}\\s+(.*)$', 1)), line) AS head FROM l WHERE regexp_matches(x, '^#{{1,6}}\\s+\\S') GROUP BY doc_id),
f AS (SELECT doc_id, arg_min(left(trim(x), 100), line) AS head FROM l WHERE trim(x) <> '' GROUP BY doc_id)
SELECT v.doc_id, coalesce(h.head, f.head, path) AS title FROM v_notes v LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)""")
def derived_titles(spark, sf_dir):
    return planted.vault(spark, sf_dir).select("doc_id", T.derive_title(F.col("body"), F.col("path")).alias("title"))


@query(f"""{_VAULT}, l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS x, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM v_notes),
n AS (SELECT doc_id, max(line) AS n FROM l GROUP BY doc_id)
SELECT n.doc_id, coalesce(arg_max(trim(regexp_extract(x, '^#{{1,6}}\\s+(.*)$', 1)), line) FILTER (regexp_matches(x, '^#{{1,6}}\\s+') AND line <= n - 1), '') AS heading FROM n JOIN l USING (doc_id) GROUP BY n.doc_id""")
def heading_of_line(spark, sf_dir):
    return planted.vault(spark, sf_dir).select("doc_id", T.heading_at(F.col("body"), F.size(F.split("body", "\n")) - 1).alias("heading"))


@query(f"""{_VAULT}, l AS (SELECT path, unnest(string_split(body, chr(10))) AS x, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM v_notes),
s AS (SELECT *, sum(cast(starts_with(trim(x), '```') AS INT)) OVER (PARTITION BY path ORDER BY line) AS fences FROM l),
h AS (SELECT path, line, length(regexp_extract(x, '^(#{{1,6}})', 1)) AS level, trim(regexp_extract(x, '^#{{1,6}}\\s+(.*)$', 1)) AS text FROM s WHERE fences % 2 = 0 AND regexp_matches(x, '^#{{1,6}}\\s+')),
g AS (SELECT *, regexp_replace(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')), '\\s+', '-', 'g') AS slug FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY line) AS k FROM g)
SELECT path, line, level, text, CASE WHEN k > 1 THEN slug || '-' || (k - 1) ELSE slug END AS slug FROM r""")
def outlines(spark, sf_dir):
    from ..operators import chunking

    rows = chunking.outline(planted.vault(spark, sf_dir), "path")
    return rows.select("path", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "text", "slug")


_PART = "(!)?\\[\\[([^\\]|#]*)(?:#([^\\]|]*))?(?:\\|([^\\]]*))?\\]\\]"


@query(f"""{_VAULT}, r AS (SELECT path, unnest(regexp_extract_all(body, '!?\\[\\[[^\\]|#]*(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]')) AS raw, unnest(range(len(regexp_extract_all(body, '!?\\[\\[[^\\]|#]*(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]')))) AS n FROM v_notes),
p AS (SELECT path, n, regexp_extract(raw, '{_PART}', 1) = '!' AS embed, trim(regexp_extract(raw, '{_PART}', 2)) AS target, nullif(trim(regexp_extract(raw, '{_PART}', 3)), '') AS heading, nullif(trim(regexp_extract(raw, '{_PART}', 4)), '') AS alias FROM r)
SELECT *, coalesce(alias, nullif(target, ''), heading, '') AS shown FROM p""")
def parsed_links(spark, sf_dir):
    rows = planted.vault(spark, sf_dir).select("path", F.posexplode(links.link_parts(F.col("body"))).alias("n", "l"))
    return rows.select("path", F.col("n").cast("long").alias("n"), "l.*")


# --- fixes and reports -------------------------------------------------------------------------------


@query("""WITH f AS (SELECT doc_id, 'id: x' || chr(10) || 'created: ' || CASE doc_id % 3 WHEN 0 THEN '2024-01-02T03:04:05' WHEN 1 THEN '2024-01-02T03:04:05Z' ELSE 'soon' END || chr(10) || 'updated: "2024-01-02 03:04"' AS t FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(replace(t, '03:04:05', '03:04:05+00:00'), '03:04"', '03:04+00:00"') ELSE replace(t, '03:04"', '03:04+00:00"') END AS after FROM f""")
def fixed_times(spark, sf_dir):
    n = F.col("doc_id") % 3
    value = F.when(n == 0, "2024-01-02T03:04:05").when(n == 1, "2024-01-02T03:04:05Z").otherwise("soon")
    text = F.concat(F.lit("id: x\ncreated: "), value, F.lit('\nupdated: "2024-01-02 03:04"'))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), text.alias("frontmatter_text"))
    return health.fix_timestamps(rows).select(F.col("path").alias("doc_id"), "after")


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || text WHEN 1 THEN '---' || chr(10) || '---' || chr(10) || text ELSE 'plain ' || text END AS raw, text FROM documents)
SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || 'created: $1' || chr(10) || '---' || chr(10) || text WHEN 1 THEN '---' || chr(10) || 'created: $1' || chr(10) || '---' || chr(10) || text
  ELSE '---' || chr(10) || 'created: $1' || chr(10) || '---' || chr(10) || raw END) AS text_sha256 FROM f""")
def frontmatter_added(spark, sf_dir):
    n = F.col("doc_id") % 3
    raw = F.when(n == 0, F.concat(F.lit("---\na: 1\n---\n"), "text")).when(n == 1, F.concat(F.lit("---\n---\n"), "text")).otherwise(F.concat(F.lit("plain "), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sha256(backfill.apply_changes(raw, F.lit("created: $1"))).alias("text_sha256"))


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'created' ELSE 'updated' END AS field, lang AS source, count(*) AS n FROM documents GROUP BY ALL""")
def backfill_report(spark, sf_dir):
    field = F.when(F.col("doc_id") % 2 == 0, "created").otherwise("updated")
    return backfill.report(table(spark, sf_dir, "documents").select(field.alias("field"), F.col("lang").alias("source")))


@query(f"WITH {_NOTES} SELECT provenance, count(*) AS n FROM notes_v GROUP BY provenance")
def provenance_counts(spark, sf_dir):
    return stats.provenance_counts(notes_view(spark, sf_dir))


# --- entries, index statistics, sync -------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole notes and, as their sections, the turns of conversations of the same number; some with a summary that is ready, missing or stale."""
    docs = notes_view(spark, sf_dir).select(
        "note_id", F.lit("document").alias("granularity"), "path", "title", "folder", "tags", F.date_format("updated", "yyyy-MM-dd").alias("date"), F.lit("").alias("heading"), F.col("body").alias("source"),
        F.lit(False).alias("context_eligible"), F.when(F.col("doc_id") % 4 == 0, "missing").when(F.col("doc_id") % 4 == 1, "stale").otherwise("ready").alias("context_status"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("note_id"), F.lit("section").alias("granularity"), F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("path"), F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("title"),
        F.lit("c").alias("folder"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("date"), F.when(F.col("turn") == 0, "").otherwise(F.col("role")).alias("heading"), F.col("text").alias("source"),
        (F.col("turn") % 2 == 0).alias("context_eligible"), F.when(F.col("turn") % 4 == 0, "ready").otherwise("stale").alias("context_status"),
    )
    return docs.unionByName(turns)


@query(f"""WITH {_NOTES}
SELECT note_id, 'document' AS granularity, sha256(concat_ws(chr(10) || chr(10), '# ' || title, 'Path: ' || path, 'Tags: ' || array_to_string(tags, ', '), 'Date: ' || strftime(updated, '%Y-%m-%d'), nullif(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), ''))) AS text_sha256 FROM notes_v
UNION ALL SELECT conv_id::VARCHAR, 'section', sha256('# C' || conv_id || chr(10) || chr(10) || 'Section: ' || CASE WHEN turn = 0 THEN '(intro)' ELSE role END || chr(10) || chr(10) || text) FROM conversations""")
def lexical_texts(spark, sf_dir):
    rows = _entries(spark, sf_dir)
    return rows.select("note_id", "granularity", T.sha256(sync.lexical_text(rows, "source")).alias("text_sha256"))


@query(f"""WITH {_NOTES}, s AS (SELECT turn % 2 = 0 AS eligible, turn % 4 = 0 AS ready FROM conversations)
SELECT (SELECT count(*) FROM notes_v) AS total_documents, (SELECT count(*) FROM notes_v) + (SELECT count(*) FROM s) AS total_entries, (SELECT count(*) FROM s) AS section_entries, (SELECT count(DISTINCT folder) FROM notes_v) AS unique_folders,
(SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM notes_v)) AS unique_tags, (SELECT count(updated) FROM notes_v) AS dated_notes, (SELECT count(*) FILTER (eligible) FROM s) AS eligible_sections, (SELECT count(*) FILTER (ready) FROM s) AS ready_sections,
(SELECT greatest(0, count(*) FILTER (eligible) - count(*) FILTER (ready)) FROM s) AS stale_sections, (SELECT round(count(*) FILTER (ready) / count(*) FILTER (eligible), 4) FROM s) AS context_coverage,
(SELECT count(*) FILTER (doc_id % 4 = 0) FROM notes_v) AS missing_notes, (SELECT count(*) FILTER (doc_id % 4 = 1) FROM notes_v) AS stale_notes""")
def reader_stats(spark, sf_dir):
    return stats.reader_stats(_entries(spark, sf_dir))


@query("""WITH x AS (SELECT doc_id, doc_id % 9 <> 1 AS i, doc_id % 6 = 2 AS c, doc_id % 5 = 3 AS k, doc_id % 4 = 2 AS s FROM documents),
r AS (SELECT CASE WHEN NOT i THEN 'add' WHEN c THEN 'context' WHEN s AND NOT k THEN 'rechunk' WHEN k THEN 'update' ELSE 'unchanged' END AS reason FROM x)
SELECT CASE WHEN reason IN ('add', 'unchanged') THEN reason ELSE 'update' END AS action, reason, count(*) AS n FROM r GROUP BY ALL""")
def sync_totals(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(n.cast("string").alias("note_id"), F.concat(F.lit("a/"), n.cast("string")).alias("path"), F.md5("text").alias("content_hash"), F.lit("new").alias("context_key"), "doc_id")
    index = rows.filter("doc_id % 9 <> 1").select(
        "note_id", "path", F.when(n % 5 == 3, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(n % 6 == 2, "old").otherwise("new").alias("context_key"),
        F.when(n % 4 == 2, 1).otherwise(sync.SCHEMA_VERSION).alias("schema_version"),
    )
    return sync.dry_run(sync.plan(rows.drop("doc_id"), index))


def _store(spark: SparkSession, name: str) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quillspark-{name}-{uuid.uuid4().hex[:12]}"


@query("""SELECT doc_id::VARCHAR AS note_id, sha256(CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END) AS text_sha256 FROM documents WHERE doc_id % 5 <> 4""")
def index_snapshots(spark, sf_dir):
    """An index published twice; a reader sees the second version whole."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("note_id"), F.lit("document").alias("granularity"), "text", "doc_id")
    index = sync.Snapshots(spark, _store(spark, "index"))
    index.publish(rows.drop("doc_id"))
    index.publish(rows.filter("doc_id % 5 <> 4").select("note_id", "granularity", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text")).alias("text")), {"model": "m"})
    index.check(model="m")
    return index.read().select("note_id", T.sha256(F.col("text")).alias("text_sha256"))


# --- summaries -----------------------------------------------------------------------------------------------


def _summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    notes = planted.vault(spark, sf_dir).withColumn("note_id", F.col("doc_id").cast("string"))
    done = summaries.fingerprinted(notes).filter("doc_id % 4 < 3")
    n = F.col("doc_id")
    rows = done.select(
        F.when(n % 28 == 1, 2).otherwise(1).alias("schema_version"), F.when(n % 20 == 2, F.concat(F.lit("x"), "note_id")).otherwise(F.col("note_id")).alias("note_id"),
        F.when(n % 4 == 1, "old").otherwise(F.col("fingerprint")).alias("source_fingerprint"), F.when(n % 12 == 0, "  ").otherwise(F.concat(F.lit(" a  short\n"), "note_id")).alias("summary"),
    )
    return notes, rows


@query("""SELECT CASE WHEN doc_id % 20 = 2 THEN 'x' ELSE '' END || doc_id AS note_id,
CASE WHEN doc_id % 28 = 1 THEN 'version' WHEN doc_id % 20 = 2 THEN 'no such note' WHEN doc_id % 4 = 1 THEN 'stale' ELSE 'empty or too long' END AS problem FROM documents
WHERE doc_id % 4 < 3 AND (doc_id % 28 = 1 OR doc_id % 20 = 2 OR doc_id % 4 = 1 OR doc_id % 12 = 0)""")
def summary_problems(spark, sf_dir):
    notes, rows = _summaries(spark, sf_dir)
    return summaries.import_problems(rows, notes)


@query(f"""{_VAULT}, h AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR doc_id % 27 = 1 THEN 'Sources|After' ELSE '' END AS headings FROM v_notes)
SELECT doc_id::VARCHAR AS note_id, title, headings FROM v_notes JOIN h USING (doc_id) WHERE doc_id % 4 = 3 OR doc_id % 4 = 1 OR doc_id % 20 = 2""")
def summary_jobs(spark, sf_dir):
    from ..operators import chunking

    notes, rows = _summaries(spark, sf_dir)
    heads = chunking.outline(notes.filter("doc_id % 9 = 0 OR doc_id % 27 = 1"), "note_id").filter("text IN ('Sources', 'After')")
    return summaries.jobs(notes, rows, heads).select("note_id", "title", F.array_join("headings", "|").alias("headings"))


# --- enrichment ------------------------------------------------------------------------------------------------


@query(f"""{_VAULT}, k AS (SELECT path, unnest([lower(title), lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')), lower(path), lower(regexp_replace(path, '\\.md$', ''))]) AS key FROM v_notes)
SELECT key, arg_min(path, string_split(path, '/')) AS path FROM k GROUP BY key""")
def enrich_targets(spark, sf_dir):
    return enrich.target_index(planted.vault(spark, sf_dir))


@query(f"""{_VAULT}, l AS (SELECT path, unnest(string_split(body, chr(10))) AS x, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM v_notes)
SELECT path AS note_id, min(line) AS line FROM l WHERE contains(x, '[[Doc') GROUP BY path""")
def anchor_lines(spark, sf_dir):
    rows = planted.vault(spark, sf_dir).select(F.col("path").alias("note_id"), "body", F.lit("[[Doc").alias("anchor"))
    return enrich.anchor_line(rows).select("note_id", F.col("line").cast("long").alias("line"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents), t AS (SELECT source AS folder, count(*) AS n FROM r WHERE place <= 40 GROUP BY source)
SELECT folder, n FROM t WHERE n >= 3 ORDER BY n DESC, folder LIMIT 1""")
def folder_consensus(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(40)
    return enrich.folder_consensus(rows.select(F.col("source").alias("folder"), F.lit(1).alias("place")), top=40)


# --- answers -----------------------------------------------------------------------------------------------------


_MARKED = "text || ' [S1, S' || turn % 5 || '] and [S' || conv_id % 4 || '] not [Sx].'"


@query(f"""WITH a AS (SELECT conv_id || '-' || turn AS id, {_MARKED} AS answer FROM conversations),
m AS (SELECT id, unnest(regexp_extract_all(answer, '\\[(S\\d+(?:\\s*,\\s*S\\d+)*)\\]', 1)) AS m, unnest(range(len(regexp_extract_all(answer, '\\[(S\\d+(?:\\s*,\\s*S\\d+)*)\\]')))) AS i FROM a),
k AS (SELECT id, i, unnest(regexp_split_to_array(m, '\\s*,\\s*')) AS key, unnest(range(len(regexp_split_to_array(m, '\\s*,\\s*')))) AS j FROM m),
f AS (SELECT id, key, min(i * 100 + j) AS spot FROM k GROUP BY ALL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY spot) - 1 AS place, key, CASE WHEN key IN ('S0', 'S1', 'S2', 'S3') THEN 'n' || id || key END AS note_id FROM f""")
def citation_links(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("concat(conv_id, '-', turn) AS id", f"{_MARKED} AS answer")
    sources = rows.select("id", F.explode(F.array(*(F.lit(f"S{k}") for k in range(4)))).alias("key")).withColumn("note_id", F.concat(F.lit("n"), "id", "key"))
    return synthesis.citations(rows, sources).select("id", F.col("place").cast("long").alias("place"), "key", "note_id")


@query(f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {_MARKED} ELSE replace(text, '[S', '') END AS answer, turn % 7 = 3 AS abstained, CASE WHEN turn % 5 = 4 THEN 'low' ELSE 'high' END AS confidence FROM conversations),
s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(replace(replace(replace(regexp_replace(answer, '([.!?])(\\s+)', '\\1' || chr(1), 'g'), chr(1), chr(1)), chr(2), ''), chr(3), ''), chr(1))) AS x FROM a)
SELECT a.conv_id, a.turn, CASE WHEN abstained THEN 'abstained' WHEN confidence = 'low' THEN 'low confidence' WHEN trim(answer) = '' THEN 'empty' WHEN turn % 2 = 1 THEN 'no citations' END AS reason,
(SELECT count(*) FROM s WHERE s.conv_id = a.conv_id AND s.turn = a.turn AND length(trim(x)) >= 40 AND NOT contains(x, '[S')) AS uncited FROM a""")
def answer_checks(spark, sf_dir):
    n = F.col("turn")
    rows = table(spark, sf_dir, "conversations").selectExpr("*", f"CASE WHEN turn % 2 = 0 THEN {_MARKED} ELSE replace(text, '[S', '') END AS answer")
    rows = rows.withColumns({"abstained": n % 7 == 3, "confidence": F.when(n % 5 == 4, "low").otherwise("high")})
    return rows.select("conv_id", "turn", synthesis.save_reason(rows).alias("reason"), F.size(synthesis.uncited(F.col("answer"))).cast("long").alias("uncited"))


_REPLY = """CASE turn % 8 WHEN 0 THEN '{"a": ' || conv_id || '}' WHEN 1 THEN '```json' || chr(10) || '{"a": ' || conv_id || '}' || chr(10) || '```' WHEN 2 THEN 'Sure: {"a": {"b": ' || conv_id || '}} ok' WHEN 3 THEN '{"a": [1, ' || conv_id
WHEN 4 THEN '[{"a": ' || conv_id || '}]' WHEN 5 THEN '{"a": "b' || conv_id WHEN 6 THEN 'none' ELSE '{"a": tru' END"""


@query("""SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN '{"a": ' || conv_id || '}' WHEN 1 THEN '{"a": ' || conv_id || '}' WHEN 2 THEN '{"a": {"b": ' || conv_id || '}}' WHEN 3 THEN '{"a": [1, ' || conv_id || ']}' WHEN 5 THEN '{"a": "b' || conv_id || '"}' END AS json FROM conversations""")
def llm_json_repair(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_REPLY} AS raw").select("conv_id", "turn", synthesis.repaired("raw").alias("json"))


# --- golden sets ---------------------------------------------------------------------------------------------------


def _golden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A golden query for each document; some break a rule.  With it the corpus and its headings."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    label = F.struct(
        F.when(n % 11 == 4, "other").otherwise(F.concat(F.lit("n"), n.cast("string"))).alias("note_id"), F.when(n % 13 == 5, "gone.md").otherwise(F.concat(F.lit("p"), n.cast("string"), F.lit(".md"))).alias("path"),
        F.when(n % 7 == 6, "Nowhere").otherwise("").alias("heading"), F.when(n % 5 == 1, 2).otherwise(3).alias("grade"),
    )
    ref = F.concat(label["note_id"], F.lit("#"), label["heading"])
    golden = docs.select(
        F.concat(F.lit("q"), n.cast("string")).alias("id"), F.lit("?").alias("query"), (n % 10 != 9).alias("answerable"), F.col("lang").alias("category"), F.array(label).alias("relevant_evidence"),
        F.array(F.array(F.when(n % 9 == 2, "no#label").otherwise(ref))).alias("required_evidence_groups"), F.when(n % 8 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("fact"))).alias("gold_facts"),
    )
    corpus = docs.select(F.concat(F.lit("n"), n.cast("string")).alias("note_id"), F.concat(F.lit("p"), n.cast("string"), F.lit(".md")).alias("path"))
    return golden, corpus, corpus.select("path", F.lit("").alias("heading"))


_GOLDEN = """WITH g AS (SELECT 'q' || doc_id AS id, doc_id AS n, doc_id % 10 <> 9 AS answerable, CASE WHEN doc_id % 11 = 4 THEN 'other' ELSE 'n' || doc_id END AS note_id, CASE WHEN doc_id % 13 = 5 THEN 'gone.md' ELSE 'p' || doc_id || '.md' END AS path,
CASE WHEN doc_id % 7 = 6 THEN 'Nowhere' ELSE '' END AS heading, doc_id % 13 = 5 AS gone, lang AS category FROM documents)"""


@query(f"""{_GOLDEN}, p AS (
SELECT id, 'answerable without a grade 3' AS problem FROM g WHERE answerable AND n % 5 = 1 UNION ALL SELECT id, 'answerable without facts' FROM g WHERE answerable AND n % 8 = 3
UNION ALL SELECT id, 'unanswerable with labels, groups or facts' FROM g WHERE NOT answerable UNION ALL SELECT id, 'no such path: ' || path FROM g WHERE gone UNION ALL SELECT id, 'other id at: ' || path FROM g WHERE NOT gone AND note_id = 'other'
UNION ALL SELECT id, 'no such heading: ' || path || '#' || heading FROM g WHERE NOT gone AND heading <> '' UNION ALL SELECT id, 'group member without label: no#label' FROM g WHERE n % 9 = 2)
SELECT id, problem, 'error' AS level FROM p""")
def golden_problems(spark, sf_dir):
    return evaluation.validate(*_golden(spark, sf_dir))


@query(f"""{_GOLDEN} SELECT count(*) AS queries, count(*) FILTER (answerable) AS answerable, count(DISTINCT category) AS categories, count(DISTINCT path) AS labelled_notes,
(SELECT count(*) FROM documents WHERE doc_id % 13 = 5) AS distractors FROM g""")
def golden_stats(spark, sf_dir):
    golden, corpus, _ = _golden(spark, sf_dir)
    return evaluation.dataset_stats(golden, corpus)


@query("""SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 6 = 1 THEN 'corpus' ELSE 'index' END AS only_in FROM documents WHERE doc_id % 6 IN (1, 4)""")
def index_mismatch(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 6).alias("k"))
    return evaluation.same_paths(rows.filter("k <> 4"), rows.filter("k <> 1"))


# --- approximate neighbours ---------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0""")
def knn_lists(spark, sf_dir):
    """Recall of the index by lists against the exact search, over every query whose id is divisible by 20.

    All rows are indexed.  The vectors of these tables hardly cluster, so 24 of 32 lists are searched; 8 would find two thirds.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.filter("vec_id % 20 = 0")
    exact = dense.nearest_blocks(rows, asked, 10).select("query_id", "vec_id")
    found = dense.nearest_listed(rows, asked, 10, dense.centroids(rows), probes=24).select("query_id", "vec_id", F.lit(1).alias("met"))
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.coalesce(F.sum(F.coalesce("met", F.lit(0))) / F.count(F.lit(1)) >= 0.9, F.lit(True)).alias("recall_reached"))


# --- streams -----------------------------------------------------------------------------------------------------------


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_stream(spark, sf_dir):
    """Events taken as a stream of files, counted by windows with a watermark, read from the sink when all is in."""
    whole = table(spark, sf_dir, "events")
    out = _store(spark, "stream")
    whole.repartition(4).write.parquet(f"{out}/in")
    rows = incremental.activity(spark.readStream.schema(whole.schema).parquet(f"{out}/in"), "1 hour")
    name = f"activity_{uuid.uuid4().hex[:8]}"
    rows.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
