"""Registered queries and their SQL twins.

The star-schema tables are read as notes by ``sources.notes.notes_view``; planted relations
cover what those tables do not hold.  Results are scalars or joined strings, rounded alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import backfill, chunking, dense, edits, enrich, evaluation, evidence, filters, fusion, health, lexical, links, ranking, stats, summaries, sync, synthesis
from ..sources.notes import notes_view, table
from . import hybrid, planted
from .registry import oracle_sql, queries, query

#: Words of the flagship query, the note whose vector goes with it, and the time that counts as now.
QUERY, QUERY_NOTE, NOW = 'the ering "of the" tionea and ation', 1, "2024-02-01 00:00:00"
TOP_K, RESULTS = 150, 10

# --- SQL parts ---------------------------------------------------------------------------------

_NOTES = """
notes_v AS (
  SELECT d.doc_id, cast(d.doc_id AS VARCHAR) AS note_id, d.source || '/' || d.doc_id || '.md' AS path, d.source AS folder, d.lang AS note_type, [d.lang, d.source] AS tags,
         d.text AS body, left(split_part(d.text, chr(10), 1), 80) AS title, CASE l.quality WHEN 1 THEN 'human' WHEN 0 THEN 'reference' ELSE '' END AS provenance, e.ts AS updated
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN events e ON e.event_id = d.doc_id
)"""
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_NORM = "array_to_string(" + _WORDS + ", ' ')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = f"""
toks AS MATERIALIZED (SELECT note_id, list_filter({_WORDS.format("body")}, lambda w: w NOT IN ({_STOP})) AS tokens FROM notes_v),
tot AS (SELECT count(*) AS n_docs, sum(len(tokens)) / count(*) AS avg_len FROM toks),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM toks) GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, tot),
wts AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


def _terms_sql(terms: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(terms)) + ") AS q(k, term)"


def _bm25_sql(terms: list[str]) -> str:
    return f"""
tfs AS (SELECT note_id, q.k, q.term, len(tokens) AS dl, len(list_filter(tokens, lambda t: t = q.term)) AS tf FROM toks, {_terms_sql(terms)}),
kw0 AS (
  SELECT note_id, sum(CASE WHEN tf > 0 THEN coalesce(idf, 0) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len)) ELSE 0 END) AS score
  FROM tfs LEFT JOIN wts USING (term), tot GROUP BY note_id
)"""


_TERMS = lexical.query_terms(QUERY.replace('"', " "))
_KW = f"""
{_bm25_sql(_TERMS)},
kw AS (SELECT note_id, score * (1 + 0.3 * cast(contains(' ' || {_NORM.format("body")} || ' ', ' of the ') AS INT)) AS keyword FROM kw0 JOIN notes_v USING (note_id))"""
_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (cast(p[1] AS DOUBLE) - cast(p[2] AS DOUBLE)) * (cast(p[1] AS DOUBLE) - cast(p[2] AS DOUBLE))))"
_SEM = f"""
qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_NOTE}),
near AS (SELECT cast(vec_id AS VARCHAR) AS note_id, {_DIST.format(a="embedding", b="q")} AS distance FROM embeddings, qv)"""
_CAND = f"""
kt AS (SELECT note_id FROM kw ORDER BY keyword DESC, note_id LIMIT {TOP_K}),
st AS (SELECT note_id, exp(-distance) + 1 AS semantic FROM near ORDER BY distance, note_id LIMIT {TOP_K}),
cand AS (
  SELECT n.*, k.keyword, coalesce(s.semantic, 0) AS semantic FROM notes_v n JOIN kw k USING (note_id) LEFT JOIN st s USING (note_id)
  WHERE note_id IN (SELECT note_id FROM kt UNION SELECT note_id FROM st)
)"""
_MINMAX = "CASE WHEN max({0}) OVER () - min({0}) OVER () < 1e-12 THEN 0.5 ELSE ({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) END"


def _rrf_sql(src: str, out: str, keep: str = "*") -> str:
    return f"""
{out}_r AS (SELECT *, rank() OVER (ORDER BY semantic DESC) + (count(*) OVER (PARTITION BY semantic) - 1) / 2 AS rs, rank() OVER (ORDER BY keyword DESC) + (count(*) OVER (PARTITION BY keyword) - 1) / 2 AS rk FROM {src}),
{out}_s AS (SELECT *, 0.5 / (60 + rs) + 0.5 / (60 + rk) AS total FROM {out}_r),
{out} AS (SELECT {keep}, {_MINMAX.format("total")} AS fused FROM {out}_s)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and bodies alone, without the joins that give notes their metadata."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("note_id"), F.col("text").alias("body"))


# --- scans and scalar functions ------------------------------------------------------------------


@query(f"WITH {_NOTES} SELECT note_id, path, folder, note_type, title, provenance, updated, array_to_string(tags, ',') AS tags FROM notes_v")
def notes_scan(spark, sf_dir):
    return notes_view(spark, sf_dir).select("note_id", "path", "folder", "note_type", "title", "provenance", "updated", F.array_join("tags", ",").alias("tags"))


_TAGGED = [(1, "has #ignore here"), (2, "not#ignore"), (3, "#ignored word"), (4, "#Ignore"), (5, "a #ignore-this"), (6, "x\t#ignore.")]


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false), (6, true)) AS t(k, ignored)")
def ignore_tag_filter(spark, sf_dir):
    return spark.createDataFrame(_TAGGED, "k int, body string").select("k", T.has_ignore_tag(F.col("body")).alias("ignored"))


_HASH62 = "regexp_replace(array_to_string(list_transform(range(10, -1, -1), lambda k: substr('" + T.DIGITS + "', cast((v // pow62[k + 1]) % 62 AS BIGINT) + 1, 1)), ''), '^0+(.)', '\\1')"


@query(f"""
WITH h AS (SELECT doc_id, md5(source || '/' || doc_id || '.md') AS m, {[62**k for k in range(11)]}::HUGEINT[] AS pow62 FROM documents),
v AS (SELECT doc_id, pow62, list_reduce(list_transform(range(17, 33), lambda i: cast(instr('0123456789abcdef', substr(m, i, 1)) - 1 AS HUGEINT)), lambda a, b: a * 16 + b) AS v FROM h)
SELECT doc_id, {_HASH62} AS note_hash FROM v
""")
def note_hash62(spark, sf_dir):
    return notes_view(spark, sf_dir).select("doc_id", T.hash62(F.col("path")).alias("note_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalize_no_punct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(f"""
WITH {_NOTES}, {_TOKENS.split("tot AS")[0].rstrip().rstrip(",")},
t AS (SELECT note_id, unnest(tokens) AS term, unnest(range(1, len(tokens) + 1)) AS pos FROM toks),
c AS (SELECT note_id, term, count(*) AS n, min(pos) AS pos FROM t GROUP BY note_id, term),
r AS (SELECT note_id, term, n, row_number() OVER (PARTITION BY note_id ORDER BY n DESC, pos) AS place FROM c)
SELECT note_id, place, term, n FROM r WHERE place <= 5
""")
def top_terms(spark, sf_dir):
    rows = lexical.top_terms(lexical.tokenized(_texts(spark, sf_dir)), "note_id")
    return rows.select("note_id", F.col("place").cast("long").alias("place"), "term", F.col("n").cast("long").alias("n"))


@query("SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 80), '^-|-$', '', 'g') AS slug FROM documents")
def title_slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.split("text", "\n")[0]).alias("slug"))


@query("""
SELECT * FROM (VALUES ('a/b.md', true), ('', false), ('/a', false), ('a//b', false), ('a/../b', false), ('./a', false), ('a\\b', false), ('a b/é.md', true)) AS t(path, ok)
""")
def path_validation(spark, sf_dir):
    rows = [("a/b.md",), ("",), ("/a",), ("a//b",), ("a/../b",), ("./a",), ("a\\b",), ("a b/é.md",)]
    return spark.createDataFrame(rows, "path string").select("path", T.valid_path(F.col("path")).alias("ok"))


@query("SELECT doc_id, left(text, 700) AS excerpt, 'notes://open?vault=My%20Vault&file=' || source || '/' || doc_id AS link FROM documents")
def evidence_excerpt(spark, sf_dir):
    return notes_view(spark, sf_dir).select("doc_id", T.excerpt(F.col("body")).alias("excerpt"), T.deep_link("notes", F.lit("My Vault"), F.col("path")).alias("link"))


@query(f"WITH {_NOTES} SELECT note_id, strftime(updated, '%Y-%m-%dT%H:%M:%SZ') AS utc_z, strftime(updated, '%Y-%m-%dT%H:%M:%S') AS local, strftime(updated, '%-d %b %Y') AS short FROM notes_v")
def time_formats(spark, sf_dir):
    notes = notes_view(spark, sf_dir)
    ts = F.col("updated").cast("timestamp")
    return notes.select("note_id", T.format_time(ts, "utc_z").alias("utc_z"), T.format_time(ts, "local").alias("local"), F.date_format(ts, "d MMM yyyy").alias("short"))


# --- filters ---------------------------------------------------------------------------------------


def _filtered(spark: SparkSession, sf_dir: str, keep: Column) -> DataFrame:
    return notes_view(spark, sf_dir).filter(keep).select("note_id", "path")


@query(f"WITH {_NOTES} SELECT note_id, path FROM notes_v WHERE folder = 'src1' OR starts_with(folder, 'src1/')")
def folder_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.in_folder("src1"))


@query(f"WITH {_NOTES} SELECT note_id, path FROM notes_v WHERE list_has_all(tags, ['en', 'src3'])")
def tag_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.has_tags(["EN", "src3"]))


@query(f"WITH {_NOTES} SELECT note_id, path FROM notes_v WHERE lower(note_type) = 'de'")
def type_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.of_type("DE"))


@query(f"WITH {_NOTES} SELECT note_id, path FROM notes_v WHERE provenance = 'human'")
def provenance_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.of_provenance("human"))


@query(f"WITH {_NOTES} SELECT note_id, path FROM notes_v WHERE updated BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-02 18:00:00'")
def date_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.between("2024-01-02", "2024-01-02 18:00:00"))


@query(f"WITH {_NOTES} SELECT note_id, path FROM notes_v WHERE contains(' ' || {_NORM.format('body')} || ' ', ' and the ') AND contains(' ' || {_NORM.format('body')} || ' ', ' is ')")
def must_include(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.must_include(["and, the", "IS", "!"]))


@query(f"""WITH {_NOTES} SELECT count(*) AS notes, count(DISTINCT folder) AS folders, count(updated) AS dated, count(*) FILTER (provenance = 'human') AS human,
count(*) FILTER (provenance = 'reference') AS reference, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM notes_v)) AS tags FROM notes_v""")
def index_stats(spark, sf_dir):
    return stats.index_stats(notes_view(spark, sf_dir))


# --- lexical and dense -----------------------------------------------------------------------------


@query(f"WITH {_NOTES}, {_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM wts")
def bm25_stats(spark, sf_dir):
    return lexical.weights(lexical.tokenized(_texts(spark, sf_dir))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_NOTES}, {_TOKENS}, {_bm25_sql(['tion', 'ering', 'ation', 'tion', 'des'])} SELECT note_id, round(score, 6) AS keyword FROM kw0 ORDER BY score DESC, note_id LIMIT {TOP_K}")
def bm25_topk(spark, sf_dir):
    return lexical.search(_texts(spark, sf_dir), "tion the of ering ation tion des", TOP_K, stemmed=False).select("note_id", F.round("keyword", 6).alias("keyword"))


@query(f"WITH {_NOTES}, {_TOKENS}, {_KW} SELECT note_id, round(keyword, 6) AS keyword FROM kw ORDER BY keyword DESC, note_id LIMIT {TOP_K}")
def bm25_phrase(spark, sf_dir):
    return lexical.search(_texts(spark, sf_dir), QUERY, TOP_K, stemmed=False).select("note_id", F.round("keyword", 6).alias("keyword"))


@query()
def bm25_stemmed(spark, sf_dir):
    return lexical.search(_texts(spark, sf_dir), "ering nations of thes ating ations", TOP_K).select("note_id", F.round("keyword", 6).alias("keyword"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("note_id"), "embedding")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_NOTE).first()["embedding"])


@query(f"WITH {_SEM} SELECT note_id, round(distance, 6) AS distance FROM near ORDER BY distance, note_id LIMIT 20")
def knn_topk(spark, sf_dir):
    return dense.nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20, "note_id").select("note_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_SEM} SELECT note_id, round(exp(-distance) + 1, 6) AS semantic FROM near")
def semantic_score(spark, sf_dir):
    d = dense.squared_distance(F.col("embedding"), dense.literal(_query_vector(spark, sf_dir)))
    return _vectors(spark, sf_dir).select("note_id", F.round(dense.similarity(d), 6).alias("semantic"))


@query(f"""
WITH d AS (SELECT b.vec_id AS query_id, a.vec_id, {_DIST.format(a="a.embedding", b="b.embedding")} AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0)
SELECT query_id, vec_id, place, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM d) WHERE place <= 5
""")
def knn_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    out = dense.nearest_blocks(rows, rows.filter("vec_id % 20 = 0"), 5)
    return out.select("query_id", "vec_id", F.col("place").cast("long").alias("place"), F.round("distance", 6).alias("distance"))


@query(f"""
WITH {_SEM}, s AS (SELECT d.source AS folder, n.note_id, distance FROM near n JOIN documents d ON cast(d.doc_id AS VARCHAR) = n.note_id),
r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY distance, note_id) AS k FROM s)
SELECT folder, note_id, round(distance, 6) AS distance FROM r WHERE k = 1
""")
def focus_section(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("note_id"))
    rows = _vectors(spark, sf_dir).join(docs, "note_id")
    return dense.focus(rows, _query_vector(spark, sf_dir), "folder", "note_id").select("folder", "note_id", F.round("distance", 6).alias("distance"))


# --- fusion and ranking ------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of the flagship query: the best of each channel, with both scores."""
    asked = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_NOTE).select("embedding").scalar()
    return hybrid.candidates(_texts(spark, sf_dir), _vectors(spark, sf_dir), QUERY, asked, TOP_K, stemmed=False).join(notes_view(spark, sf_dir).drop("body"), "note_id")


_FOUND = f"WITH {_NOTES}, {_TOKENS}, {_KW}, {_SEM}, {_CAND}"


@query(f"{_FOUND} SELECT note_id, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword FROM cand")
def candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("note_id", F.round("semantic", 6).alias("semantic"), F.round("keyword", 6).alias("keyword"))


@query(f"{_FOUND}, {_rrf_sql('cand', 'f')} SELECT note_id, round(fused, 6) AS fused FROM f")
def rrf(spark, sf_dir):
    return fusion.rrf(_candidates(spark, sf_dir)).select("note_id", F.round("fused", 6).alias("fused"))


_Z = "1 / (1 + exp(-({0} - avg({0}) OVER ()) / stddev_pop({0}) OVER ()))"


@query(f"{_FOUND} SELECT note_id, round(0.5 * ({_Z.format('semantic')}) + 0.5 * ({_Z.format('keyword')}), 6) AS fused FROM cand")
def zsigmoid(spark, sf_dir):
    return fusion.z_sigmoid(_candidates(spark, sf_dir)).select("note_id", F.round("fused", 6).alias("fused"))


@query(f"{_FOUND} SELECT note_id, round(0.5 * ({_MINMAX.format('semantic')}) + 0.5 * ({_MINMAX.format('keyword')}), 6) AS fused FROM cand")
def minmax_fusion(spark, sf_dir):
    return fusion.min_max_fusion(_candidates(spark, sf_dir)).select("note_id", F.round("fused", 6).alias("fused"))


def _search(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    options = {k: more.pop(k) for k in ("allowed", "now", "mixed", "provider") if k in more}
    params = ranking.SearchParams(top_k=TOP_K, n_results=RESULTS, **more)
    # The query's vector is a scalar subquery, so the search is one plan and starts no job.
    asked = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_NOTE).select("embedding").scalar()
    notes = notes_view(spark, sf_dir).withColumn("group_id", F.col("folder"))
    return hybrid.retrieve(notes, _vectors(spark, sf_dir), QUERY, asked, params, texts=_texts(spark, sf_dir), stemmed=False, **options)


_HYBRID = f"WITH {_NOTES}, {_TOKENS}, {_KW}, {_SEM}, {_CAND}, {_rrf_sql('cand', 'f')}"


@query(f"""{_HYBRID} SELECT note_id, path, round(semantic, 4) AS semantic, round(keyword, 4) AS keyword, round(fused, 4) AS final, row_number() OVER (ORDER BY fused DESC, note_id) AS place
FROM f ORDER BY fused DESC, note_id LIMIT {RESULTS}""")
def hybrid_search(spark, sf_dir):
    out = _search(spark, sf_dir)
    return out.select("note_id", "path", *(F.round(c, 4).alias(c) for c in ("semantic", "keyword", "final")), F.col("place").cast("long").alias("place"))


@query(f"""WITH {_NOTES}, {_TOKENS}, {_KW}, {_SEM}, {_CAND}, allowed AS (SELECT * FROM cand WHERE note_type = 'en' AND updated >= TIMESTAMP '2024-01-01'), {_rrf_sql('allowed', 'f')}
SELECT note_id, round(fused, 4) AS final FROM f ORDER BY fused DESC, note_id LIMIT {RESULTS}""")
def hybrid_filtered(spark, sf_dir):
    return _search(spark, sf_dir, allowed=filters.scope(note_type="en", since="2024-01-01")).select("note_id", F.round("final", 4).alias("final"))


@query(f"""{_HYBRID}, c AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY fused DESC, note_id) AS k FROM f)
SELECT note_id, folder, round(fused, 4) AS final FROM c WHERE k <= 3 ORDER BY fused DESC, note_id LIMIT {RESULTS}""")
def mixed_cap(spark, sf_dir):
    return _search(spark, sf_dir, mixed=True).select("note_id", "folder", F.round("final", 4).alias("final"))


_TURNS = """notes_v AS (SELECT 'c' || conv_id || '::s' || turn AS note_id, 'c' || conv_id AS group_id, conv_id * 7 + turn AS n,
  '# Conversation ' || conv_id || chr(10) || chr(10) || 'Section: ' || role || chr(10) || chr(10) || text AS body FROM conversations)"""
_TURNS_NEAR = f"""
qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_NOTE}),
near AS (SELECT note_id, {_DIST.format(a="embedding", b="q")} AS distance FROM notes_v JOIN embeddings ON vec_id = n % 500, qv)"""


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as notes and their turns as sections, each with a vector."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    rows = table(spark, sf_dir, "conversations").select(
        F.concat(name, F.lit("::s"), F.col("turn").cast("string")).alias("entry_id"), name.alias("note_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
        F.lit("section").alias("granularity"), F.col("role").alias("heading"), F.col("text").alias("body"), (F.col("conv_id") * 7 + F.col("turn")).alias("n"),
    )
    rows = rows.withColumn("lexical", sync.lexical_text(rows))
    vectors = rows.select("entry_id", (F.col("n") % 500).alias("vec_id")).join(table(spark, sf_dir, "embeddings"), "vec_id").select("entry_id", "embedding")
    return rows, vectors


def _section_search(spark: SparkSession, sf_dir: str, mixed: bool) -> DataFrame:
    rows, vectors = _turns(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_NOTE).select("embedding").scalar()
    params = ranking.SearchParams(top_k=TOP_K, n_results=RESULTS)
    out = hybrid.retrieve(rows, vectors, QUERY, asked, params, mixed=mixed, key="entry_id", group="note_id", lexical_text="lexical", stemmed=False)
    return out.select("entry_id", "note_id", F.round("final", 4).alias("final"))


@query(f"""WITH {_TURNS}, {_TOKENS}, {_KW}, {_TURNS_NEAR}, {_CAND}, {_rrf_sql('cand', 'f')}
SELECT note_id AS entry_id, group_id AS note_id, round(fused, 4) AS final FROM f ORDER BY fused DESC, entry_id LIMIT {RESULTS}""")
def section_search(spark, sf_dir):
    return _section_search(spark, sf_dir, False)


@query(f"""WITH {_TURNS}, {_TOKENS}, {_KW}, {_TURNS_NEAR}, {_CAND}, {_rrf_sql('cand', 'f')},
c AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY fused DESC, note_id) AS k FROM f)
SELECT note_id AS entry_id, group_id AS note_id, round(fused, 4) AS final FROM c WHERE k <= 3 ORDER BY fused DESC, entry_id LIMIT {RESULTS}""")
def mixed_search(spark, sf_dir):
    return _section_search(spark, sf_dir, True)


def _by_length(texts: list[str]) -> list[float]:
    return [1 / (1 + len(t)) for t in texts]


@query(f"""{_HYBRID}, p AS (SELECT *, row_number() OVER (ORDER BY fused DESC, note_id) AS k FROM f), r AS (SELECT *, CASE WHEN k <= 30 THEN 1 / (1 + length(body)) END AS reranker FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY reranker DESC NULLS LAST, note_id) AS rr FROM r)
SELECT note_id, round(coalesce(reranker, fused), 6) AS final, CASE WHEN reranker IS NOT NULL THEN rr END AS rerank_rank FROM o ORDER BY coalesce(reranker, fused) DESC, fused DESC, note_id LIMIT {RESULTS}""")
def rerank_pool(spark, sf_dir):
    return _search(spark, sf_dir, provider=_by_length).select("note_id", F.round("final", 6).alias("final"), F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query(f"""{_HYBRID}, p AS (SELECT *, row_number() OVER (ORDER BY fused DESC, note_id) AS k FROM f), r AS (SELECT *, CASE WHEN k <= 30 THEN 1 / (1 + length(body)) END AS reranker FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY reranker DESC NULLS LAST, note_id) AS rr, count(reranker) OVER () AS n FROM r),
v AS (SELECT *, CASE WHEN reranker IS NULL THEN fused ELSE 1 - (rr - 1) / greatest(n - 1, 1) * 0.5 END AS rel FROM o)
SELECT note_id, round(rel, 6) AS final FROM v ORDER BY rel DESC, fused DESC, note_id LIMIT {RESULTS}""")
def rerank_by_place(spark, sf_dir):
    return _search(spark, sf_dir, provider=_by_length, recency_strategy="multiplicative").select("note_id", F.round("final", 6).alias("final"))


@query(f"{_FOUND} SELECT note_id, round(1 - (row_number() OVER (ORDER BY keyword DESC, note_id) - 1) / greatest(count(*) OVER () - 1, 1) * 0.5, 6) AS rank_score FROM cand")
def rank_scores(spark, sf_dir):
    return ranking.rank_scores(_candidates(spark, sf_dir), "keyword", "note_id").select("note_id", F.round("rank_score", 6).alias("rank_score"))


_FRESH = f"coalesce(exp(-greatest(floor(date_diff('microsecond', updated, TIMESTAMP '{NOW}') / 86400000000), 0) / 180), 0)"


@query(f"WITH {_NOTES} SELECT note_id, round({_FRESH}, 6) AS freshness FROM notes_v")
def freshness(spark, sf_dir):
    return notes_view(spark, sf_dir).select("note_id", F.round(ranking.freshness(F.col("updated"), F.lit(NOW).cast("timestamp"), 180), 6).alias("freshness"))


@query(f"""{_HYBRID}, o AS (SELECT *, {_FRESH} AS fr, row_number() OVER (ORDER BY fused DESC, note_id) AS k, count(*) OVER () AS n FROM f),
b AS (SELECT greatest(0, max(CASE WHEN k = least(n, {RESULTS}) THEN fused END) - max(CASE WHEN k = least(n, {RESULTS} + 3) THEN fused END)) AS lam FROM o)
SELECT note_id, round(lam, 6) AS budget, round(fused + lam * fr, 6) AS final FROM o, b ORDER BY fused + lam * fr DESC, fused DESC, note_id LIMIT {RESULTS}""")
def recency_geometry(spark, sf_dir):
    out = _search(spark, sf_dir, recency="geometry", recency_budget=3, now=F.lit(NOW).cast("timestamp"))
    return out.select("note_id", F.round("budget", 6).alias("budget"), F.round("final", 6).alias("final"))


@query(f"""{_HYBRID}, o AS (SELECT *, fused * 0.5 + fused * (1 + {_FRESH}) * 0.5 AS final FROM f)
SELECT note_id, round(final, 6) AS final FROM o ORDER BY o.final DESC, fused DESC, note_id LIMIT {RESULTS}""")
def recency_multiplicative(spark, sf_dir):
    return _search(spark, sf_dir, recency="multiplicative", now=F.lit(NOW).cast("timestamp")).select("note_id", F.round("final", 6).alias("final"))


# --- evidence -----------------------------------------------------------------------------------------

_ZED = "CASE WHEN stddev_pop({0}) OVER () < 1e-9 THEN 0 ELSE ({0} - avg({0}) OVER ()) / stddev_pop({0}) OVER () END"


@query(f"""{_HYBRID}, p AS (SELECT * FROM f ORDER BY fused DESC, note_id LIMIT {RESULTS}),
z AS (SELECT note_id, CASE WHEN cast(note_id AS BIGINT) % 4 = 0 THEN cast(note_id AS BIGINT) % 5 + 1 END AS rr, {_ZED.format('keyword')} AS k, {_ZED.format('semantic')} AS s FROM p)
SELECT note_id, CASE WHEN rr <= 3 THEN 'reranked into top ' || rr || ' for this query' WHEN k > s THEN 'strong keyword match' WHEN s > k THEN 'strong semantic match' ELSE 'combined keyword+semantic signal' END AS why FROM z""")
def evidence_why(spark, sf_dir):
    n = F.col("note_id").cast("long")
    return evidence.why(_search(spark, sf_dir).withColumn("rerank_rank", F.when(n % 4 == 0, n % 5 + 1))).select("note_id", "why")


@query(f"""{_FOUND}, x AS (SELECT min(keyword) AS low, max(keyword) AS high FROM cand) SELECT note_id, round((keyword - low) / CASE WHEN high = low THEN 1 ELSE high - low END * 100, 0) AS bar FROM cand, x""")
def display_bars(spark, sf_dir):
    return _candidates(spark, sf_dir).select("note_id", evidence.bars("keyword").alias("bar"))


@query(f"""{_HYBRID}, p AS (SELECT *, row_number() OVER (ORDER BY fused DESC, note_id) - 1 AS k FROM f)
SELECT 'S' || k AS key, note_id, '<S' || k || CASE WHEN provenance IN ('distilled', 'reference', 'llm') THEN ' provenance=' || provenance ELSE '' END || printf(' score=%.4f>', fused) || chr(10) || 'Title: ' || title || chr(10)
  || 'Path: ' || path || chr(10) || left(body, 700) || chr(10) || '</S' || k || '>' AS block FROM p WHERE k < 8""")
def context_block(spark, sf_dir):
    return evidence.context(_search(spark, sf_dir), [F.col("place")])


@query(f"""{_HYBRID}, k AS (SELECT note_id, row_number() OVER (ORDER BY keyword DESC, note_id) AS rank, keyword AS score FROM kw), s AS (SELECT note_id, row_number() OVER (ORDER BY distance, note_id) AS rank, exp(-distance) + 1 AS score FROM near),
h AS (SELECT 'title' AS channel, * FROM k WHERE rank <= 30 UNION ALL SELECT 'body', * FROM s WHERE rank <= 30),
t AS (SELECT note_id, sum(1 / (60 + rank)) AS rrf, max(score) AS best, string_agg(channel, ',' ORDER BY channel) AS channels FROM h WHERE note_id <> '{QUERY_NOTE}' GROUP BY note_id)
SELECT note_id, round(rrf, 6) AS rrf, round(best, 6) AS best, channels FROM t ORDER BY t.rrf DESC, t.best DESC, note_id DESC LIMIT 15""")
def neighbor_rrf(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("note_id", F.round("rrf", 6).alias("rrf"), F.round("best", 6).alias("best"), F.array_join("channels", ",").alias("channels"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexical.search(_texts(spark, sf_dir), QUERY, 30, stemmed=False).select(F.lit("title").alias("channel"), "note_id", F.col("keyword").alias("score"))
    near = dense.nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 30, "note_id").select(F.lit("body").alias("channel"), "note_id", dense.similarity(F.col("distance")).alias("score"))
    hits = words.unionByName(near)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "note_id")))
    return enrich.neighbour_rrf(hits, own=str(QUERY_NOTE))


# --- links and health ------------------------------------------------------------------------------------


@query("""SELECT page_id, href, n FROM (SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id, href)""")
def page_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT url AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
u AS (SELECT * FROM l WHERE target NOT IN (SELECT url FROM pages))
SELECT target, count(*) AS links, count(DISTINCT path) AS sources FROM u GROUP BY target""")
def dangling_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = pages.select(F.col("url").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    broken = found.join(pages.select(F.col("url").alias("target")).distinct(), "target", "left_anti")
    return links.dangling(broken).select("target", "links", F.size("sources").cast("long").alias("sources"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    notes = planted.vault(spark, sf_dir)
    found = links.body_links(notes).unionByName(links.frontmatter_links(notes.filter("frontmatter_text <> ''")))
    return notes, links.resolve(found, notes, planted.files(spark, sf_dir))


_LINKS = f"""
WITH v_notes AS MATERIALIZED ({planted.VAULT_SQL}), v_files AS ({planted.FILES_SQL}),
ln AS (SELECT path, unnest(string_split(body, chr(10))) AS text, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM v_notes WHERE contains(body, '[[')),
st AS (SELECT *, sum(cast(starts_with(trim(text), '```') AS INT)) OVER (PARTITION BY path ORDER BY line) AS fences FROM ln),
vl AS (SELECT path, line, regexp_replace(text, '`[^`]*`', '', 'g') AS text FROM st WHERE fences % 2 = 0 AND NOT starts_with(trim(text), '```')),
fl AS (SELECT path, unnest(string_split(frontmatter_text, chr(10))) AS text, unnest(range(2, len(string_split(frontmatter_text, chr(10))) + 2)) AS line FROM v_notes WHERE frontmatter_text <> ''),
lk AS (SELECT path, 'body' AS location, line, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1))) AS target FROM vl
  UNION ALL SELECT path, 'frontmatter', line, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1))) FROM fl),
nm AS (
  SELECT path, 1 AS rank, lower(title) AS key FROM v_notes UNION ALL SELECT path, 2, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')) FROM v_notes
  UNION ALL SELECT path, 3, lower(path) FROM v_notes UNION ALL SELECT path, 3, lower(regexp_replace(path, '\\.md$', '')) FROM v_notes
  UNION ALL SELECT path, 4, lower(alias) FROM v_notes WHERE alias IS NOT NULL
), ky AS (SELECT key, path AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, string_split(path, '/')) AS k FROM nm) WHERE k = 1),
ak AS (SELECT DISTINCT unnest([lower(path), lower(regexp_extract(path, '[^/]*$')), lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', ''))]) AS key FROM v_files),
rs AS MATERIALIZED (SELECT lk.*, resolved, resolved IS NULL AND ak.key IS NOT NULL AS attachment FROM lk LEFT JOIN ky ON lower(target) = ky.key LEFT JOIN ak ON lower(target) = ak.key),
ed AS MATERIALIZED (SELECT DISTINCT path AS src, resolved AS dst FROM rs WHERE resolved IS NOT NULL AND resolved <> path)
"""


@query(f"{_LINKS} SELECT path, location, line, target, resolved, attachment FROM rs")
def resolve_links(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("path", "location", F.col("line").cast("long").alias("line"), "target", "resolved", "attachment")


@query(f"{_LINKS} SELECT dst AS path, string_agg(src, ';' ORDER BY src) AS linked_from, count(*) AS n FROM ed GROUP BY dst")
def backlinks(spark, sf_dir):
    return links.backlinks(links.edges(_graph(spark, sf_dir)[1])).select("path", F.array_join("linked_from", ";").alias("linked_from"), "n")


_ORPHANS = "SELECT path FROM v_notes WHERE note_type <> 'distilled' AND provenance <> 'distilled' AND path NOT IN (SELECT src FROM ed) AND path NOT IN (SELECT dst FROM ed)"


@query(f"{_LINKS} {_ORPHANS}")
def orphans(spark, sf_dir):
    notes, resolved = _graph(spark, sf_dir)
    return health.orphans(notes, links.edges(resolved))


_BROKEN = "SELECT path, location, line, target FROM rs WHERE resolved IS NULL AND NOT attachment"


@query(f"{_LINKS} {_BROKEN}")
def broken_links(spark, sf_dir):
    return links.unresolved(_graph(spark, sf_dir)[1]).select("path", "location", F.col("line").cast("long").alias("line"), "target")


@query(f"{_LINKS}, b AS ({_BROKEN}) SELECT target, count(*) AS links, string_agg(DISTINCT path, ';' ORDER BY path) AS sources FROM b GROUP BY target")
def dangling_notes(spark, sf_dir):
    return links.dangling(links.unresolved(_graph(spark, sf_dir)[1])).select("target", "links", F.array_join("sources", ";").alias("sources"))


_STALE = """, sv AS (SELECT v.*, line FROM vl v JOIN v_notes n USING (path) WHERE note_type = 'distilled' OR provenance = 'distilled'),
sh AS (SELECT path, min(line) AS top FROM sv WHERE regexp_matches(text, '(?i)^#{1,6}\\s+sources\\s*$') GROUP BY path),
se AS (SELECT sh.path, top, coalesce(min(v.line), 1000000000) AS foot FROM sh LEFT JOIN sv v ON v.path = sh.path AND v.line > top AND regexp_matches(v.text, '^#{1,6}\\s') GROUP BY ALL),
sl AS (SELECT se.path, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1))) AS target FROM se JOIN sv v ON v.path = se.path AND v.line > top AND v.line < foot),
sr AS (SELECT sl.*, resolved FROM sl LEFT JOIN ky ON lower(target) = key),
stale AS (SELECT sr.path, 'stale' AS kind, string_agg(DISTINCT resolved, ';' ORDER BY resolved) AS sources FROM sr JOIN v_notes d ON d.path = sr.path JOIN v_notes x ON x.path = sr.resolved WHERE x.recency > d.recency GROUP BY sr.path
  UNION ALL SELECT path, 'unresolvable', target FROM sr WHERE resolved IS NULL)"""


@query(f"{_LINKS}{_STALE} SELECT path, kind, sources FROM stale")
def stale_distilled(spark, sf_dir):
    return health.stale_distilled(planted.vault(spark, sf_dir)).select("path", "kind", F.array_join("sources", ";").alias("sources"))


@query("""SELECT sha256(text) AS content_hash, count(*) AS n, string_agg(source || '/' || doc_id || '.md', ';' ORDER BY source || '/' || doc_id || '.md') AS paths FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_content(spark, sf_dir):
    rows = notes_view(spark, sf_dir).select("path", T.sha256(F.col("body")).alias("content_hash"))
    return health.duplicate_ids(rows, "content_hash").select("content_hash", F.size("paths").cast("long").alias("n"), F.array_join("paths", ";").alias("paths"))


_VAULT = f"WITH v_notes AS ({planted.VAULT_SQL})"
_TITLES = ", g AS (SELECT lower(title) AS k, string_agg(path, ';' ORDER BY path) AS paths, arg_min(title, string_split(path, '/')) AS title, count(*) AS n FROM v_notes GROUP BY 1)"


@query(f"{_VAULT}{_TITLES} SELECT title, paths FROM g WHERE n > 1")
def duplicate_titles(spark, sf_dir):
    return health.duplicate_titles(planted.vault(spark, sf_dir)).select("title", F.array_join("paths", ";").alias("paths"))


_IDS = "SELECT id, string_agg(path, ';' ORDER BY path) AS paths FROM v_notes WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1"


@query(f"{_VAULT} {_IDS}")
def duplicate_ids(spark, sf_dir):
    return health.duplicate_ids(planted.vault(spark, sf_dir)).select("id", F.array_join("paths", ";").alias("paths"))


_EMPTY = "SELECT n.path, length(trim(n.body)) AS chars, count(e.src) AS inbound FROM v_notes n LEFT JOIN ed e ON e.dst = n.path WHERE length(trim(n.body)) <= 20 GROUP BY ALL"


@query(f"{_LINKS} {_EMPTY}")
def empty_notes(spark, sf_dir):
    notes, resolved = _graph(spark, sf_dir)
    return health.empty_notes(notes, links.edges(resolved)).withColumn("chars", F.col("chars").cast("long"))


_MISSING = """SELECT path, concat_ws(',', CASE WHEN id IS NULL THEN 'id' END, CASE WHEN created IS NULL THEN 'created' END, CASE WHEN updated IS NULL THEN 'updated' END) AS missing
FROM v_notes WHERE id IS NULL OR created IS NULL OR updated IS NULL"""


@query(f"{_VAULT} {_MISSING}")
def missing_fields(spark, sf_dir):
    return health.missing_fields(planted.vault(spark, sf_dir)).select("path", F.array_join("missing", ",").alias("missing"))


_TIMES = """, f AS (SELECT path, 'created' AS field, created AS value FROM v_notes UNION ALL SELECT path, 'updated', updated FROM v_notes),
p AS (SELECT path, field, CASE WHEN NOT regexp_matches(value, '^\\d{4}-') THEN 'unparseable' WHEN regexp_matches(value, '(Z|[+-]\\d\\d:\\d\\d)$') THEN 'offset_aware' ELSE 'naive' END AS kind FROM f WHERE value IS NOT NULL)"""


@query(f"{_VAULT}{_TIMES} SELECT path, field, kind AS problem FROM p WHERE kind <> 'offset_aware'")
def invalid_timestamps(spark, sf_dir):
    return health.invalid_timestamps(planted.vault(spark, sf_dir)).select("path", "field", "problem")


@query(f"{_VAULT}{_TIMES} SELECT path, field, kind AS problem FROM p WHERE kind <> 'naive'")
def invalid_local_timestamps(spark, sf_dir):
    return health.invalid_timestamps(planted.vault(spark, sf_dir), "local").select("path", "field", "problem")


_SOURCELESS = "SELECT path, provenance FROM v_notes WHERE provenance IN ('reference', 'llm') AND coalesce(trim(source_url), '') = ''"


@query(f"{_VAULT} {_SOURCELESS}")
def missing_source(spark, sf_dir):
    return health.imported_missing_source(planted.vault(spark, sf_dir))


_COPIES = "SELECT c.path, b.path AS base_path FROM v_notes c JOIN v_notes b ON regexp_matches(c.path, ' \\d+\\.md$') AND b.path = regexp_replace(c.path, ' \\d+\\.md$', '.md')"


@query(f"{_VAULT} {_COPIES}")
def conflict_copies(spark, sf_dir):
    """The pairs; how alike they are is compared with the plain ratio in the tests."""
    return health.conflict_copies(planted.vault(spark, sf_dir)).filter("similarity BETWEEN 0 AND 1").select("path", "base_path")


@query(f"""{_LINKS}{_STALE}{_TITLES}{_TIMES}
SELECT 'missing_frontmatter_fields' AS name, count(*) AS n FROM ({_MISSING}) UNION ALL SELECT 'invalid_timestamps', count(*) FROM p WHERE kind <> 'offset_aware' UNION ALL SELECT 'duplicate_ids', count(*) FROM ({_IDS})
UNION ALL SELECT 'duplicate_titles', count(*) FROM g WHERE g.n > 1 UNION ALL SELECT 'broken_wikilinks', count(*) FROM ({_BROKEN}) UNION ALL SELECT 'dangling_targets', count(DISTINCT target) FROM ({_BROKEN})
UNION ALL SELECT 'empty_notes', count(*) FROM ({_EMPTY}) UNION ALL SELECT 'conflict_copies', count(*) FROM ({_COPIES}) UNION ALL SELECT 'imported_missing_source', count(*) FROM ({_SOURCELESS})
UNION ALL SELECT 'orphans', count(*) FROM ({_ORPHANS}) UNION ALL SELECT 'stale_distilled', count(*) FROM stale""")
def health_summary(spark, sf_dir):
    return health.summary(health.all_checks(planted.vault(spark, sf_dir), planted.files(spark, sf_dir)))


# --- chunking ---------------------------------------------------------------------------------------------

_LINE_WINDOWS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
f AS (SELECT *, sum(cast(starts_with(trim(t), '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS fences FROM l),
h AS (SELECT *, sum(cast(NOT starts_with(trim(t), '```') AND fences % 2 = 0 AND regexp_matches(t, '^#{1,3}\\s+') AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM f),
w AS (SELECT *, cast(floor((sum(length(t) + 1) OVER (PARTITION BY doc_id, part ORDER BY line) - length(t) - 1) / 1000) AS BIGINT) AS win FROM h)
SELECT doc_id, cast(part AS BIGINT) AS part, win, min(line) + 1 AS first_line, max(line) + 1 AS last_line, cast(sum(length(t) + 1) AS BIGINT) AS chars FROM w GROUP BY doc_id, part, win
"""


@query(_LINE_WINDOWS)
def line_windows(spark, sf_dir):
    out = chunking.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("part", "win", "first_line", "last_line", "chars")))


@query()
def block_chunks(spark, sf_dir):
    rows = chunking.sections(notes_view(spark, sf_dir).select("note_id", "body"))
    return rows.select("s.chunk_id", "s.heading", "s.line_start", "s.line_end", "s.token_count", T.sha256(F.col("s.text")).alias("text_sha256"))


# --- sync and summaries -----------------------------------------------------------------------------------


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The notes as they are, and an index in which some are missing, older, moved or of another version."""
    notes = notes_view(spark, sf_dir).select("doc_id", "note_id", "path", T.sha256(F.col("body")).alias("content_hash"))
    disk = notes.filter("doc_id % 11 <> 3")
    index = notes.filter("doc_id % 7 <> 2").select(
        "note_id", F.when(F.col("doc_id") % 13 == 5, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("doc_id") % 5 == 4, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 17 == 6, 1).otherwise(2).alias("schema_version"),
    )
    return disk, index


@query(f"""WITH {_NOTES}, x AS (SELECT doc_id, note_id, path, doc_id % 11 <> 3 AS d, doc_id % 7 <> 2 AS i, doc_id % 5 = 4 OR doc_id % 13 = 5 AS c, doc_id % 17 = 6 AS s,
CASE WHEN doc_id % 13 = 5 THEN 'old/' || path ELSE path END AS old_path FROM notes_v)
SELECT note_id, CASE WHEN d THEN path ELSE old_path END AS path, CASE WHEN NOT d THEN 'delete' WHEN NOT i THEN 'add' WHEN c OR s THEN 'update' ELSE 'unchanged' END AS action,
CASE WHEN NOT d THEN 'delete' WHEN NOT i THEN 'add' WHEN c THEN 'update' WHEN s THEN 'rechunk' ELSE 'unchanged' END AS reason FROM x WHERE d OR i""")
def sync_diff(spark, sf_dir):
    return sync.plan(*_sides(spark, sf_dir))


@query("WITH o AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) SELECT count(*) FILTER (o.text IS NOT NULL) AS reused, count(*) FILTER (o.text IS NULL) AS needed FROM documents d LEFT JOIN o ON d.text = o.text")
def embedding_reuse(spark, sf_dir):
    fresh = table(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("entry_hash"))
    kept = fresh.filter("doc_id % 2 = 0").withColumn("embedding", F.array(F.lit(0.0)))
    return sync.reuse(fresh, kept)


@query("SELECT lang || '-' || length(text) % 50 AS note_id, arg_min(source || '/' || doc_id || '.md', [source, doc_id || '.md']) AS path FROM documents GROUP BY 1")
def note_dedupe(spark, sf_dir):
    notes = notes_view(spark, sf_dir).withColumn("note_id", F.concat("note_type", F.lit("-"), (F.length("body") % 50).cast("string")))
    return health.first_of_each(notes).select("note_id", "path")


@query("""SELECT count(*) FILTER (doc_id % 3 = 0) AS ready, count(*) FILTER (doc_id % 3 = 1) AS stale, count(*) FILTER (doc_id % 3 = 2) AS missing, 1 AS orphaned,
round(count(*) FILTER (doc_id % 3 = 0) / count(*), 4) AS coverage FROM documents""")
def summary_status(spark, sf_dir):
    notes = notes_view(spark, sf_dir)
    done = summaries.fingerprinted(notes).filter("doc_id % 3 < 2")
    have = done.select("note_id", F.when(F.col("doc_id") % 3 == 0, F.col("fingerprint")).otherwise("old").alias("source_fingerprint"))
    have = have.unionByName(spark.createDataFrame([("gone", "x")], "note_id string, source_fingerprint string"))
    out = summaries.coverage(summaries.status(notes, have))
    return out.withColumn("orphaned", F.col("orphaned").cast("int"))


# --- evaluation ---------------------------------------------------------------------------------------------


def _golden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, groups and hits of a query for each 25 documents: two documents may be sections of one note, every third hit is a whole note."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("n_chars") % 97), "doc_id"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("q"), F.floor(F.col("doc_id") / 25).cast("string")).alias("query_id"), F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".md")).alias("path"),
        F.col("lang").alias("heading"), "doc_id", "n_chars",
    )
    grade = F.when(F.col("quality") == 1, 2 + F.col("doc_id") % 2).otherwise(F.col("toxic")).cast("int")
    labels = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("query_id", "path", "heading", grade.alias("grade"), F.col("doc_id").alias("ord"))
    groups = labels.filter("grade >= 2").select("query_id", (F.col("ord") % 3).alias("group_no"), "path", "heading")
    hits = docs.select("query_id", place.alias("rank"), "path", "heading", F.concat("path", F.when(F.col("doc_id") % 3 == 0, "::doc").otherwise("::s001")).alias("chunk_id"))
    return labels, groups, hits


_GOLD = """
WITH RECURSIVE d AS (SELECT 'q' || cast(floor(doc_id / 25) AS BIGINT) AS query_id, source || '/' || cast(floor(doc_id / 2) AS BIGINT) || '.md' AS path, lang AS heading, doc_id, n_chars FROM documents),
g_labels AS (SELECT query_id, path, {heading} AS heading, CASE WHEN quality = 1 THEN 2 + doc_id % 2 ELSE toxic END AS grade, doc_id AS ord FROM d JOIN labels USING (doc_id)),
g_groups AS (SELECT query_id, ord % 3 AS group_no, path, heading FROM g_labels WHERE grade >= 2),
g_hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars % 97 DESC, doc_id) AS rank, path, heading, {whole} AS whole FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, ord, path, heading) AS n
      FROM (SELECT query_id, path, heading, max(grade) AS grade, min(ord) AS ord FROM g_labels GROUP BY ALL HAVING max(grade) > 0)),
m AS (SELECT h.query_id, h.rank, list(u.n ORDER BY u.n) AS fits FROM g_hits h JOIN u ON h.query_id = u.query_id AND h.path = u.path AND (h.whole OR h.heading = u.heading) WHERE h.rank <= 5 GROUP BY ALL),
f AS (
  SELECT query_id, 0 AS r, [0]::BIGINT[] AS taken, NULL::BIGINT AS best FROM (SELECT DISTINCT query_id FROM u)
  UNION ALL
  SELECT query_id, r, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END, best
  FROM (SELECT f.query_id, f.r + 1 AS r, f.taken, list_filter(m.fits, lambda x: NOT list_contains(f.taken, x))[1] AS best FROM f LEFT JOIN m ON m.query_id = f.query_id AND m.rank = f.r + 1 WHERE f.r < 5)
),
c AS (SELECT u.*, f.r AS rank FROM u LEFT JOIN f ON f.query_id = u.query_id AND f.best = u.n)
"""
_EVAL = _GOLD.format(heading="heading", whole="doc_id % 3 = 0")
_EVAL_NOTES = _GOLD.format(heading="''", whole="true")
_NDCG = """SELECT query_id, round(sum(CASE WHEN rank <= 5 THEN grade / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN n <= 5 THEN grade / log2(n + 1) ELSE 0 END), 4) AS ndcg FROM c GROUP BY query_id"""


@query(f"{_EVAL} {_NDCG}")
def ndcg(spark, sf_dir):
    labels, _, hits = _golden(spark, sf_dir)
    return evaluation.ndcg(evaluation.claims(labels, hits)).select("query_id", F.round("ndcg", 4).alias("ndcg"))


@query(f"{_EVAL_NOTES} {_NDCG}")
def ndcg_of_notes(spark, sf_dir):
    labels, _, hits = _golden(spark, sf_dir)
    return evaluation.ndcg(evaluation.claims(labels, hits, note_level=True)).select("query_id", F.round("ndcg", 4).alias("ndcg"))


@query(f"{_EVAL} SELECT query_id, path, heading, cast(grade AS INT) AS grade, cast(rank AS INT) AS rank FROM c WHERE rank IS NOT NULL")
def claimed_labels(spark, sf_dir):
    labels, _, hits = _golden(spark, sf_dir)
    return evaluation.claims(labels, hits).filter("rank IS NOT NULL").select("query_id", "path", "heading", "grade", "rank")


@query(f"""{_EVAL}, o AS (SELECT g.query_id, g.group_no, coalesce(bool_or(h.rank IS NOT NULL), false) AS ok
FROM g_groups g LEFT JOIN g_hits h ON h.rank <= 5 AND h.query_id = g.query_id AND h.path = g.path AND (h.whole OR h.heading = g.heading) GROUP BY ALL)
SELECT query_id, round(avg(cast(ok AS INT)), 4) AS recall, bool_and(ok) AS complete, coalesce(string_agg(CASE WHEN NOT ok THEN group_no END, ',' ORDER BY group_no), '') AS unmet FROM o GROUP BY query_id""")
def group_recall(spark, sf_dir):
    _, groups, hits = _golden(spark, sf_dir)
    return evaluation.group_recall(groups, hits).select("query_id", F.round("recall", 4).alias("recall"), "complete", F.array_join(F.col("unmet").cast("array<string>"), ",").alias("unmet"))


_RR = """SELECT q.query_id, cast(min(h.rank) AS INT) AS first_rank, round(coalesce(1 / min(h.rank), 0), 4) AS rr FROM (SELECT DISTINCT query_id FROM g_labels) q
LEFT JOIN u ON u.query_id = q.query_id AND u.grade = 3 LEFT JOIN g_hits h ON h.query_id = u.query_id AND h.path = u.path AND (h.whole OR h.heading = u.heading) GROUP BY q.query_id"""


@query(f"{_EVAL} {_RR}")
def mrr(spark, sf_dir):
    labels, _, hits = _golden(spark, sf_dir)
    return evaluation.reciprocal_rank(labels, hits).select("query_id", "first_rank", F.round("rr", 4).alias("rr"))


@query(f"{_EVAL} SELECT query_id, path, heading, cast(grade AS INT) AS grade FROM c WHERE grade >= 2 AND rank IS NULL")
def missed_evidence(spark, sf_dir):
    labels, _, hits = _golden(spark, sf_dir)
    return evaluation.missed(evaluation.claims(labels, hits))


@query(f"""{_EVAL}, n AS ({_NDCG}), r AS ({_RR}), o AS (SELECT g.query_id, g.group_no, coalesce(bool_or(h.rank IS NOT NULL), false) AS ok
FROM g_groups g LEFT JOIN g_hits h ON h.rank <= 5 AND h.query_id = g.query_id AND h.path = g.path AND (h.whole OR h.heading = g.heading) GROUP BY ALL),
p AS (SELECT query_id, round(avg(cast(ok AS INT)), 4) AS recall, bool_and(ok) AS complete FROM o GROUP BY query_id),
s AS (SELECT r.query_id, coalesce(ndcg, 0) AS ndcg, coalesce(recall, 0) AS recall, coalesce(complete, false) AS complete, rr FROM r LEFT JOIN n USING (query_id) LEFT JOIN p USING (query_id))
SELECT count(*) AS queries_scored, round(avg(ndcg), 4) AS mean_ndcg, round(avg(recall), 4) AS mean_recall, round(avg(cast(complete AS INT)), 4) AS complete_rate, round(avg(rr), 4) AS mrr FROM s""")
def eval_means(spark, sf_dir):
    return evaluation.retrieval_means(evaluation.scores(*_golden(spark, sf_dir)))


@query("""WITH r AS (SELECT conv_id, turn, turn % 3 > 0 AS answerable, length(text) % 4 = 0 AS abstained, length(text) % 5 <> 0 AS complete, CASE WHEN turn % 2 = 0 THEN round(length(text) % 11 / 10, 4) END AS coverage,
CASE WHEN length(text) % 7 < 4 THEN length(text) % 7 END AS forbidden, length(text) % 13 = 0 AS failed FROM conversations)
SELECT count(*) AS queries_scored, round(avg(cast(abstained <> answerable AS INT)), 4) AS abstention_accuracy, round(avg(cast(abstained AS INT)) FILTER (answerable), 4) AS false_abstain_rate,
round(avg(cast(NOT abstained AS INT)) FILTER (NOT answerable), 4) AS false_answer_rate, round(avg(cast(complete AS INT)) FILTER (answerable AND NOT abstained), 4) AS citation_complete_rate,
round(avg(coverage) FILTER (answerable), 4) AS gold_fact_coverage, round(avg(cast(forbidden > 0 AS INT)) FILTER (forbidden IS NOT NULL AND NOT failed), 4) AS forbidden_fact_violation_rate,
count(*) FILTER (failed) AS judge_failures FROM r""")
def answer_means(spark, sf_dir):
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("turn") % 3 > 0).alias("answerable"), (n % 4 == 0).alias("abstained"), (n % 5 != 0).alias("citation_complete"), F.when(F.col("turn") % 2 == 0, F.round(n % 11 / 10, 4)).alias("gold_fact_coverage"),
        F.when(n % 7 < 4, F.array_repeat(F.lit("f"), (n % 7).cast("int"))).alias("forbidden_facts_present"), (n % 13 == 0).alias("judge_failed"),
    )
    return evaluation.synthesis_means(rows.withColumn("abstention_correct", F.col("abstained") != F.col("answerable")))


@query("""WITH r AS (SELECT doc_id, lang AS category, [source, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END] AS slices, round(n_chars % 100 / 99, 4) AS m FROM documents),
u AS (SELECT 'overall' AS kind, '' AS name, m FROM r UNION ALL SELECT 'category', category, m FROM r UNION ALL SELECT 'slice', unnest(slices), m FROM r)
SELECT kind, name, count(*) AS n, round(avg(m), 4) AS score FROM u GROUP BY kind, name""")
def eval_breakdown(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("lang").alias("category"), F.array("source", F.when(F.col("n_chars") > 1500, "long").otherwise("short")).alias("slices"),
        F.round(F.col("n_chars") % 100 / 99, 4).alias("score"),
    )
    return evaluation.breakdown(rows, ("score",))


@query("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'no document' WHEN quality NOT IN (0, 1) THEN 'quality' ELSE 'toxic' END AS problem FROM labels l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL OR quality NOT IN (0, 1) OR toxic <> 0")
def label_validation(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "labels").join(known, "doc_id", "left")
    problem = F.when(F.col("known").isNull(), "no document").when(~F.col("quality").isin(0, 1), "quality").when(F.col("toxic") != 0, "toxic")
    return rows.select("doc_id", problem.alias("problem")).filter("problem IS NOT NULL")


# --- backfill, edits, answers -----------------------------------------------------------------------------------


@query(f"""{_VAULT} SELECT path, CASE WHEN provenance <> '' THEN provenance WHEN note_type = 'distilled' THEN 'distilled' WHEN trim(lower(source_type)) = 'llm' THEN 'llm'
WHEN trim(coalesce(source_url, '')) <> '' OR source_type = 'web' THEN 'reference' ELSE 'human' END AS provenance, provenance = '' AS filled FROM v_notes""")
def provenance_backfill(spark, sf_dir):
    return backfill.provenance(planted.vault(spark, sf_dir))


#: Frontmatter of each kind that the rules tell apart, and the times of commits and files.
_FRONT = {
    "path": "cast(doc_id AS STRING) || '.md'",
    "id": "CASE WHEN doc_id % 3 = 0 THEN 'id' || cast(CASE WHEN doc_id % 30 = 27 THEN doc_id - 3 ELSE doc_id END AS STRING) END",
    "uid": "CASE WHEN doc_id % 12 = 3 THEN 'id' || cast(doc_id AS STRING) WHEN doc_id % 12 = 6 THEN 'other' WHEN doc_id % 12 = 7 THEN '01ARZ3NDEKTSV4RRFFQ69G5FAV' WHEN doc_id % 12 = 8 THEN 'old' END",
    "luid": "CASE WHEN doc_id % 24 = 8 THEN 'older' END",
    "created": "CASE WHEN doc_id % 7 = 1 THEN '2024-01-01T00:00:00Z' WHEN doc_id % 35 = 9 THEN 'once' WHEN doc_id % 7 = 5 THEN '2024-09-01T00:00:00Z' END",
    "updated": "CASE WHEN doc_id % 5 = 0 THEN '2024-02-01T00:00:00Z' END",
    "date": "CASE WHEN doc_id % 8 = 4 THEN '2023-05-05T06:07:08Z' WHEN doc_id % 40 = 11 THEN 'never' END",
    "first_commit": "CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2023-06-01 01:02:03' END",
    "last_commit": "CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-07-01 01:02:03' END",
    "birth": "CASE WHEN doc_id % 9 = 1 THEN TIMESTAMP '2022-02-02 01:02:03' END",
    "mtime": "TIMESTAMP '2024-03-01 01:02:03'",
}
_NAMED = ("id", "uid", "luid", "created", "updated", "date")
_FRONT_SQL = f"""WITH v AS (SELECT doc_id, {', '.join(f'{e} AS {c}' for c, e in _FRONT.items())} FROM documents), w AS (SELECT *, doc_id % 50 = 49 AS broken, count(id) OVER (PARTITION BY id) AS n FROM v),
m AS (SELECT *, CASE WHEN broken THEN 'frontmatter present but failed to parse' WHEN id IS NOT NULL AND (uid <> id OR luid <> id) THEN 'id and legacy identifier disagree' WHEN uid <> luid THEN 'multiple legacy identifiers disagree'
  WHEN created = 'once' THEN 'created value does not parse' WHEN date = 'never' THEN 'date value does not parse' WHEN id IS NOT NULL AND n > 1 THEN 'duplicate id shared across notes' END AS reason FROM w)"""


def _front(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", *(f"{e} AS `{c}`" for c, e in _FRONT.items()))
    broken = F.col("doc_id") % 50 == 49
    names = F.when(broken, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.lit("a"), *(F.when(F.col(c).isNotNull(), F.lit(c)) for c in _NAMED))))
    fields = F.when(broken, "{}").otherwise(F.to_json(F.struct(*_NAMED)))
    raw = F.when(broken, "---\n: [\n---\nbody").otherwise("---\na: 1\n---\nbody")
    return rows.select("path", raw.alias("raw"), fields.alias("fields"), names.alias("field_names"), *(F.col(c).cast("timestamp").alias(c) for c in ("first_commit", "last_commit", "birth", "mtime")))


@query(f"{_FRONT_SQL} SELECT path, reason FROM m WHERE reason IS NOT NULL")
def frontmatter_manual(spark, sf_dir):
    return backfill.manual(_front(spark, sf_dir))


_STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


@query(f"""{_FRONT_SQL}, c AS (SELECT *, coalesce(date, {_STAMP.format('first_commit')}, {_STAMP.format('birth')}, {_STAMP.format('mtime')}) AS c_value,
CASE WHEN date IS NOT NULL THEN 'legacy_field/high' WHEN first_commit IS NOT NULL THEN 'git_first_commit/high' WHEN birth IS NOT NULL THEN 'birthtime/medium' ELSE 'mtime/low' END AS c_how,
coalesce({_STAMP.format('last_commit')}, {_STAMP.format('mtime')}) AS u_value, CASE WHEN last_commit IS NOT NULL THEN 'git_last_commit/high' ELSE 'mtime/medium' END AS u_how FROM m WHERE reason IS NULL)
SELECT path, 'id' AS field, coalesce(uid, luid, '(ulid)') AS value, CASE WHEN coalesce(uid, luid) IS NULL THEN 'generated/high' ELSE 'legacy_field/high' END AS how, CASE WHEN length(coalesce(uid, luid)) < 26 THEN 1 ELSE 0 END AS warned
FROM c WHERE id IS NULL
UNION ALL SELECT path, 'created', c_value, c_how, 0 FROM c WHERE created IS NULL
UNION ALL SELECT path, 'updated', greatest(u_value, coalesce(created, c_value)), u_how, CASE WHEN u_value < coalesce(created, c_value) THEN 1 ELSE 0 END FROM c WHERE updated IS NULL""")
def frontmatter_resolution(spark, sf_dir):
    rows = backfill.resolution(_front(spark, sf_dir), commits="high", policy="utc_z")
    value = F.when((F.col("source") == "generated") & T.is_ulid(F.col("value")), "(ulid)").otherwise(F.col("value"))
    return rows.select("path", "field", value.alias("value"), F.concat("source", F.lit("/"), "confidence").alias("how"), F.size("warnings").alias("warned"))


@query("""WITH w AS (SELECT doc_id, text, regexp_extract(text, '[\\p{L}]+') AS word FROM documents), n AS (SELECT *, (length(text) - length(replace(text, word, ''))) // length(word) AS n FROM w WHERE word <> '')
SELECT doc_id, CASE WHEN n > 1 THEN 'ambiguous' END AS error, CASE WHEN n = 1 THEN sha256(replace(text, word, 'X')) END AS body_sha256 FROM n""")
def text_edits(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("word", F.regexp_extract("text", "[\\p{L}]+", 0)).filter("word <> ''")
    change = F.to_json(F.array(F.struct(F.col("word").alias("old_text"), F.lit("X").alias("new_text"))))
    return rows.select("doc_id", edits.edited("text", change).alias("e")).select("doc_id", "e.error", T.sha256(F.col("e.body")).alias("body_sha256"))


from . import corpus_queries  # noqa: E402  the rest of the queries, which use the parts above

__all__ = ["corpus_queries", "oracle_sql", "queries"]
