"""Hybrid search: one lazy plan from notes and vectors to explained results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dense, evidence, fusion, lexical, ranking


#: Sections and whole notes: what a search may look through.
GRANULARITIES = ("document", "section", "mixed")


def candidates(texts: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float] | Column, top_k: int, key: str = "note_id", text: str = "body", stemmed: bool = True) -> DataFrame:
    """key, semantic (0 beyond its top-k) and keyword of the rows in either top-k.

    One pass over the texts for their statistics, one for their scores, and one over the
    vectors.  The nearest rows come first in the one sort that picks 2 * top_k rows, so what is
    left of it holds at least the top_k of all others.
    """
    words = lexical.scored(lexical.tokenized(texts.select(key, text), text, stemmed=stemmed), lexical.query_terms(query.replace('"', " "), stemmed))
    words = words.select(key, (F.col("keyword") * lexical.phrase_boost(query, text)).alias("keyword"))
    near = dense.nearest(vectors, vector, top_k, key).select(key, dense.similarity(F.col("distance")).alias("semantic"))
    found = words.join(F.broadcast(near), key, "left")  # top_k rows
    best = found.orderBy(F.col("semantic").isNull(), F.desc("keyword"), key).limit(2 * top_k)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("keyword"), key))
    kept = best.withColumn("__place", place).filter((F.col("__place") <= top_k) | F.col("semantic").isNotNull())
    return kept.select(key, F.coalesce("semantic", F.lit(0.0)).alias("semantic"), "keyword")


def retrieve(notes: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float] | Column, params: ranking.SearchParams, allowed: Column | None = None,
             now: Column | None = None, mixed: bool = False, provider: Callable[[list[str]], list[float]] | None = None, stemmed: bool = True, texts: DataFrame | None = None,
             key: str = "note_id", group: str = "group_id", lexical_text: str = "body") -> DataFrame:
    """key, semantic, keyword, fused, reranker, rerank_rank, freshness, relevance, final and place of the results.

    ``notes`` are whole notes, or sections of them: rows of ``sync.entries`` of one granularity,
    with ``entry_id`` as key, the note in ``group`` and their ``lexical`` text.  With ``mixed``
    a note gives at most three sections, before and after ranking.

    Both top-k's are taken over all rows and filtered after that.  ``vectors``: key and
    embedding; ``texts``: key and text, where they are to be had without the joins that make
    ``notes``.  Beyond the passes of ``candidates`` every step handles at most 2 * top_k rows.
    """
    source = notes if texts is None else texts
    rows = candidates(source, vectors, query, vector, params.top_k, key, lexical_text, stemmed)
    within = notes.filter(allowed) if allowed is not None else notes
    rows = within.join(F.broadcast(rows), key)
    fuse = {"rrf": lambda r: fusion.rrf(r, params.semantic_weight, params.rrf_k), "zsigmoid": lambda r: fusion.z_sigmoid(r, params.semantic_weight, params.temperature), "minmax": lambda r: fusion.min_max_fusion(r, params.semantic_weight)}
    rows = fuse[params.strategy](rows)
    if mixed:
        rows = ranking.cap_per_note(rows, [F.desc("fused"), F.col(key)], group)
    rows = ranking.relevance(ranking.rerank(rows, provider, params, key=key), params, key)
    fresh = ranking.freshness(F.col("updated"), now, params.recency_decay_days) if now is not None and params.recency != "off" else F.lit(0.0)
    rows = rows.withColumn("freshness", fresh)
    if params.recency == "geometry":
        rows = ranking.geometry(rows, params.n_results, params.recency_budget, key=key)
    elif params.recency == "multiplicative":
        rows = ranking.multiplicative(rows, params.recency_weight)
    else:
        rows = rows.withColumn("final", F.col("relevance"))
    order = [F.desc("final"), F.desc("fused"), F.col(key)]
    if mixed:
        rows = ranking.cap_per_note(rows, order, group)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= params.n_results)


class EmptyScopeError(ValueError):
    """No note passes the filters."""


def checked_scope(notes: DataFrame, allowed: Column | None) -> DataFrame:
    """``notes`` within the filters; raises where there are none, before a search is begun."""
    if notes.isEmpty():
        raise EmptyScopeError("the index is empty")
    kept = notes if allowed is None else notes.filter(allowed)
    if allowed is not None and kept.isEmpty():
        raise EmptyScopeError("no note passes the filters")
    return kept


def explained(results: DataFrame) -> DataFrame:
    """Evidence records of the results."""
    return evidence.evidence(results)
