"""What is told about each result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import everything


def z_score(score: str) -> Column:
    """With the population deviation; 0 for a constant column."""
    std = F.stddev_pop(score).over(everything())
    return F.when(std < 1e-9, 0.0).otherwise((F.col(score) - F.avg(score).over(everything())) / std)


def why(rows: DataFrame) -> DataFrame:
    """Adds ``why``, one of four labels (fixed values); ``rerank_rank`` may be null."""
    rows = rows.withColumns({"__k": z_score("keyword"), "__s": z_score("semantic")})
    label = (
        F.when(F.col("rerank_rank") <= 3, F.concat(F.lit("reranked into top "), F.col("rerank_rank").cast("string"), F.lit(" for this query")))
        .when(F.col("__k") > F.col("__s"), "strong keyword match")
        .when(F.col("__s") > F.col("__k"), "strong semantic match")
        .otherwise("combined keyword+semantic signal")
    )
    return rows.withColumn("why", label).drop("__k", "__s")


def evidence(rows: DataFrame) -> DataFrame:
    """One nested record per result."""
    return why(rows).select(
        "note_id", "path", "title", F.col("note_type").alias("type"), "provenance", T.excerpt(F.col("body")).alias("excerpt"),
        F.struct(*(F.round(c, 4).alias(c) for c in ("keyword", "semantic", "fused", "freshness", "final"))).alias("scores"), "why",
    )


def bars(score: str, lead: str | None = None) -> Column:
    """0 to 100 within the result set, never outside; a set without spread shows 0.

    With ``lead``, rows without that score are left out of the scale and show null.
    """
    own = F.col(score) if lead is None else F.when(F.col(lead).isNotNull(), F.col(score))
    low, high = F.min(own).over(everything()), F.max(own).over(everything())
    span = F.when(high - low == 0, 1.0).otherwise(high - low)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round((own - low) / span * 100, 0)))


def context(rows: DataFrame, order: list[Column], most: int = 8, text: str = "body", score: str = "final") -> DataFrame:
    """key (S0, S1, ...), note_id and block of the first rows, ready for a prompt.

    A block names its key and score, and where a note is not its owner's writing its
    provenance; a distilled note is known by its type where it has none.
    """
    place = F.row_number().over(everything().orderBy(*order)) - 1
    kind = F.coalesce(F.nullif(F.lower("provenance"), F.lit("")), F.when(F.col("note_type") == "distilled", "distilled"), F.lit(""))
    mark = F.when(kind.isin("distilled", "reference", "llm"), F.concat(F.lit(" provenance="), kind)).otherwise("")
    key = F.concat(F.lit("S"), F.col("__place").cast("string"))
    head = F.concat(F.lit("<"), key, mark, F.lit(" score="), F.format_string("%.4f", F.col(score)), F.lit(">"))
    block = F.concat_ws("\n", head, F.concat(F.lit("Title: "), F.coalesce("title", F.lit("(untitled)"))), F.concat(F.lit("Path: "), "path"), T.excerpt(F.col(text)), F.concat(F.lit("</"), key, F.lit(">")))
    rows = rows.withColumn("__place", place).filter(F.col("__place") < most)
    return rows.select(key.alias("key"), "note_id", block.alias("block"))
