"""Fusing a semantic and a keyword ranking; inputs are candidate sets of at most a few hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def everything() -> WindowSpec:
    """All rows as one group; only for candidate sets, which a top-k bounds."""
    return Window.partitionBy(F.lit(1))


def _over(by: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*by) if by else everything()


def min_max(score: Column, by: tuple[str, ...] = ()) -> Column:
    """Scaled to 0..1; a constant column becomes 0.5."""
    w = _over(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-12, 0.5).otherwise((score - low) / (high - low))


def average_rank(score: str, by: tuple[str, ...] = ()) -> Column:
    """Descending rank, ties sharing the mean of their places."""
    place = F.rank().over(_over(by).orderBy(F.desc(score)))
    tied = F.count(F.lit(1)).over(Window.partitionBy(*by, score))
    return place + (tied - 1) / 2


def rrf(rows: DataFrame, weight: float = 0.5, k: float = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``fused``, the weighted sum of both reciprocal ranks scaled to 0..1, and each of them scaled alike."""
    rows = rows.withColumns({"__s": 1 / (k + average_rank("semantic", by)), "__k": 1 / (k + average_rank("keyword", by))})
    rows = rows.withColumn("__sum", weight * F.col("__s") + (1 - weight) * F.col("__k"))
    scaled = {"fused": min_max(F.col("__sum"), by), "semantic_part": min_max(F.col("__s"), by), "keyword_part": min_max(F.col("__k"), by)}
    return rows.withColumns(scaled).drop("__s", "__k", "__sum")


def z_sigmoid(rows: DataFrame, weight: float = 0.5, temperature: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``fused``: a sigmoid of each score's z, with the population deviation."""
    w = _over(by)

    def squash(c: str) -> Column:
        std = F.stddev_pop(c).over(w)
        z = (F.col(c) - F.avg(c).over(w)) / F.when(std <= 1e-8, 1.0).otherwise(std)
        return 1 / (1 + F.exp(-z / temperature))

    return rows.withColumn("fused", weight * squash("semantic") + (1 - weight) * squash("keyword"))


def min_max_fusion(rows: DataFrame, weight: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.withColumn("fused", weight * min_max(F.col("semantic"), by) + (1 - weight) * min_max(F.col("keyword"), by))
