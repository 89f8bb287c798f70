"""Caps, rerank scores, freshness and the recency budget; inputs are candidate sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from .fusion import everything

#: Sections of one note that a result may hold.
PER_NOTE = 3


@dataclass(frozen=True)
class SearchParams:
    """Parameters of a search, checked when made."""

    semantic_weight: float = 0.5
    top_k: int = 150
    n_results: int = 10
    strategy: str = "rrf"
    rrf_k: float = 60
    temperature: float = 1.0
    rerank_top_k: int = 30
    use_ranks: bool = True
    recency: str = "off"
    recency_weight: float = 0.5
    recency_decay_days: float = 180
    recency_budget: int = 1
    recency_strategy: str = "geometry"
    strategies: tuple[str, ...] = field(default=("rrf", "zsigmoid", "minmax"), repr=False)

    def __post_init__(self) -> None:
        rules = {
            "semantic_weight": 0 <= self.semantic_weight <= 1, "top_k": self.top_k >= 1, "n_results": self.n_results >= 1, "strategy": self.strategy in self.strategies,
            "rrf_k": self.rrf_k > 0, "temperature": self.temperature > 0, "rerank_top_k": self.rerank_top_k >= 0, "recency": self.recency in ("off", "geometry", "multiplicative"),
            "recency_strategy": self.recency_strategy in ("geometry", "multiplicative"), "recency_weight": 0 <= self.recency_weight <= 1, "recency_decay_days": self.recency_decay_days > 0, "recency_budget": self.recency_budget >= 0,
        }
        if bad := [k for k, ok in rules.items() if not ok]:
            raise ValueError(f"out of range: {', '.join(bad)}")

    @property
    def scores_by(self) -> str:
        """The recency strategy whose scores count, whether or not recency is on."""
        return self.recency_strategy if self.recency == "off" else self.recency


def cap_per_note(rows: DataFrame, order: list[Column], note: str = "note_id", most: int = PER_NOTE) -> DataFrame:
    """At most ``most`` rows of each note in the given order; Spark limits ranks before the shuffle."""
    place = F.row_number().over(Window.partitionBy(note).orderBy(*order))
    return rows.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")


def rank_scores(rows: DataFrame, score: str, key: str) -> DataFrame:
    """Adds ``rank_score``: 1 for the first place down to 0.5 for the last."""
    place = F.row_number().over(everything().orderBy(F.desc(score), key)) - 1
    last = F.greatest(F.count(F.lit(1)).over(everything()) - 1, F.lit(1))
    return rows.withColumn("rank_score", 1 - place / last * 0.5)


def _reranked(provider: Callable[[list[str]], list[float]], most: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by("__place").combine_chunks()
        pool = whole.column(text)[:most].to_pylist()
        try:
            scores = [float(x) for x in provider(pool)]
            if len(scores) != len(pool):
                raise ValueError("a score for each text is needed")
        except Exception:  # a failed provider leaves the fused order
            scores = [None] * len(pool)
        told = pa.array(scores + [None] * (whole.num_rows - len(pool)), pa.float64())
        yield from whole.drop_columns(["__place"]).append_column("reranker", told).to_batches()

    return run


def rerank(rows: DataFrame, provider: Callable[[list[str]], list[float]] | None, params: SearchParams, text: str = "body", key: str = "note_id") -> DataFrame:
    """Adds ``reranker`` to the best fused rows; null beyond the pool, without a provider or when it fails.

    The candidates are one group of bounded size, so the task that holds them asks the provider
    once, when the result is read.
    """
    if provider is None or not params.rerank_top_k:
        return rows.withColumn("reranker", F.lit(None).cast("double"))
    place = F.row_number().over(everything().orderBy(F.desc("fused"), key))
    kinds = Y.StructType([*rows.schema.fields, Y.StructField("reranker", Y.DoubleType())])
    return rows.withColumn("__place", place).mapInArrow(_reranked(provider, params.rerank_top_k, text), kinds)


def relevance(rows: DataFrame, params: SearchParams, key: str = "note_id") -> DataFrame:
    """Adds ``rerank_rank`` and ``relevance``: what the order starts from.

    Score geometry takes the reranker's own scores; otherwise, with ``use_ranks``, its places
    count, from 1 down to 0.5.  A row that was not reranked keeps its fused score.
    """
    place = F.row_number().over(everything().orderBy(F.desc_nulls_last("reranker"), key))
    n = F.count("reranker").over(everything())
    rows = rows.withColumn("rerank_rank", F.when(F.col("reranker").isNotNull(), place))
    by_rank = 1 - (F.col("rerank_rank") - 1) / F.greatest(n - 1, F.lit(1)) * 0.5
    own = F.col("reranker") if params.scores_by == "geometry" or not params.use_ranks else by_rank
    return rows.withColumn("relevance", F.coalesce(own, F.col("fused")))


def age_days(updated: Column, now: Column) -> Column:
    """Whole days, not below 0."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))
    return F.greatest(F.floor(micros / 86_400_000_000), F.lit(0))


def freshness(updated: Column, now: Column, decay_days: float) -> Column:
    """exp(-age / decay); 0 without a time."""
    return F.coalesce(F.exp(-age_days(updated, now) / F.lit(float(decay_days))), F.lit(0.0))


def recency_budget(rows: DataFrame, cutoff: int, budget: int, score: str = "relevance", key: str = "note_id") -> DataFrame:
    """Adds ``budget``: how far the score at the cutoff is above the one ``budget`` places below it.

    Places are held to the pool; a pool of fewer than two rows gives 0.
    """
    place = F.row_number().over(everything().orderBy(F.desc(score), key))
    rows = rows.withColumn("__place", place)
    n = F.count(F.lit(1)).over(everything())
    at = lambda k: F.max(F.when(F.col("__place") == F.least(n, F.lit(k)), F.col(score))).over(everything())
    gap = F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), at(cutoff) - at(cutoff + budget)))
    return rows.withColumn("budget", gap).drop("__place")


def geometry(rows: DataFrame, cutoff: int, budget: int, score: str = "relevance", key: str = "note_id") -> DataFrame:
    """Adds ``final``: the score plus freshness times the budget."""
    return recency_budget(rows, cutoff, budget, score, key).withColumn("final", F.col(score) + F.col("budget") * F.col("freshness"))


def multiplicative(rows: DataFrame, weight: float, score: str = "relevance") -> DataFrame:
    """Adds ``final``: the score blended with itself times 1 + freshness."""
    return rows.withColumn("final", F.col(score) * (1 - weight) + F.col(score) * (1 + F.col("freshness")) * weight)
