"""A training corpus from raw documents: five stages, each written and read again by the next.

1. quality: documents that the classifier rejects go;
2. exact: of equal texts one stays;
3. near: of each group of near copies one stays;
4. benchmark: documents that hold a window of a benchmark item go;
5. encode: the ids of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontaminate, exact_dedup, quality, simhash
from quillspark.llm.tables import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labels that are not held out, predicts good."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest row, then the smallest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of texts whose five-word shingles have a similarity of 0.8 and more."""
    return simhash.near_dedup(docs, shingle=5, similarity=(4, 5))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the decoded text."""
    return bpe.digest(bpe.encode(docs, decoded=True))


STAGES = [("quality", keep_good), ("exact", drop_copies), ("near", drop_near_copies), ("benchmark", drop_leaks), ("encode", encode)]

#: The classifier and the encoder have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
