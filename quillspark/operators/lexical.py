"""BM25 over a corpus.

Corpus statistics take one shuffle, on the term; scoring takes none, as a query's few terms are
counted inside each row and weighted from a map that is a scalar subquery of the same plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.porter import stem, stems

#: Saturation, length weight, floor of a negative weight, gain of a phrase.
K1, B, EPSILON, PHRASE_GAIN = 1.2, 0.75, 0.25, 0.3


def tokenized(docs: DataFrame, text: str = "body", stemmed: bool = False) -> DataFrame:
    """``docs`` with ``tokens``; stemming is the only step that leaves the JVM."""
    own = T.tokens(F.col(text))
    return docs.withColumn("tokens", stems(own) if stemmed else own)


def query_terms(query: str, stemmed: bool = False) -> list[str]:
    """Tokens of a query, in order and with repeats."""
    own = [w for w in re.findall(r"\w+", query.lower()) if w not in T.STOP_WORDS]
    return [stem(w) for w in own] if stemmed else own


def _grouped(tokens: DataFrame) -> DataFrame:
    """term, df and len; the row without a term counts the documents and all their tokens.

    Frequencies and totals come from one pass over the tokens and one shuffle, on the term.
    """
    marked = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("len")))
    total = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("tokens").cast("long").alias("len")))
    return tokens.select(F.explode(F.concat(marked, total)).alias("t")).groupBy("t.term").agg(F.count(F.lit(1)).alias("df"), F.sum("t.len").alias("len"))


def document_frequencies(tokens: DataFrame) -> DataFrame:
    return _grouped(tokens).filter("term IS NOT NULL").select("term", "df")


def corpus_totals(tokens: DataFrame) -> DataFrame:
    """One row: number of documents, those without tokens included, and mean length."""
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum(F.size("tokens")) / F.count(F.lit(1))).alias("avg_len"))


def _raw_weights(tokens: DataFrame) -> DataFrame:
    """``_grouped`` with the raw weight of each term; counting the documents reads no text."""
    n = tokens.agg(F.count(F.lit(1))).scalar()
    return _grouped(tokens).withColumn("raw", F.when(F.col("term").isNotNull(), F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))


def weights(tokens: DataFrame) -> DataFrame:
    """term, df and idf; a negative idf becomes a share of the mean over all terms."""
    raw = _raw_weights(tokens)
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.filter("term IS NOT NULL").select("term", "df", F.when(F.col("raw") < 0, mean * EPSILON).otherwise(F.col("raw")).alias("idf"))


def scored(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """``tokens`` with ``keyword``: the BM25 score of each row, 0 where nothing is met.

    Two passes over the tokens: one for the statistics, one for the scores.
    """
    if not terms:
        return tokens.withColumn("keyword", F.lit(0.0))
    # The mean weight, the few weights that are asked for and the mean length, as one row.
    own = F.collect_list(F.when(F.col("term").isin(*terms), F.struct("term", "raw")))
    length = F.max(F.when(F.col("term").isNull(), F.col("len") / F.col("df")))
    told = _raw_weights(tokens).agg(F.avg("raw").alias("mean"), F.map_from_entries(own).alias("own"), length.alias("length")).select(F.struct("mean", "own", "length")).scalar()
    rows = tokens.withColumn("__told", told).withColumn("__len", F.size("tokens") / F.col("__told.length"))

    def part(total: Column, term: Column) -> Column:
        tf = F.size(F.filter("tokens", lambda t: t == term)).cast("double")
        raw = F.coalesce(F.try_element_at(F.col("__told.own"), term), F.lit(0.0))
        gain = F.when(raw < 0, F.col("__told.mean") * EPSILON).otherwise(raw) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len")))
        return total + F.when(tf > 0, gain).otherwise(0.0)

    return rows.withColumn("keyword", F.aggregate(F.array(*map(F.lit, terms)), F.lit(0.0), part)).drop("__told", "__len")


def phrase_boost(query: str, text: str = "body") -> Column:
    """Factor of the quoted phrases that the text holds as whole words."""
    hay = F.concat(F.lit(" "), T.normalize(F.col(text)), F.lit(" "))
    hits = F.lit(0)
    for phrase in re.findall(r'"([^"]+)"', query):
        needle = " ".join(re.findall(r"\w+", phrase.lower()))
        if needle:
            hits = hits + F.contains(hay, F.lit(f" {needle} ")).cast("int")
    return F.lit(1.0) + F.lit(PHRASE_GAIN) * hits


def search(docs: DataFrame, query: str, top_k: int, text: str = "body", key: str = "note_id", stemmed: bool = True) -> DataFrame:
    """The ``top_k`` rows by keyword score, then key."""
    found = scored(tokenized(docs, text, stemmed), query_terms(query.replace('"', " "), stemmed))
    return found.withColumn("keyword", F.col("keyword") * phrase_boost(query, text)).orderBy(F.desc("keyword"), key).limit(top_k)


def _top_terms(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
            found, first, count = np.unique(row * (len(coded.dictionary) + 1) + code, return_index=True, return_counts=True)
            order = np.lexsort((first, -count, row[first]))
            owner = row[first][order]
            place = np.arange(len(order)) - np.searchsorted(owner, owner, "left") + 1
            keep = np.flatnonzero(place <= k)
            at = first[order][keep]
            term = coded.dictionary.take(pa.array(code[at]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner[keep])), pa.array(place[keep].astype(np.int32)), term.cast(pa.string()), pa.array(count[order][keep].astype(np.int32))], [batch.schema.names[0], "place", "term", "n"]
            )

    return run


def top_terms(tokens: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k most frequent tokens of each row, then by first place; counted batch by batch, without a shuffle."""
    return tokens.select(key, "tokens").mapInArrow(_top_terms(k), f"{key} {dict(tokens.dtypes)[key]}, place int, term string, n int")
