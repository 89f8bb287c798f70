"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text, with white space deleted, is cut where its own content says so.  Each chunk gets an
identifier, and one aggregation over the distinct chunks proves that no identifier stands for
two contents.  A text is then its ordered list of identifiers (its recipe), and equal recipes
are equal texts.  Only distinct chunks and the short recipes are shuffled: a long document is
moved at most once, and copies of it are not moved at all beyond the task that reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import KEY, all_but_gone, keyed, stored

#: Characters deleted before comparison.
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"

#: Least and most characters of a chunk.
CHUNK_MIN, CHUNK_MAX = 1024, 4096

#: A chunk may end after two characters whose code points are these modulo 8.
BOUNDARY_RESIDUE, BOUNDARY_MODULUS = 5, 8


def chunk_pattern(least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> str:
    """Regular expression whose successive matches are the chunks of a text."""
    letters = "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x250) if c % BOUNDARY_MODULUS == BOUNDARY_RESIDUE)
    return f"(?s).{{{least}}}(?:.{{0,{most - least - 2}}}?[{letters}]{{2}}|.{{0,{most - least}}})|.+"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern()), F.lit(0))


def chunk_id(chunk: Column, salt: int) -> Column:
    """128-bit identifier of a chunk; ``identifiers_hold`` proves it unique on the data."""
    return F.unhex(F.md5(F.concat(F.lit(f"{salt}:"), chunk) if salt else chunk))


def identifiers_hold(docs: DataFrame, text: str, salt: int) -> bool:
    """Whether no identifier stands for two different chunks of the whole table."""
    one = docs.select(F.explode(chunks(normalised(F.col(text)))).alias("chunk"))
    distinct = one.groupBy(chunk_id(F.col("chunk"), salt).alias("id"), "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("id").agg(F.count("one").alias("n")).filter("n > 1").isEmpty()


def recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, recipe, code points of the original text, SHA-256.

    Identifiers are verified first; if two chunks ever share one, another salt is taken.
    """
    salt = 0
    while not identifiers_hold(docs, text, salt):
        salt += 1
    plain = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"),
        normalised(F.col(text)).alias("plain"),
    )
    return plain.select(
        "doc_id", "n_chars",
        F.transform(chunks(F.col("plain")), lambda c: chunk_id(c, salt)).alias("recipe"),
        F.sha2("plain", 256).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Group and survivor of every document.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.  Of equal texts the one with the
    most code points stays, then the smallest id.

    Null and empty texts are one group.  A null id counts as the largest.  Repeated rows of
    one id and text count as rows in ``group_size`` and share one verdict.  An empty table
    gives an empty result, and other columns of ``docs`` are not read, whatever their names.
    """
    listed, _ = stored(recipes(docs, id_col, text), "recipes")
    best = listed.groupBy("recipe").agg(
        F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    # Written, so that the join reads both sides through exchanges and Spark may split a hot recipe.
    best, _ = stored(best.select("recipe", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size"), "recipe-groups")
    return listed.join(best, "recipe").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows of each text the one that stays, with all its columns.

    It is the row with the most code points, then the smallest id, null last; verdicts are on
    rows, so what shares an id, or has none, stays unless its text is repeated.
    """
    gone = exact_groups(keyed(docs, id_col).select(KEY, F.col(text).alias("text")), KEY).filter(~F.col("kept")).select(F.col("doc_id").alias(KEY))
    return all_but_gone(docs, gone, id_col, "exact-gone")
