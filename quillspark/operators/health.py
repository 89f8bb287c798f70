"""Checks of a note collection; each gives one row per finding."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from . import links as L

#: Fields that every note must have; the longest body that counts as empty.
REQUIRED, EMPTY_CHARS = ("id", "created", "updated"), 20

#: Fields that hold times.
TIMES = ("created", "updated", "date")

#: Fixed value: a note named like another with a number after it.
COPY = "^(.*[^/]) \\d+\\.md$"

#: Columns of notes that the checks read.
NEEDED = ("path", "title", "aliases", "id", "body", "fields", "field_names", "frontmatter_text", "provenance", "source_url", "note_type", "recency")

CHECKS = (
    "missing_frontmatter_fields", "invalid_timestamps", "duplicate_ids", "duplicate_titles", "broken_wikilinks", "dangling_targets", "empty_notes", "conflict_copies",
    "imported_missing_source", "orphans", "stale_distilled",
)


def missing_fields(notes: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """path and the required fields that the note's frontmatter does not name (``field_names``); one without a value is named."""
    return notes.select("path", F.array_except(F.array(*map(F.lit, required)), "field_names").alias("missing")).filter(F.size("missing") > 0)


def invalid_timestamps(notes: DataFrame, policy: str = "offset", fields: tuple[str, ...] = TIMES) -> DataFrame:
    """path, field, value and problem of the named fields (of the JSON ``fields``) that are no good time; a field without a value is none."""
    names = F.filter(F.array(*map(F.lit, fields)), lambda k: F.array_contains("field_names", k))
    own = notes.select("path", F.explode(names).alias("field"), F.from_json("fields", "map<string,string>").alias("m"))
    rows = own.select("path", "field", F.coalesce(F.trim(F.col("m")[F.col("field")]), F.lit("")).alias("value"))
    return rows.withColumn("problem", T.timestamp_problem(F.col("value"), policy)).filter("problem IS NOT NULL")


def duplicate_ids(notes: DataFrame, key: str = "id") -> DataFrame:
    """key and the sorted paths of the notes that share it; a note without one shares nothing."""
    return notes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list("path")).alias("paths")).filter(F.size("paths") > 1)


def duplicate_titles(notes: DataFrame) -> DataFrame:
    """The first title in path order stands for all that differ in case only."""
    told = notes.groupBy(F.lower("title").alias("folded")).agg(F.min(F.struct(F.split("path", "/"), "title")).alias("first"), F.sort_array(F.collect_list("path")).alias("paths"))
    return told.filter(F.size("paths") > 1).select(F.col("first.title").alias("title"), "paths")


def empty_notes(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, characters and number of notes that link to it, most first."""
    inbound = edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("inbound"))
    bare = notes.select("path", F.length(T.strip(F.col("body"))).alias("chars")).filter(F.col("chars") <= EMPTY_CHARS)
    return bare.join(inbound, "path", "left").select("path", "chars", F.coalesce("inbound", F.lit(0)).alias("inbound")).orderBy(F.desc("inbound"), "path")


@F.pandas_udf(Y.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(difflib.SequenceMatcher(None, (x or "").strip(), (y or "").strip()).ratio(), 3) for x, y in zip(a, b, strict=True)])


def conflict_copies(notes: DataFrame) -> DataFrame:
    """path, base_path and similarity of notes named like another of their folder with a number after it.

    The base path is derived from the copy's, so this is an equality join and not a comparison
    of all pairs; only the ratio leaves the JVM.
    """
    base = F.concat(F.regexp_extract("path", COPY, 1), F.lit(".md"))
    copies = notes.filter(F.col("path").rlike(COPY)).select(F.col("path").alias("copy"), base.alias("path"), F.col("body").alias("copy_body"))
    pairs = copies.join(notes.select("path", "body"), "path")
    return pairs.select(F.col("copy").alias("path"), F.col("path").alias("base_path"), _ratio("body", "copy_body").alias("similarity")).orderBy(F.desc("similarity"), "path")


def imported_missing_source(notes: DataFrame) -> DataFrame:
    return notes.filter(F.col("provenance").isin("reference", "llm") & (F.coalesce(F.trim("source_url"), F.lit("")) == "")).select("path", "provenance")


def is_distilled() -> Column:
    """Whether a note is machine-written from others, by its type or its provenance."""
    return (F.coalesce("note_type", F.lit("")) == "distilled") | (F.coalesce("provenance", F.lit("")) == "distilled")


def orphans(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes that neither link nor are linked; distilled ones do not count."""
    return (
        notes.filter(~is_distilled()).select("path")
        .join(edges.select(F.col("src").alias("path")), "path", "left_anti").join(edges.select(F.col("dst").alias("path")), "path", "left_anti")
    )


def source_links(notes: DataFrame) -> DataFrame:
    """path and target of the links under the first heading ``Sources`` of any level, to the next heading."""
    lines = F.transform(L.visible_lines(F.col("body")), lambda x: x["text"])
    start = F.array_position(F.transform(lines, lambda x: x.rlike("(?i)^#{1,6}\\s+sources\\s*$")), True)
    rest = F.when(start > 0, F.slice(lines, (start + 1).cast("int"), F.size(lines)))
    heads = F.transform(rest, lambda x: x.rlike("^#{1,6}\\s"))
    end = F.coalesce(F.nullif(F.array_position(heads, True), F.lit(0)), F.size(rest) + 1) - 1
    text = F.array_join(F.slice(rest, F.lit(1), end.cast("int")), "\n")
    return notes.select("path", F.explode(F.regexp_extract_all(text, F.lit(L.LINK), F.lit(1))).alias("target")).select("path", F.trim("target").alias("target"))


def stale_distilled(notes: DataFrame) -> DataFrame:
    """path, kind (``stale`` or ``unresolvable``) and sources of distilled notes: those that are newer, or each link that is no note.

    An equality join on the resolved path with one inequality as its rest.
    """
    distilled = notes.filter(is_distilled())
    cited = L.resolve(source_links(distilled), notes).select("path", "target", "resolved")
    own = distilled.select("path", F.col("recency").alias("own"))
    newer = cited.join(own, "path").join(notes.select(F.col("path").alias("resolved"), "recency"), "resolved").filter("recency > own")
    stale = newer.groupBy("path").agg(F.sort_array(F.collect_set("resolved")).alias("sources")).select("path", F.lit("stale").alias("kind"), "sources")
    return stale.unionByName(cited.filter("resolved IS NULL").select("path", F.lit("unresolvable").alias("kind"), F.array("target").alias("sources")))


def all_checks(notes: DataFrame, attachments: DataFrame | None = None, policy: str = "offset") -> dict[str, DataFrame]:
    """Every check by name.  ``notes`` must have the columns of ``sources.notes.read_vault``."""
    if gone := [c for c in NEEDED if c not in notes.columns]:
        raise ValueError(f"notes lack {', '.join(gone)}")
    found = L.body_links(notes).unionByName(L.frontmatter_links(notes.filter("frontmatter_text IS NOT NULL")))
    resolved = L.resolve(found, notes, attachments)
    edge, broken = L.edges(resolved), L.unresolved(resolved)
    return {
        "missing_frontmatter_fields": missing_fields(notes), "invalid_timestamps": invalid_timestamps(notes, policy), "duplicate_ids": duplicate_ids(notes),
        "duplicate_titles": duplicate_titles(notes), "broken_wikilinks": broken, "dangling_targets": L.dangling(broken), "empty_notes": empty_notes(notes, edge),
        "conflict_copies": conflict_copies(notes), "imported_missing_source": imported_missing_source(notes), "orphans": orphans(notes, edge), "stale_distilled": stale_distilled(notes),
    }


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """check and number of findings, checks without any included."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def report(checks: dict[str, DataFrame], rows: int = 15) -> list[str]:
    """Text of the first rows of each check; a report is read by people, so it is short."""
    out = []
    for name, df in checks.items():
        got = df.limit(rows + 1).collect()
        out.append(f"{name}: {len(got) if len(got) <= rows else f'more than {rows}'}")
        out += ["  " + " | ".join(str(v) for v in r) for r in got[:rows]]
    return out


def fix_timestamps(notes: DataFrame, policy: str = "offset", fields: tuple[str, ...] = ("created", "updated"), zone: str = "+00:00") -> DataFrame:
    """path and frontmatter_text in which naive or offset times of the fields follow the policy."""
    text = F.col("frontmatter_text")
    for f in fields:
        if policy == "offset":
            text = F.regexp_replace(text, f"(?m)^({f}:\\s*['\"]?\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(?::\\d{{2}})?)(['\"]?\\s*)$", f"$1{zone}$2")
        else:
            text = F.regexp_replace(text, f"(?m)^({f}:\\s*['\"]?\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(?::\\d{{2}})?)(?:Z|[+-]\\d{{2}}:?\\d{{2}})(['\"]?\\s*)$", "$1$2")
    return notes.select("path", F.col("frontmatter_text").alias("before"), text.alias("after")).filter("before <> after")


def first_of_each(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """One note per id: the first in path order."""
    w = Window.partitionBy(key).orderBy(F.split("path", "/"))
    return notes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
