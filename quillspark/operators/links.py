"""Wikilinks: finding them, resolving their targets, and the graph they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A plain link's target, inline code, and the four parts of a link.
LINK = "\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]"
CODE = "`[^`]*`"
PARTS = "(!)?\\[\\[([^\\]|#]*)(?:#([^\\]|]*))?(?:\\|([^\\]]*))?\\]\\]"
TOKEN = "!?\\[\\[[^\\]|#]*(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]"


def visible_lines(body: Column) -> Column:
    """Lines of a body outside fences as structs (line, text), inline code taken out.

    Cut at the fence lines, pieces of a body are in turn outside and inside a fence, so the
    state of a line follows from its piece, at a cost that is linear in the lines.
    """
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text"), F.trim(x).startswith("```").alias("fence")))
    last = F.size(lines) + 1
    fences = F.concat(F.array(F.lit(0)), F.transform(F.filter(lines, lambda x: x["fence"]), lambda x: x["line"]))
    # From each second fence (the first is before the text) to the next one, lines are outside.
    pieces = F.filter(F.transform(fences, lambda at, i: F.struct(i.alias("i"), (at + 1).alias("first"), F.coalesce(F.get(fences, i + 1), last).alias("end"))), lambda p: p["i"] % 2 == 0)
    shown = F.flatten(F.transform(pieces, lambda p: F.slice(lines, p["first"], p["end"] - p["first"])))
    return F.transform(shown, lambda x: F.struct(x["line"].alias("line"), F.regexp_replace(x["text"], CODE, "").alias("text")))


def body_links(notes: DataFrame, key: str = "path") -> DataFrame:
    """key, line and target of every link outside code."""
    rows = notes.select(key, F.explode(visible_lines(F.col("body"))).alias("l")).filter(F.contains("l.text", F.lit("[[")))
    return rows.select(key, F.col("l.line").alias("line"), F.explode(F.regexp_extract_all("l.text", F.lit(LINK), F.lit(1))).alias("target")).select(
        key, F.lit("body").alias("location"), "line", F.trim("target").alias("target")
    )


def frontmatter_links(notes: DataFrame, key: str = "path") -> DataFrame:
    """key, line (of the file, from 2) and target of every link in the frontmatter."""
    rows = notes.select(key, F.posexplode(F.split("frontmatter_text", "\n")).alias("pos", "text"))
    return rows.select(key, (F.col("pos") + 2).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("target")).select(
        key, F.lit("frontmatter").alias("location"), "line", F.trim("target").alias("target")
    )


def link_parts(text: Column) -> Column:
    """All links of a text as structs: embed, target, heading, alias and what is shown."""
    part = lambda raw, k: F.regexp_extract(raw, PARTS, k)
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.transform(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        lambda raw: F.struct(
            (part(raw, 1) == "!").alias("embed"), F.trim(part(raw, 2)).alias("target"), some(part(raw, 3)).alias("heading"), some(part(raw, 4)).alias("alias"),
            F.coalesce(some(part(raw, 4)), some(part(raw, 2)), some(part(raw, 3)), F.lit("")).alias("shown"),
        ),
    )


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def target_keys(notes: DataFrame) -> DataFrame:
    """key and path: what a target may be called, best name first, first note in path order winning."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.md$", "")
    names = F.array(
        F.struct(F.lit(1).alias("rank"), _key(F.col("title")).alias("key")), F.struct(F.lit(2).alias("rank"), _key(stem).alias("key")),
        F.struct(F.lit(3).alias("rank"), _key(F.col("path")).alias("key")), F.struct(F.lit(3).alias("rank"), _key(F.regexp_replace("path", "\\.md$", "")).alias("key")),
    )
    called = F.transform("aliases", lambda a: F.struct(F.lit(4).alias("rank"), _key(a).alias("key")))
    rows = notes.select("path", F.explode(F.concat(names, called)).alias("n")).filter("n.key <> ''")
    best = F.min(F.struct(F.col("n.rank").alias("rank"), F.split("path", "/").alias("order"), F.col("path").alias("path")))
    return rows.groupBy(F.col("n.key").alias("key")).agg(best.alias("b")).select("key", "b.path")


def attachment_keys(attachments: DataFrame) -> DataFrame:
    base = F.element_at(F.split("path", "/"), -1)
    names = F.array_distinct(F.array(_key(F.col("path")), _key(base), _key(F.regexp_replace(base, "\\.md$", ""))))
    return attachments.select(F.explode(names).alias("key")).distinct()


def resolve(links: DataFrame, notes: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """``links`` with ``resolved`` (path of the note or null) and ``attachment``.

    Many links may name one target: the left side of the join is the skewed one, which Spark
    splits; names are unique on the right.
    """
    keys = target_keys(notes).withColumnRenamed("path", "resolved")
    found = links.withColumn("key", _key(F.col("target"))).join(keys, "key", "left")
    if attachments is None:
        return found.withColumn("attachment", F.lit(False)).drop("key")
    files = attachment_keys(attachments).withColumn("__file", F.lit(True))
    return found.join(files, "key", "left").withColumn("attachment", F.col("resolved").isNull() & F.coalesce("__file", F.lit(False))).drop("key", "__file")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct links between different notes."""
    return resolved.filter("resolved IS NOT NULL AND resolved <> path").select(F.col("path").alias("src"), F.col("resolved").alias("dst")).distinct()


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.filter("resolved IS NULL AND NOT attachment").select("path", "location", "line", "target")


def backlinks(edge: DataFrame) -> DataFrame:
    return edge.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("linked_from"), F.count_distinct("src").alias("n"))


def dangling(broken: DataFrame) -> DataFrame:
    """target, links and sources of the unresolved targets, most linked first."""
    told = broken.groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.sort_array(F.collect_set("path")).alias("sources"))
    return told.orderBy(F.desc("links"), F.lower("target"), "target")
