"""Filling in missing frontmatter: where each value comes from, and what must be looked at by hand.

Notes have ``path``, ``raw`` (the whole text), ``fields`` (the frontmatter as JSON) and
``field_names``, as ``sources.notes.scan_vault`` makes them; times of commits and of the file
come as columns, as only the machine that holds the files can tell them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fields that older tools kept an id in, the best first.
LEGACY = ("uid", "ulid", "luid")

#: Fields that must be times.
TIMES = ("created", "updated", "date")

#: The signs of Crockford's base 32.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _field(name: str) -> Column:
    """A field's value, trimmed; empty where it has none, null where the note does not name it."""
    value = F.coalesce(F.trim(F.get_json_object("fields", f"$.{name}")), F.lit(""))
    return F.when(F.array_contains("field_names", name), value)


def provenance(notes: DataFrame) -> DataFrame:
    """path, provenance and whether it is filled in: by the type, the kind of source, the source's address, else human."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    kind = low("source_type") if "source_type" in notes.columns else F.lit("")
    rule = (
        F.when(low("note_type") == "distilled", "distilled").when(kind == "llm", "llm").when((F.trim(F.coalesce("source_url", F.lit(""))) != "") | kind.isin("web", "pdf"), "reference").otherwise("human")
    )
    own = low("provenance")
    return notes.select("path", F.when(own != "", own).otherwise(rule).alias("provenance"), (own == "").alias("filled"))


def ulid(millis: Column, digits: Column) -> Column:
    """A ULID from a time in milliseconds and 20 hexadecimal digits."""
    sign = lambda n, at: F.substring(F.lit(BASE32), F.shiftright(n, at).bitwiseAND(31).cast("int") + 1, F.lit(1))
    time = [sign(millis.cast("long"), at) for at in range(45, -1, -5)]
    rest = [sign(F.conv(F.substring(digits, k * 5 + 1, 5), 16, 10).cast("long"), at) for k in range(4) for at in (15, 10, 5, 0)]
    return F.concat(*time, *rest)


def _with_counts(notes: DataFrame) -> DataFrame:
    """Adds how many notes share the id.  A note's id is the skewed side, so Spark may split it."""
    rows = notes.withColumn("__id", _field("id"))
    many = rows.filter("__id IS NOT NULL").groupBy("__id").agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(many, "__id", "left")


def ambiguity() -> Column:
    """First reason why a note is left to a person; null if none."""
    own = _field("id")
    legacy = F.filter(F.array(*(F.nullif(_field(c), F.lit("")) for c in LEGACY)), lambda x: x.isNotNull())
    fenced = F.col("raw").rlike("(?s)^---\\n(?:.*\\n)?[ \\t]*---[ \\t]*(?:\\n|$)")
    out = (
        F.when(fenced & (F.size("field_names") == 0), "frontmatter present but failed to parse")
        .when(own.isNotNull() & F.exists(legacy, lambda x: x != own), "id and legacy identifier disagree")
        .when(F.size(F.array_distinct(legacy)) > 1, "multiple legacy identifiers disagree")
    )
    for c in TIMES:
        out = out.when(_field(c).isNotNull() & F.try_to_timestamp(_field(c)).isNull(), f"{c} value does not parse")
    return out.when(F.col("__n") > 1, "duplicate id shared across notes")


def manual(notes: DataFrame) -> DataFrame:
    """path and reason of the notes that are left to a person."""
    return _with_counts(notes).select("path", ambiguity().alias("reason")).filter("reason IS NOT NULL")


def resolution(notes: DataFrame, commits: str = "medium", policy: str = "offset", now: Column | None = None) -> DataFrame:
    """path, field, value, source, confidence and warnings of each value that is filled in.

    ``notes`` also have first_commit, last_commit, birth and mtime, all times or null.
    ``commits``: how sure a commit's time is; ``high`` for a long history.  An update before
    the creation is set to it.  Notes with an ambiguity are left out; see ``manual``.
    """
    stamp = lambda c: T.format_time(F.col(c) if isinstance(c, str) else c, policy)
    none = F.array().cast("array<string>")

    def way(value: Column, source: str, sure: str, warnings: Column = none) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"), warnings.alias("warnings")))

    old = F.coalesce(*(F.nullif(_field(c), F.lit("")) for c in LEGACY))
    odd = F.when(T.is_ulid(old), none).otherwise(F.array(F.lit("legacy id is not a ULID")))
    seed = F.substring(F.md5(F.concat(F.uuid(), "path")), 1, 20)
    ident = F.coalesce(way(old, "legacy_field", "high", odd), way(ulid(F.unix_millis(F.coalesce(now, F.current_timestamp()) if now is not None else F.current_timestamp()), seed), "generated", "high"))
    dated = stamp(F.try_to_timestamp(_field("date")))
    created = F.coalesce(way(dated, "legacy_field", "high"), way(stamp("first_commit"), "git_first_commit", commits), way(stamp("birth"), "birthtime", "medium"), way(stamp("mtime"), "mtime", "low"))
    updated = F.coalesce(way(stamp("last_commit"), "git_last_commit", commits), way(stamp("mtime"), "mtime", "medium"))
    start = F.coalesce(F.try_to_timestamp(_field("created")), F.try_to_timestamp(created["value"]))
    early = F.try_to_timestamp(updated["value"]) < start
    clamped = F.struct(stamp(start).alias("value"), updated["source"].alias("source"), updated["confidence"].alias("confidence"), F.array(F.lit("updated predated created; clamped to created")).alias("warnings"))
    made = (("id", ident), ("created", created), ("updated", F.when(early, clamped).otherwise(updated)))
    filled = F.array(*(F.when(_field(k).isNull() & v.isNotNull(), F.struct(F.lit(k).alias("field"), v.alias("v"))) for k, v in made))
    rows = _with_counts(notes).filter(ambiguity().isNull()).select("path", F.explode(F.array_compact(filled)).alias("f"))
    return rows.select("path", "f.field", "f.v.value", "f.v.source", "f.v.confidence", "f.v.warnings")


def report(changes: DataFrame) -> DataFrame:
    """Changes by field and source."""
    return changes.groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"))


def lines_to_add(changes: DataFrame) -> DataFrame:
    """path and ``added``, the frontmatter lines of its changes in the order id, created, updated."""
    place = F.array_position(F.array(F.lit("id"), F.lit("created"), F.lit("updated")), F.col("field"))
    line = F.struct(place.alias("place"), F.concat("field", F.lit(": "), "value").alias("line"))
    return changes.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("added"))


def apply_changes(raw: Column, added: Column) -> Column:
    """The text with the added lines before the closing fence, or in a block of its own in front."""
    fenced = raw.rlike("(?s)^---\\n(?:.*?\\n)?[ \\t]*---[ \\t]*(?:\\n|$)")
    inside = F.regexp_replace(raw, "(?s)^(---\\n(?:.*?\\n)??)([ \\t]*---[ \\t]*(?:\\n|$))", F.concat(F.lit("$1"), F.regexp_replace(added, "([\\\\$])", "\\\\$1"), F.lit("\n$2")))
    return F.when(F.coalesce(added, F.lit("")) == "", raw).when(fenced, inside).otherwise(F.concat(F.lit("---\n"), added, F.lit("\n---\n"), raw))


def filled_in(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """path, raw and the new text of every note that gets a value."""
    return notes.join(lines_to_add(changes), "path").select("path", "raw", apply_changes(F.col("raw"), F.col("added")).alias("text"))
