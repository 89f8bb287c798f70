"""Frontmatter: cutting it off in the JVM, reading its YAML in an Arrow UDF."""

from __future__ import annotations

import datetime
import json

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: A fence line, the block, and the closing line.
FENCE = "(?s)^---\\n(.*?)(?:(?<=\\n)|^)[ \\t]*---[ \\t]*(?:\\n|$)(.*)$"


def block(raw: Column) -> Column:
    """The YAML between the fences, or the empty text."""
    return F.regexp_extract(raw, FENCE, 1)


def body(raw: Column, fields: Column | None = None) -> Column:
    """What follows the fences, without leading line ends; the whole text if there are none.

    With ``fields``, the JSON of the block, a block that is no YAML stays where it is.
    """
    fenced = raw.rlike(FENCE) if fields is None else raw.rlike(FENCE) & fields.isNotNull()
    return F.when(fenced, F.regexp_replace(F.regexp_extract(raw, FENCE, 2), "^\\n+", "")).otherwise(raw)


def _plain(value: object) -> object:
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    return value


def parse(text: str | None) -> str | None:
    """A YAML mapping as JSON; {} for YAML that is none, null for what is no YAML."""
    try:
        found = yaml.safe_load(text or "")
    except (yaml.YAMLError, ValueError):
        return None
    return json.dumps(_plain(found), ensure_ascii=False, default=str) if isinstance(found, dict) else "{}"


@F.pandas_udf(Y.StringType())
def as_json(blocks: pd.Series) -> pd.Series:
    return blocks.map(parse)


def tags_of(fields: Column) -> Column:
    """Tags of the JSON mapping: a list, or a string cut by commas or white space."""
    from .text import split_tags

    listed = F.from_json(F.get_json_object(fields, "$.tags"), "array<string>")
    raw = F.get_json_object(fields, "$.tags")
    trimmed = F.filter(F.transform(listed, lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(F.when(raw.startswith("["), trimmed), split_tags(raw), F.array().cast("array<string>"))


def aliases_of(fields: Column) -> Column:
    raw = F.get_json_object(fields, "$.aliases")
    return F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))


def when_field(fields: Column, *names: str) -> Column:
    """First of the named fields that has a value."""
    return F.coalesce(*(F.get_json_object(fields, f"$.{n}") for n in names))


def first_time(fields: Column, *names: str) -> Column:
    """The first of the named fields that is a time; a time without an offset is in the session's zone."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(F.get_json_object(fields, f"$.{n}"))) for n in names))


def keys_of(fields: Column) -> Column:
    """Names of all fields, those without a value too."""
    return F.coalesce(F.json_object_keys(fields), F.array().cast("array<string>"))
