"""Predicates on notes.  They hold after a top-k has been taken, as the retrieval plan does."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def in_folder(folder: str) -> Column:
    """The folder itself or anything below it."""
    return (F.col("folder") == folder) | F.col("folder").startswith(folder.rstrip("/") + "/")


def has_tags(tags: Iterable[str]) -> Column:
    """Every given tag, in any case."""
    want = F.array(*(F.lit(t.lower()) for t in tags))
    return F.size(F.array_except(want, F.transform("tags", lambda t: F.lower(t)))) == 0


def of_type(note_type: str) -> Column:
    return F.lower("note_type") == note_type.lower()


def of_provenance(provenance: str) -> Column:
    return F.lower("provenance") == provenance.lower()


def between(since: str | None = None, until: str | None = None, when: str = "updated") -> Column:
    """Inclusive; a note without a time is left out."""
    kept = F.col(when).isNotNull()
    if since:
        kept &= F.col(when) >= F.lit(since).cast("timestamp_ntz")
    if until:
        kept &= F.col(when) <= F.lit(until).cast("timestamp_ntz")
    return kept


def must_include(terms: Iterable[str], text: str = "body") -> Column:
    """Every term is a whole word or phrase of the normalised text; empty terms do not count."""
    hay = F.concat(F.lit(" "), T.normalize(F.col(text)), F.lit(" "))
    kept = F.lit(True)
    for term in terms:
        needle = T.normalize(F.lit(term))
        kept &= (needle == "") | F.contains(hay, F.concat(F.lit(" "), needle, F.lit(" ")))
    return kept


def scope(folder: str | None = None, tags: Iterable[str] = (), note_type: str | None = None, provenance: str | None = None, since: str | None = None,
          until: str | None = None, include: Iterable[str] = ()) -> Column:
    """All given predicates together."""
    parts = [F.lit(True)]
    if folder:
        parts.append(in_folder(folder))
    if list(tags):
        parts.append(has_tags(tags))
    if note_type:
        parts.append(of_type(note_type))
    if provenance:
        parts.append(of_provenance(provenance))
    if since or until:
        parts.append(between(since, until))
    if list(include):
        parts.append(must_include(include))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
