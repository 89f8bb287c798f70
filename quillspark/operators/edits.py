"""Changes to a note's text as pure functions, and an Arrow UDF over a table of edits."""

from __future__ import annotations

import difflib
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Y


class EditError(ValueError):
    """An edit that cannot be made as it is told."""


def parse_edits(raw: str) -> list[dict]:
    """A non-empty list of {old_text, new_text, occurrence?}; anything else is an error."""
    try:
        found = json.loads(raw)
    except ValueError as e:
        raise EditError("edits are no JSON") from e
    if not isinstance(found, list) or not found:
        raise EditError("edits must be a list with an element")
    for e in found:
        if not isinstance(e, dict) or set(e) - {"old_text", "new_text", "occurrence"} or not isinstance(e.get("old_text"), str) or not e["old_text"] or not isinstance(e.get("new_text"), str):
            raise EditError("an edit has other fields or types")
        if "occurrence" in e and (isinstance(e["occurrence"], bool) or not isinstance(e["occurrence"], int) or e["occurrence"] < 1):
            raise EditError("an occurrence must be 1 or more")
    return found


def locate(body: str, edit: dict) -> tuple[int, int]:
    """Where the edit's old text is; an error for none, or for several without a number."""
    at = [m.start() for m in re.finditer(re.escape(edit["old_text"]), body)]
    k = edit.get("occurrence")
    if not at or (k or 1) > len(at):
        raise EditError("not found")
    if k is None and len(at) > 1:
        raise EditError("ambiguous")
    return at[(k or 1) - 1], at[(k or 1) - 1] + len(edit["old_text"])


def apply(body: str, edits: list[dict]) -> str:
    """All edits together, each judged on the body as given."""
    spans = sorted((*locate(body, e), e["new_text"]) for e in edits)
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise EditError("overlap")
    for s, e, new in reversed(spans):
        body = body[:s] + new + body[e:]
    return body


def edit_note(body: str, raw_edits: str, expected_sha256: str | None = None) -> tuple[str, str]:
    """The new body and a unified diff; the digest, if given, must be that of the body."""
    if expected_sha256 and hashlib.sha256(body.encode()).hexdigest() != expected_sha256:
        raise EditError("the note has changed")
    after = apply(body, parse_edits(raw_edits))
    return after, diff(body, after)


def diff(before: str, after: str) -> str:
    out = []
    for line in difflib.unified_diff(before.splitlines(True), after.splitlines(True), "before", "after"):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


@F.pandas_udf(Y.StructType().add("body", Y.StringType()).add("error", Y.StringType()))
def edited(body: pd.Series, edits: pd.Series) -> pd.DataFrame:
    """Each body after its edits, or why they cannot be made."""
    rows = []
    for b, e in zip(body, edits, strict=True):
        try:
            rows.append((apply(b or "", parse_edits(e or "")), None))
        except EditError as x:
            rows.append((None, str(x)))
    return pd.DataFrame(rows, columns=["body", "error"])


def split_note(raw: str) -> tuple[str | None, str]:
    """Frontmatter text (null without a fence) and the rest."""
    lines = raw.split("\n")
    if lines[0].rstrip() == "---":
        for k in range(1, len(lines)):
            if lines[k].strip() == "---":
                return "\n".join(lines[1:k]), "\n".join(lines[k + 1 :])
    return None, raw


def set_field(raw: str, field: str, value: str) -> str:
    """The note with one frontmatter field set, added, or in a block of its own."""
    head, rest = split_note(raw)
    if head is None:
        return f"---\n{field}: {value}\n---\n{raw}"
    line = re.compile(rf"(?m)^{re.escape(field)}:.*$")
    new = line.sub(lambda _: f"{field}: {value}", head, count=1) if line.search(head) else "\n".join(x for x in (head, f"{field}: {value}") if x)
    return f"---\n{new}\n---\n{rest}"


def merge_fields(have: dict, patch: dict, fixed: tuple[str, ...] = ("id", "created")) -> dict | None:
    """Fields after a patch, null if it changes nothing; aliases are joined."""
    out = dict(have)
    for key, value in patch.items():
        if key in fixed and have.get(key) not in (None, value):
            raise EditError(f"{key} cannot be changed")
        if value in (None, "", []):
            raise EditError(f"{key} is empty")
        if key == "aliases":
            value = list(dict.fromkeys([*(have.get("aliases") or []), *([value] if isinstance(value, str) else value)]))
        out[key] = value
    return None if out == have else out


_HIDDEN = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|!?\[\[[^\]]*\]\]|!?\[[^\]]*\]\([^)]*\)", re.S)


def add_link(body: str, anchor: str, target: str, line: int | None = None) -> str:
    """The body with the first free place of the anchor as a link; the given line is tried first.

    Code and existing links are left alone, and a note that links to the target stays as it is.
    """
    if re.search(rf"\[\[{re.escape(target)}(?:[#|][^\]]*)?\]\]", body):
        return body
    hidden = [m.span() for m in _HIDDEN.finditer(body)]
    places = [m.start() for m in re.finditer(re.escape(anchor), body) if anchor and not any(s < m.end() and m.start() < e for s, e in hidden)]
    if not places:
        raise EditError("not found")
    at = next((p for p in places if line and body.count("\n", 0, p) + 1 == line), places[0])
    link = f"[[{target}]]" if anchor == target else f"[[{target}|{anchor}]]"
    return body[:at] + link + body[at + len(anchor) :]


def insert_related(body: str, targets: list[str], heading: str = "Related") -> str:
    """The body with links listed under the heading, which is made if missing; none twice."""
    lines = body.rstrip("\n").split("\n")
    top = next((k for k, x in enumerate(lines) if re.fullmatch(rf"##\s+{re.escape(heading)}\s*", x, re.I)), None)
    end = len(lines) if top is None else next((k for k in range(top + 1, len(lines)) if re.match(r"#{1,2}\s", lines[k])), len(lines))
    have = {t.lower() for x in (lines[top:end] if top is not None else []) for t in re.findall(r"\[\[([^\]|#]+)", x)}
    new = [f"- [[{t}]]" for t in {t.lower(): t for t in reversed(targets)}.values() if t.lower() not in have][::-1]
    if not new:
        return body
    if top is None:
        return body.rstrip("\n") + f"\n\n## {heading}\n\n" + "\n".join(new) + "\n"
    while end > top + 1 and not lines[end - 1].strip():
        end -= 1
    return "\n".join(lines[:end] + new + lines[end:]) + "\n"
