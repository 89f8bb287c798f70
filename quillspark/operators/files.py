"""Notes as files of one folder: reading, making, changing and moving one note, and results as JSON.

These work on one file at a time for a person or an agent; whole collections are read by
``sources.notes``.  A path is always relative to the folder and never leads out of it.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

import yaml

from .edits import edit_note as _edited
from .edits import merge_fields, set_field, split_note

#: Fields that stay as they are once they are set.
KEPT = ("id", "created", "provenance")


class NoteError(ValueError):
    """A note that cannot be read or changed as it is told."""


def inside(root: str, path: str) -> Path:
    """The file of a note; an error for a path that is no clean relative one, or leads out of the folder."""
    parts = path.split("/")
    if not path.lower().endswith(".md") or "\x00" in path or "\\" in path or any(p in ("", ".", "..") for p in parts):
        raise NoteError(f"no path of a note: {path!r}")
    base = Path(root).resolve()
    full = base.joinpath(*parts)
    if not full.resolve().is_relative_to(base):
        raise NoteError(f"outside the folder: {path!r}")
    return full


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parse_note(raw: str) -> tuple[dict, str]:
    """Fields and body; a block that is no mapping gives no fields and stays in the body."""
    head, rest = split_note(raw)
    try:
        found = yaml.safe_load(head) if head is not None else None
    except (yaml.YAMLError, ValueError):
        return {}, raw
    return (found, rest.lstrip("\n")) if isinstance(found, dict) else ({}, raw if head is None or found is not None else rest.lstrip("\n"))


def render_note(fields: dict, body: str) -> str:
    """The text of a note with these fields, in their order; without fields the body alone."""
    if not fields:
        return body
    return f"---\n{yaml.safe_dump(fields, sort_keys=False, allow_unicode=True)}---\n\n{body}"


def read_note(root: str, path: str) -> tuple[dict, str, str]:
    """Fields, body and digest of a note; an error where there is none that can be read."""
    try:
        raw = inside(root, path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise NoteError(f"no such note: {path}") from e
    return *parse_note(raw), digest(raw)


def _written(full: Path, text: str) -> None:
    """The whole text or nothing: written beside the file and put in its place."""
    handle, beside = tempfile.mkstemp(dir=full.parent, prefix=f".{full.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(beside, full)
    except BaseException:
        Path(beside).unlink(missing_ok=True)
        raise


def create_note(root: str, path: str, body: str, fields: dict | None = None, now: datetime.datetime | None = None, ident: str | None = None) -> str:
    """Make a note that is not there yet, with an id and its times, and give its digest."""
    full = inside(root, path)
    full.parent.mkdir(parents=True, exist_ok=True)
    stamp = (now or datetime.datetime.now(datetime.UTC)).isoformat(timespec="seconds")
    text = render_note(({"id": ident} if ident else {}) | {"created": stamp, "updated": stamp} | (fields or {}), body)
    try:
        with open(full, "x", encoding="utf-8", newline="") as f:
            f.write(text)
    except FileExistsError as e:
        raise NoteError(f"already there: {path}") from e
    return digest(text)


def replace_note(root: str, path: str, text: str, expected: str) -> str:
    """Write a note anew if its digest is still the expected one."""
    full = inside(root, path)
    raw = full.read_text(encoding="utf-8") if full.is_file() else None
    if raw is None or digest(raw) != expected:
        raise NoteError(f"changed or gone: {path}")
    _written(full, text)
    return digest(text)


def edit_note(root: str, path: str, edits: str, expected: str | None = None, now: datetime.datetime | None = None, dry: bool = False) -> str:
    """Make text edits in a note's body, set ``updated``, and give the difference; with ``dry`` nothing is written."""
    full = inside(root, path)
    if not full.is_file():
        raise NoteError(f"no such note: {path}")
    raw = full.read_text(encoding="utf-8")
    if expected and digest(raw) != expected:
        raise NoteError(f"changed: {path}")
    head, body = split_note(raw)
    after, told = _edited(body, edits)
    if not dry:
        text = after if head is None else f"---\n{head}\n---\n{after}" if head else f"---\n---\n{after}"
        _written(full, set_field(text, "updated", (now or datetime.datetime.now(datetime.UTC)).isoformat(timespec="seconds")) if head is not None else text)
    return told


def merge_frontmatter(root: str, path: str, patch: dict) -> dict:
    """Add fields to a note; what is set of ``KEPT`` stays, other names are added to those it has.  Gives the fields it has then."""
    fields, body, before = read_note(root, path)
    allowed = {k: v for k, v in patch.items() if not (k in KEPT and fields.get(k))}
    after = merge_fields(fields, allowed)
    if after is None:
        return fields
    replace_note(root, path, render_note(after, body), before)
    return after


def move_note(root: str, old: str, new: str) -> None:
    """Give a note another path that is free; its text stays."""
    source, target = inside(root, old), inside(root, new)
    if not source.is_file():
        raise NoteError(f"no such note: {old}")
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        os.link(source, target)  # fails where something is
    except FileExistsError as e:
        raise NoteError(f"already there: {new}") from e
    source.unlink()


def envelope(command: str, result: object = None, error: tuple[str, str] | None = None, warnings: Iterable[str] = ()) -> str:
    """One line of JSON with sorted keys: what a command gave, or why it failed."""
    told = {"command": command, "ok": error is None, "warnings": list(warnings)}
    told |= {"error": {"type": error[0], "message": error[1]}} if error else {"result": result}
    return json.dumps(told, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def write_results(path: str, results: object) -> None:
    """Results as readable JSON with sorted keys; a reader sees the whole file or the one before."""
    full = Path(path)
    full.parent.mkdir(parents=True, exist_ok=True)
    _written(full, json.dumps(results, sort_keys=True, ensure_ascii=False, indent=2) + "\n")
