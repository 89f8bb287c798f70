"""Cutting notes into sections.

``line_windows`` cuts at headings and packs lines in native functions.  ``sections`` reads
Markdown blocks, keeps them whole where they fit and balances section sizes; it runs as an
Arrow UDF that gives an array for each note.  A body is tokenized once: the tokens of any
stretch of it follow from two binary searches, so the cost of a note is linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: Tokens: the least a section should have, the most it is filled to, the most it may have, and the overlap of cut prose.
LEAST, MOST, HARD, OVERLAP = 300, 600, 900, 50

_TOKEN = re.compile(r"\w+|[^\w\s]")
_CJK = re.compile("[\u2e80-\u2eff\u3000-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_SENTENCE_END = re.compile(r"[.!?](?=\s|$)\s*")

# The lines that begin a block.
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}>")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|)$")
_DASHES = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


class Tokens:
    """Token counts of stretches of one text."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [s for s, _ in found], [e for _, e in found]
        self.cjk = _CJK.search(text) is not None
        weight = ((len(_CJK.findall(text, s, e)) or 1) for s, e in found) if self.cjk else (1 for _ in found)
        self.total = [0, *accumulate(weight)]

    def _part(self, a: int, b: int) -> int:
        return (len(_CJK.findall(self.text, a, b)) or 1) if self.cjk else 1

    def count(self, a: int, b: int) -> int:
        """Tokens of ``text[a:b]``; a word that is cut counts by the part that is inside."""
        i, j = bisect_left(self.starts, a), bisect_left(self.starts, b)
        n = self.total[j] - self.total[i]
        if i and self.ends[i - 1] > a:
            n += self._part(a, min(b, self.ends[i - 1]))
        if self.cjk and j > i and self.ends[j - 1] > b:
            n += self._part(self.starts[j - 1], b) - (self.total[j] - self.total[j - 1])
        return n

    def prefix(self, a: int, b: int, budget: int) -> int:
        """Where the longest prefix of ``text[a:b]`` within the budget ends, cut back to a blank in its second half."""
        low, high = a + 1, b
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.count(a, middle) <= budget else (low, middle - 1)
        blank = max(self.text.rfind(" ", a, low), self.text.rfind("\t", a, low)) - a
        return a + blank + 1 if blank >= max(1, (low - a) // 2) else low


def token_count(text: str) -> int:
    return Tokens(text).total[-1]


def within(text: str, budget: int) -> str:
    """The longest prefix of a text within a number of tokens."""
    own = Tokens(text)
    return text if own.total[-1] <= budget else text[: own.prefix(0, len(text), budget)]


@dataclass(frozen=True)
class Block:
    """Lines ``start`` to ``end - 1`` of a body, under a heading path; ``a`` to ``b`` in characters."""

    start: int
    end: int
    kind: str
    a: int
    b: int
    heading: str
    level: int
    path: tuple[str, ...]
    parent: int
    piece: bool = False


def _indent(line: str) -> int:
    wide = line.expandtabs(4)
    return len(wide) - len(wide.lstrip(" "))


def _begins(line: str) -> str:
    """The kind of block that a line begins, whatever stands before it; text if none."""
    if _indent(line) > 3:
        return "code"
    if _ATX.match(line):
        return "heading"
    if _FENCE.match(line):
        return "fence"
    if _RULE.match(line):
        return "rule"
    if _QUOTE.match(line):
        return "quote"
    return "list" if _ITEM.match(line) else "text"


def _interrupts(line: str) -> bool:
    """Whether a line ends a paragraph: a list does only with a text, and if ordered from 1."""
    kind = _begins(line)
    if kind == "list":
        item = _ITEM.match(line)
        return bool((item[4] or "").strip()) and (not item[2][:-1].isdigit() or int(item[2][:-1]) == 1)
    return kind in ("heading", "fence", "rule", "quote")


def _cells(line: str) -> int:
    return len(re.sub(r"^\||\|$", "", re.sub(r"\\\\.", "", line.strip())).split("|"))


def _table_at(lines: list[str], at: int) -> bool:
    """Whether a table begins: a line with as many cells as the line of dashes below it."""
    return at + 1 < len(lines) and "|" in lines[at] + lines[at + 1] and bool(_DASHES.match(lines[at + 1])) and _cells(lines[at]) == _cells(lines[at + 1])


def _list_end(lines: list[str], at: int) -> tuple[int, list[int]]:
    """Where a list ends and where its top items begin.  Blank lines after an item belong to it."""
    first = _ITEM.match(lines[at])
    mark = first[2][-1]
    items, inner, blank, fence = [], 0, False, ""
    end = at
    while end < len(lines):
        line = lines[end]
        if not line.strip():
            blank, end = True, end + 1
            continue
        indent = _indent(line)
        if fence:
            if indent >= inner and line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
            elif indent < inner:
                break
        elif items and indent >= inner:
            opened = _FENCE.match(line.strip())
            fence = (opened[1] or opened[2]) if opened else ""
        else:
            item = _ITEM.match(line)
            if item and item[2][-1] == mark and not _RULE.match(line):
                items.append(end)
                rest = len((item[3] or " ").expandtabs(4))
                inner = len(item[1]) + len(item[2]) + (rest if 1 <= rest <= 4 and (item[4] or "").strip() else 1)
            elif blank or _interrupts(line):  # else the line goes on with the item's paragraph
                break
        blank, end = False, end + 1
    return end, items


def _ends(lines: list[str], at: int) -> tuple[str, int]:
    """Kind and end of the block that begins at a line with a text."""
    kind, end = _begins(lines[at]), at + 1
    if kind == "fence":
        found = _FENCE.match(lines[at])
        mark = found[1] or found[2]
        while end < len(lines) and not (_indent(lines[end]) < 4 and lines[end].strip().startswith(mark) and not lines[end].strip().strip(mark[0])):
            end += 1
        return kind, min(end + 1, len(lines))
    if kind == "code":
        while end < len(lines) and (not lines[end].strip() or _indent(lines[end]) > 3):
            end += 1
        while not lines[end - 1].strip():
            end -= 1
        return kind, end
    if kind == "quote":
        lazy = not lines[at].lstrip()[1:].strip() == ""
        while end < len(lines) and lines[end].strip() and (_QUOTE.match(lines[end]) or (lazy and not _interrupts(lines[end]))):
            lazy = bool(lines[end].lstrip(" >").strip())
            end += 1
        return kind, end
    if kind == "list":
        return kind, _list_end(lines, at)[0]
    if kind == "text":
        if _table_at(lines, at):
            end += 1
            while end < len(lines) and lines[end].strip() and not _interrupts(lines[end]) and _indent(lines[end]) < 4:
                end += 1
            return "table", end
        while end < len(lines) and lines[end].strip():
            if _UNDER.match(lines[end]):
                return "heading", end + 1
            if _interrupts(lines[end]) or _table_at(lines, end):
                break
            end += 1
    return kind, end


def scan(lines: list[str]) -> list[Block]:
    """Top-level blocks in order: headings of both forms, fences, indented code, rules, quotes, lists, tables and paragraphs.

    The last block holds the blank lines at the end of the body.
    """
    offs = [0, *accumulate(len(x) + 1 for x in lines)]
    offs[-1] -= 1
    stack: dict[int, str] = {}
    parent, level, heading = 0, 0, ""
    out: list[Block] = []
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        kind, end = _ends(lines, at)
        if kind == "heading":
            found = _ATX.match(lines[at]) if end == at + 1 else None
            if found:
                depth, name = len(found[1]), (found[2] or "").strip()
            else:
                depth, name = 1 if "=" in lines[end - 1] else 2, "\n".join(x.strip() for x in lines[at : end - 1])
            stack = {k: v for k, v in stack.items() if k < depth} | {depth: name}
            if depth <= 3:
                parent, level, heading = parent + 1, depth, name
        path = tuple(v for _, v in sorted(stack.items()) if v)
        out.append(Block(at, end, kind, offs[at], max(offs[at], offs[end] - (end < len(lines))), heading, level, path, parent))
        at = end
    if out and out[-1].end < len(lines):
        out[-1] = replace(out[-1], end=len(lines), b=offs[-1])
    return out


def _hard(own: Tokens, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A stretch cut wherever the budget ends."""
    while a < b:
        end = b if own.count(a, b) <= HARD else own.prefix(a, b, HARD)
        yield a, end
        a = end


def _sentences(own: Tokens, a: int, b: int) -> list[tuple[int, int]]:
    """Prose cut between sentences; up to ``OVERLAP`` tokens of the last sentences begin the next piece."""
    cuts = [a, *(m.end() for m in _SENTENCE_END.finditer(own.text, a, b) if m.end() < b), b]
    units = [u for s, e in pairwise(cuts) if e > s for u in ([(s, e)] if own.count(s, e) <= HARD else _hard(own, s, e))]
    out, first = [], 0
    for k, (_, e) in enumerate(units):
        if k > first and own.count(units[first][0], e) > HARD:
            last = units[k - 1][1]
            out.append((units[first][0], last))
            first = k
            while first and own.count(units[first - 1][0], last) <= OVERLAP and units[first - 1][0] > out[-1][0]:
                first -= 1
    return out + [(units[first][0], units[-1][1])] if units else out


def _packed(own: Tokens, units: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring units joined while they fit."""
    out: list[tuple[int, int]] = []
    now: tuple[int, int] | None = None
    for s, e in units:
        if own.count(s, e) > HARD:
            out += [now] * (now is not None)
            out += _hard(own, s, e)
            now = None
        elif now and own.count(now[0], e) > HARD:
            out.append(now)
            now = s, e
        else:
            now = (now[0] if now else s), e
    return out + [now] * (now is not None)


def split_block(own: Tokens, lines: list[str], offs: list[int], block: Block) -> list[Block]:
    """The block, or its pieces: sentences of prose, items of a list, rows of a table, or lines."""
    if own.count(block.a, block.b) <= HARD:
        return [block]
    if block.kind == "text":
        spans = _sentences(own, block.a, block.b)
    else:
        tops = list(range(block.start, block.end))
        if block.kind == "list":
            tops = _list_end(lines[: block.end], block.start)[1]
        elif block.kind == "table":
            tops = [block.start, *range(block.start + 2, block.end)]  # the line of dashes stays with the head
        bounds = [min(offs[t], block.b) for t in tops] + [block.b]
        spans = _packed(own, [(s, e) for s, e in pairwise(bounds) if e > s])
    out = []
    for s, e in spans:
        first = block.start + own.text.count("\n", block.a, s)
        last = block.start + own.text.count("\n", block.a, e) + (own.text[e - 1 : e] != "\n")
        out.append(replace(block, start=first, end=max(first + 1, min(block.end, last)), a=s, b=e, piece=True))
    return out


def cut(note_id: str, body: str) -> list[dict]:
    """Sections of one body; every line with a text is in at least one, and a blank body has none.

    Blocks of one heading are grouped while they fit; a group that is too small joins the one
    before it.  A group of whole blocks is the lines from its first to its last.
    """
    lines = body.split("\n")
    own = Tokens(body)
    offs = [0, *accumulate(len(x) + 1 for x in lines)]
    groups: list[tuple[list[Block], int]] = []
    for whole in scan(lines):
        for b in split_block(own, lines, offs, whole):
            n = own.count(b.a, b.b)
            last, size = groups[-1] if groups else ([], 0)
            if last and (last[-1].parent, last[-1].path) == (b.parent, b.path) and size + n <= MOST:
                last.append(b)
                groups[-1] = last, size + n
            else:
                groups.append(([b], n))
    merged: list[tuple[list[Block], int]] = []
    for g, n in groups:
        last, size = merged[-1] if merged else ([], 0)
        if last and n < LEAST and (last[-1].parent, last[-1].path) == (g[0].parent, g[0].path) and size + n <= HARD:
            merged[-1] = last + g, size + n
        else:
            merged.append((g, n))
    out = []
    for g, _ in merged:
        apart = len(g) > 1 and all(x.end <= y.start for x, y in pairwise(g))
        if apart or not any(b.piece for b in g):
            text = "\n".join(lines[g[0].start : g[-1].end])
        else:
            text = "\n".join(body[b.a : b.b].rstrip("\n") for b in g).strip()
        if text.strip():
            out.append({
                "chunk_id": f"{note_id}::s{len(out):03d}", "heading": g[0].heading, "level": g[0].level, "line_start": g[0].start + 1, "line_end": g[-1].end, "text": text,
                "heading_path": list(g[0].path), "parent": g[0].parent, "token_count": token_count(text),
            })
    return out


SECTION = Y.StructType()
for _name, _kind in (
    ("chunk_id", Y.StringType()), ("heading", Y.StringType()), ("level", Y.IntegerType()), ("line_start", Y.IntegerType()), ("line_end", Y.IntegerType()),
    ("text", Y.StringType()), ("heading_path", Y.ArrayType(Y.StringType())), ("parent", Y.IntegerType()), ("token_count", Y.IntegerType()),
):
    SECTION = SECTION.add(_name, _kind)


@F.pandas_udf(Y.ArrayType(SECTION))
def _cut(note_id: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([cut(i, b or "") for i, b in zip(note_id, body, strict=True)])


def sections(notes: DataFrame, key: str = "note_id", body: str = "body") -> DataFrame:
    """``notes`` with one row per section, in ``s``."""
    return notes.withColumn("s", F.explode(_cut(F.col(key).cast("string"), F.col(body))))


def outline(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """Headings outside fences in order: key, line, level, text and the slug that a link to it names.

    A slug that comes again in a note is numbered.
    """
    from ..functions.text import heading_slug
    from .links import visible_lines

    rows = notes.select(key, F.explode(visible_lines(F.col("body"))).alias("l")).filter(F.col("l.text").rlike("^#{1,6}\\s+"))
    rows = rows.select(key, F.col("l.line").alias("line"), F.length(F.regexp_extract("l.text", "^(#{1,6})", 1)).alias("level"), F.trim(F.regexp_extract("l.text", "^#{1,6}\\s+(.*)$", 1)).alias("text"))
    rows = rows.withColumn("slug", heading_slug(F.col("text")))
    again = F.row_number().over(Window.partitionBy(key, "slug").orderBy("line"))
    return rows.withColumn("__again", again).withColumn("slug", F.when(F.col("__again") > 1, F.concat("slug", F.lit("-"), (F.col("__again") - 1).cast("string"))).otherwise(F.col("slug"))).drop("__again")


def line_windows(docs: DataFrame, key: str = "doc_id", body: str = "body", max_chars: int = 1000) -> DataFrame:
    """Lines of each heading's part packed into windows of about ``max_chars`` characters.

    Fences and headings are running counts over the lines of one note; a window is the part
    of the running length that a line begins in.  Columns: key, part, win, first_line,
    last_line, chars.
    """
    lines = docs.select(key, F.posexplode(F.split(body, "\n")).alias("line", "text"))
    running = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.trim(F.col("text")).startswith("```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(running))
    head = ~fence & (F.col("fences") % 2 == 0) & F.col("text").rlike("^#{1,3}\\s+")
    lines = lines.withColumn("part", F.sum(head.cast("int")).over(running))
    inside = Window.partitionBy(key, "part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.sum(F.length("text") + 1).over(inside) - F.length("text") - 1
    return (
        lines.withColumn("win", F.floor(begun / max_chars)).groupBy(key, "part", "win")
        .agg((F.min("line") + 1).alias("first_line"), (F.max("line") + 1).alias("last_line"), F.sum(F.length("text") + 1).alias("chars"))
    )
