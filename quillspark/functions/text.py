"""Text functions on columns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscore of any script.
WORD = "[\\p{L}\\p{N}_]+"

#: Words that lexical search leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
)

#: The blocks whose characters each count as a token.
CJK = "[\\u2e80-\\u2eff\\u3000-\\u303f\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]"

#: Digits of numbers in base 62.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

EXCERPT_CHARS = 700


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def normalize(text: Column) -> Column:
    """Lower-cased words joined by single spaces."""
    return F.array_join(words(text), " ")


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words without stop words."""
    return F.filter(words(text), lambda w: ~w.isin(*stop))


def estimate_tokens(text: Column) -> Column:
    """Words and signs count one each; a word with CJK characters counts each of those."""
    units = F.regexp_extract_all(text, F.lit(f"{WORD}|[^\\p{{L}}\\p{{N}}_\\s]"), F.lit(0))
    cjk = lambda u: F.regexp_count(u, F.lit(CJK))
    return F.aggregate(units, F.lit(0), lambda n, u: n + F.greatest(cjk(u), F.lit(1)))


def hash62(text: Column) -> Column:
    """Low 64 bits of the MD5, in base 62.

    Long division by 62 on two 32-bit halves, so that no step leaves a long.
    """
    half = lambda at: F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")
    start = F.struct(half(17).alias("hi"), half(25).alias("lo"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        low = (acc["hi"] % 62) * F.lit(1 << 32) + acc["lo"]
        digit = F.substring(F.lit(DIGITS), (low % 62 + 1).cast("int"), F.lit(1))
        return F.struct(F.floor(acc["hi"] / 62).cast("long").alias("hi"), _div(low, 62).alias("lo"), F.concat(digit, acc["out"]).alias("out"))

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(11)), start, step, lambda acc: acc["out"])
    return F.regexp_replace(whole, "^0+(?=.)", "")


def _div(a: Column, b: int) -> Column:
    return ((a - a % b) / b).cast("long")


def is_ulid(text: Column) -> Column:
    """Whether a text is a ULID: 26 signs of Crockford's base 32."""
    return F.coalesce(text.rlike("^[0-9A-HJKMNP-TV-Z]{26}$"), F.lit(False))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def slugify(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, 80 characters at most."""
    dashed = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.trim(F.substring(dashed, 1, 80), F.lit("-"))


def heading_slug(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_\\s-]", ""))
    slug = F.regexp_replace(plain, "\\s+", "-")
    return F.when(slug == "", "section").otherwise(slug)


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def short_date(text: Column) -> Column:
    """``3 Jan 2024``, or the first ten characters of what is no date."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "d MMM yyyy"), F.substring(text, 1, 10))


def valid_path(path: Column) -> Column:
    """Whether a path stays inside its collection: relative, no NUL, backslash, empty or dot part."""
    parts = F.split(path, "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return path.isNotNull() & (path != "") & ~path.contains("\u0000") & ~path.contains("\\") & ~path.startswith("/") & ~odd


def deep_link(scheme: str, vault: Column, path: Column) -> Column:
    """Link that opens a note: percent-encoded, the note's suffix dropped, slashes kept."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.url_encode(c), "\\+", "%20"), "%7E", "~")
    target = F.regexp_replace(path, "\\.md$", "")
    return F.concat(F.lit(f"{scheme}://open?vault="), quoted(vault), F.lit("&file="), F.regexp_replace(quoted(target), "%2F", "/"))


def skipped_path(path: Column, skip: tuple[str, ...] = ()) -> Column:
    """Whether a folder of the path is in ``skip`` or begins with a dot."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(".") | p.isin(*skip) if skip else p.startswith("."))


def has_ignore_tag(body: Column, tags: tuple[str, ...] = ("ignore",)) -> Column:
    """Whether the body holds one of the tags as a word of its own, in any case."""
    listed = "|".join(f"\\Q{t}\\E" for t in tags)
    return body.rlike(f"(?i)(?<!\\S)#(?:{listed})(?![\\w/-])")


def split_tags(raw: Column) -> Column:
    """Tags of a string: by commas if it has any, else by white space; blanks dropped."""
    parts = F.when(raw.contains(","), F.split(raw, ",")).otherwise(F.split(raw, "\\s+"))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def derive_title(body: Column, otherwise: Column) -> Column:
    """First heading with a text, else the first line with a text (100 characters), else ``otherwise``."""
    lines = F.split(body, "\n")
    heads = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, "^#{1,6}\\s+(.*)$", 1))), lambda x: x != "")
    plain = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(heads, F.lit(1)), F.substring(F.try_element_at(plain, F.lit(1)), 1, 100), otherwise)


#: What an entry's header looks like at the start of its text: the title, then lines of a name and a value.
HEADER = "\\A#[^\\n]*\\n\\n(?:(?:Path|Tags|Date|Section|Note summary): [^\\n]*\\n\\n)+"


def clean_excerpt(text: Column) -> Column:
    """An excerpt without the header that an entry's text begins with."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), HEADER, ""))


def clean_preview(text: Column, title: Column | None = None) -> Column:
    """An excerpt as plain prose: no header, marks of headings, links, code, callouts, quotes, lists or emphasis.

    A title that it begins with is shown elsewhere and taken off.
    """
    out = clean_excerpt(text)
    for pattern, to in (
        ("(?m)^#{1,6}\\s+", ""), ("!?\\[\\[[^\\]|]*\\|([^\\]]+)\\]\\]", "$1"), ("!?\\[\\[([^\\]|#]+)[^\\]]*\\]\\]", "$1"), ("!?\\[\\[#([^\\]|]*)[^\\]]*\\]\\]", "$1"), ("!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
        ("`{1,3}", ""), ("(?m)^\\s*>\\s?\\[![\\w-]+\\][+-]?\\s*", ""), ("(?m)^\\s*>\\s?", ""), ("(?m)^\\s*[-*+]\\s+(?:\\[[ xX]\\]\\s+)?", ""), ("\\*\\*|__|==|~~", ""), ("\\s*\\n\\s*", " "), ("\\s{2,}", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    out = strip(out)
    if title is None:
        return out
    rest = F.regexp_replace(F.substr(out, F.length(title) + 1), "^[ .:\u2013\u2014-]+", "")
    return F.when((F.coalesce(title, F.lit("")) != "") & F.startswith(F.lower(out), F.lower(title)), rest).otherwise(out)


def heading_at(body: Column, line: Column) -> Column:
    """The last heading at or before a line (from 1) of a body; empty without one."""
    heads = F.filter(F.slice(F.split(body, "\n"), F.lit(1), F.greatest(line.cast("int"), F.lit(0))), lambda x: x.rlike("^#{1,6}\\s+"))
    return F.coalesce(F.trim(F.regexp_extract(F.try_element_at(heads, F.lit(-1)), "^#{1,6}\\s+(.*)$", 1)), F.lit(""))


def timestamp_problem(raw: Column, policy: str) -> Column:
    """Null for a good time; else unparseable, naive or offset_aware, by the policy.

    ``offset`` wants an offset, ``local`` wants none.
    """
    offset = raw.rlike("(?:Z|[+-]\\d{2}:?\\d{2})$") & raw.contains(":")
    bad = F.try_to_timestamp(raw).isNull()
    wrong = F.when(~offset, "naive") if policy == "offset" else F.when(offset, "offset_aware")
    return F.when(raw.isNull(), F.lit(None)).when(bad, "unparseable").otherwise(wrong)


def format_time(ts: Column, policy: str) -> Column:
    """A time as text: ``utc_z``, ``offset`` or ``local``, in the session's zone."""
    pattern = {"utc_z": "yyyy-MM-dd'T'HH:mm:ss'Z'", "offset": "yyyy-MM-dd'T'HH:mm:ssXXX", "local": "yyyy-MM-dd'T'HH:mm:ss"}[policy]
    return F.date_format(ts, pattern)


def summary_fingerprint(version: int, title: Column, body: Column) -> Column:
    return sha256(F.concat_ws("\u001f", F.lit(str(version)), title, body))


def normalize_summary(text: Column, most: int = 1200) -> Column:
    """White space collapsed; null where that is empty or too long."""
    plain = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when((plain != "") & (F.length(plain) <= most), plain)
