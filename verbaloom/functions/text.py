"""Column expressions on text: one form of blanks, identity hashes, slugs, escapes, front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the blanks that are collapsed (those of Python's str.split).
BLANKS = r"[\s\x0B\x1C-\x1F\x85   -     　]+"
#: Fixed value: where front matter begins and ends.
FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|$)"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalised(c: Column) -> Column:
    """Runs of blanks become one, outer blanks go. Null stays null."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def source_key(c: Column) -> Column:
    return F.sha2(normalised(text_or_empty(c)), 256)


def fingerprint(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), source_key(c))


def segment_id(path: Column, kind: Column, index: Column, text: Column) -> Column:
    """Twelve hex digits that depend on the path, the kind, its running number in the document and the text."""
    return F.substring(F.sha2(F.concat(path, F.lit("::"), kind, F.lit("["), index.cast("string"), F.lit("]::"), normalised(text_or_empty(text))), 256), 1, 12)


def slug(c: Column) -> Column:
    """Lower case, words of letters and digits (Unicode) joined by hyphens; ``section`` if nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(text_or_empty(c))), r"(?U)[^\p{L}\p{N}_\s\x1C-\x1F-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s\x1C-\x1F_]+", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.trim(s, F.lit("-")), F.lit("")), F.lit("section"))


def po_escape(c: Column) -> Column:
    s = F.replace(text_or_empty(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(s, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def po_unescape(c: Column) -> Column:
    """The exact inverse of ``po_escape``: a doubled backslash is set aside first."""
    s = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    s = F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(s, F.lit("\x00"), F.lit("\\"))


def html_escape(c: Column) -> Column:
    s = F.replace(text_or_empty(c), F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)`{3}.*?`{3}", "")


def front_matter(c: Column) -> Column:
    """What stands between the opening and the closing ``---``; empty if there is none."""
    return F.regexp_extract(text_or_empty(c), FRONT, 1)


def front_block(c: Column) -> Column:
    """The front matter with its opening and closing rule, as it stands; empty if there is none. Line ends are unified."""
    return F.regexp_extract(unix_lines(text_or_empty(c)), FRONT, 0)


def body(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), FRONT, "")


def front_value(c: Column, key: str) -> Column:
    """The last value of ``key`` in the front matter, without outer blanks and quotes; null if it isn't there."""
    lines = F.filter(F.split(front_matter(c), "\n"), lambda x: x.rlike(rf"^\s*{key}\s*:"))
    value = F.regexp_replace(F.try_element_at(lines, F.lit(-1)), rf"^\s*{key}\s*:", "")
    return F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")


def page_title(text: Column, path: Column) -> Column:
    """Front-matter title, else the first heading of level one, else the stem of the path."""
    heading = F.nullif(F.trim(F.regexp_extract(text_or_empty(text), r"(?md)^#\s+(.+)$", 1)), F.lit(""))
    return F.coalesce(F.nullif(front_value(text, "title"), F.lit("")), heading, stem(path))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def output_path(path: Column, extension: str, lang: Column | None = None, default: str = "de", root: str = "docs/") -> Column:
    """Path below ``root`` with another extension; a suffix for languages other than the default."""
    rel = F.regexp_replace(path, f"^{root}", "")
    base = F.regexp_replace(rel, r"\.[^./]*$", "")
    suffix = F.lit("") if lang is None else F.when(lang == default, "").otherwise(F.concat(F.lit("."), lang))
    return F.concat(base, suffix, F.lit(f".{extension}"))
