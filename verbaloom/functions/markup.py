"""Column expressions on Markdown: links, images, code spans, placeholders and tags as arrays, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbaloom.functions.text import BLANKS, text_or_empty

#: The patterns of the markup that translations must keep.
LINK = r"(?<!!)\[([^\]]+)\]\(([^)]+)\)"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
CODE = r"`([^`]+)`"
PLACEHOLDER = r"(\{\{[^}]+\}\}|\{[A-Za-z_][A-Za-z0-9_]*\}|%[sd]|:[A-Za-z_][A-Za-z0-9_]*|<[^>\s]+>)"
TAG = r"(</?[A-Z][A-Za-z0-9_.]*\b[^>]*>)"
PROP = r"""\b(title|label|description|alt|aria-label|placeholder)=["']([^"']+)["']"""
CHILD = r"(?s)<([A-Z][A-Za-z0-9_.]*)\b[^>]*>(.*?)</\1>"

def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(group))


def link_labels(c: Column) -> Column:
    return _all(c, LINK, 1)


def link_urls(c: Column) -> Column:
    return F.transform(_all(c, LINK, 2), lambda u: F.trim(u))


def image_labels(c: Column) -> Column:
    return _all(c, IMAGE, 1)


def image_urls(c: Column) -> Column:
    return F.transform(_all(c, IMAGE, 2), lambda u: F.trim(u))


def code_spans(c: Column) -> Column:
    return _all(c, CODE, 1)


def placeholders(c: Column) -> Column:
    """Sorted and distinct."""
    return F.array_sort(F.array_distinct(_all(c, PLACEHOLDER, 1)))


def tags(c: Column) -> Column:
    """Tags of components, whole and in order."""
    return _all(c, TAG, 1)


def props(c: Column) -> Column:
    """(prop, value) of the translatable attributes."""
    return F.arrays_zip(_all(c, PROP, 1).alias("prop"), _all(c, PROP, 2).alias("value"))


def children(c: Column) -> Column:
    """(component, text) of the components' content, tags removed; the empty ones keep their place."""
    inner = F.transform(_all(c, CHILD, 2), lambda x: F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), f"^{BLANKS}|{BLANKS}$", ""))
    return F.arrays_zip(_all(c, CHILD, 1).alias("component"), inner.alias("text"))


def asset_refs(c: Column) -> Column:
    """Local files that images point to: no scheme, no anchor, not empty."""
    return F.filter(image_urls(c), lambda u: (u != "") & ~u.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|#|//)"))
