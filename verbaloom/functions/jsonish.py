"""JSON as models write it: fences, trailing commas, prose around it, several shapes of a list of translations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that may hold a translation, and those that may hold the list.
FIELDS = ("target", "translation", "translated", "text", "value", "msgstr")
LISTS = ("translations", "items", "results", "data", "targets")


def _unfenced(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.regexp_replace(s, r"(?is)\A```(?:json)?\s*(.*?)\s*`*\z", "$1")


def _without_commas(c: Column) -> Column:
    """Quoted strings are matched first and stay as they are."""
    return F.regexp_replace(c, r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")|,\s*(?=[\]}])', "$1")


def repaired(c: Column) -> Column:
    """Without a code fence and without commas before a closing bracket, save in strings. Null counts as empty."""
    return _without_commas(_unfenced(c))


def widest(c: Column) -> Column:
    """From the first opening to the last closing bracket; empty if there is none."""
    return _without_commas(F.regexp_extract(_unfenced(c), r"(?s)([\[{].*[\]}])", 1))


def valid(c: Column) -> Column:
    """Whether a string is JSON."""
    return F.try_parse_json(c).isNotNull()


def parseable(c: Column) -> Column:
    """The repaired text if it is JSON, else its widest bracketed part if that is; else null."""
    whole, part = repaired(c), widest(c)
    return F.when((whole != "") & valid(whole), whole).when((part != "") & valid(part), part)


def _value(x: object) -> str:
    if not isinstance(x, dict):
        return "" if x is None else str(x)
    return next((str(x[k]) for k in FIELDS if x.get(k)), "")


def coerce(payload: object, ids: list[str]) -> list[str] | None:
    """One translation for each id, whatever the shape; None if their number doesn't fit."""
    if isinstance(payload, dict):
        inner = next((payload[k] for k in LISTS if isinstance(payload.get(k), list)), None)
        if inner is not None:
            return coerce(inner, ids)
        return [_value(payload.get(i, "")) for i in ids]
    if not isinstance(payload, list):
        return [] if not ids else None
    named = {str(x["id"]): _value(x) for x in payload if isinstance(x, dict) and x.get("id") is not None}
    out = [named[i] for i in ids] if named and all(i in named for i in ids) else [_value(x) for x in payload]
    return out if len(out) == len(ids) else None


def translations(replies: DataFrame, batch: str, ids: str, reply: str) -> DataFrame:
    """(batch, id, target, ok): the translations in each reply; ok is false, the target null, where the number doesn't fit.

    ids is an array of strings in the order asked for.
    """
    ready = replies.select(F.col(batch).cast("string").alias("batch"), F.col(ids).alias("ids"), parseable(F.col(reply)).alias("json"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for b, wanted, text in zip(pdf.batch, pdf.ids, pdf.json, strict=True):
                wanted = [] if wanted is None else list(wanted)
                got = coerce(json.loads(text), wanted) if isinstance(text, str) else None
                rows += [(b, i, None if got is None else got[k], got is not None) for k, i in enumerate(wanted)]
            yield pd.DataFrame(rows, columns=["batch", "id", "target", "ok"])

    return ready.mapInPandas(read, "batch string, id string, target string, ok boolean")


