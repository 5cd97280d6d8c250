"""Problem 5: one consistent form for text that looks the same but differs in its characters.

Per distinct value: characters ignored by default are removed, blanks and hyphens mapped to one each, the
compatibility composition (NFKC) is formed, letters of other scripts with the shape of a Latin letter are
mapped to it, and, for the comparison key, case is folded in full. ``display_form`` leaves the case; two
texts look the same if their display forms are equal.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of another script with the shape of a Latin letter.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοαινρτυϲ", "ABEZHIKMNOPTYXCjoaivptuc", strict=True))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝҮՕӏүԌ", "ABESIJKMHOPCTYXaesijopcyxhdqwYOlyG", strict=True))
ARMENIAN = dict(zip("օոսցհՍՏ", "onugհUS".replace("հ", "h"), strict=True))
#: Latin letters and signs that are drawn like another one.
LATIN = {"ı": "i", "ȷ": "j", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "∕": "/", "⁄": "/", "∶": ":", "ꞌ": "'"}
#: Kinds of hyphen.
HYPHENS = "‐‑‒⁃−﹣－˗֊᠆"
#: Characters that are their own display form.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ„“”‘’–—«»]*\Z")
BLANK = regex.compile(r"[\p{White_Space}᠎]+")
IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]+")


@lru_cache(1)
def shapes() -> dict[int, str]:
    return {ord(k): v for d in (GREEK, CYRILLIC, ARMENIAN, LATIN) for k, v in d.items()} | {ord(h): "-" for h in HYPHENS}


def display_form(text: str | None) -> str | None:
    """The one form of all texts that look like this one; case stays."""
    if text is None:
        return None
    if PLAIN.match(text):
        return " ".join(text.split())
    text = unicodedata.normalize("NFKC", IGNORABLE.sub("", text).translate(shapes()))
    text = unicodedata.normalize("NFC", IGNORABLE.sub("", text).translate(shapes()))
    return BLANK.sub(" ", text).strip()


def comparison_key(text: str | None) -> str | None:
    """``display_form`` with full case folding, composed again."""
    form = display_form(text)
    return None if form is None else unicodedata.normalize("NFC", form.casefold())


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("key", T.StringType())]))
def _forms(text: pd.Series) -> pd.DataFrame:
    codes, values = pd.factorize(text)
    forms = [display_form(v) for v in values]
    keys = [None if f is None else unicodedata.normalize("NFC", f.casefold()) for f in forms]
    pick = lambda own: [own[c] if c >= 0 else None for c in codes]
    return pd.DataFrame({"form": pick(forms), "key": pick(keys)})


def canonical(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, key) of every row; null stays null, text without anything visible becomes empty."""
    return df.select(F.col(id_col).alias("id"), _forms(F.col(text_col)).alias("f")).select("id", "f.form", "f.key")


def look_alikes(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """(left_id, right_id): rows whose texts look the same but are not the same string.

    Each side is reduced to its different texts first, so a text that many rows repeat is normalised and
    compared once. The comparison key joins; the display form, which keeps case and ß, decides. Nulls and
    texts without anything visible match nothing. Rows delivered twice count once.
    """

    def side(df: DataFrame, i: str, t: str, name: str) -> tuple[DataFrame, DataFrame]:
        rows = df.select(F.col(i).cast("long").alias(f"{name}_id"), F.col(t).alias("text")).filter(f"{name}_id is not null and text is not null").distinct()
        texts = rows.select("text").distinct().select("text", _forms("text").alias("f")).select(F.col("text").alias(f"{name}_text"), "f.form", "f.key").filter("form <> ''")
        return rows.withColumnRenamed("text", f"{name}_text"), texts

    a, at = side(left, left_id, left_text, "left")
    b, bt = side(right, right_id, right_text, "right")
    same = at.join(bt.withColumnRenamed("form", "other"), "key").filter("form = other and left_text <> right_text").select("left_text", "right_text")
    return same.join(a, "left_text").join(b, "right_text").select("left_id", "right_id").distinct()


