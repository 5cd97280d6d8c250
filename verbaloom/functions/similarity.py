"""Similarity of texts and vectors.

``ratio`` is the matching-blocks ratio of Python's difflib with its heuristics for long texts, which is
asymmetric and has no counterpart among Spark's expressions, so it runs in an Arrow UDF over the pairs that
native bounds leave. Everything else is native.
"""

from __future__ import annotations

import difflib
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType

from verbaloom.functions.text import normalised, text_or_empty

DIM = 96
#: Shares of the parts in the lexical and in the hybrid score.
RATIO_SHARE, JACCARD_SHARE, SEMANTIC_SHARE, LEXICAL_SHARE = 0.72, 0.28, 0.78, 0.22


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two normalised texts. Null counts as empty; two empty texts are alike."""
    out = []
    match, last = difflib.SequenceMatcher(None), None
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        if y != last:  # the second text is indexed, so runs of the same one are cheap
            match.set_seq2(y)
            last = y
        match.set_seq1(x)
        out.append(match.ratio())
    return pd.Series(out, dtype="float64")


def tokens(c: Column) -> Column:
    """The different words of the normalised text, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(normalised(text_or_empty(c))), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repetitions; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def lexical(ratio_: Column, jaccard_: Column) -> Column:
    return F.round(ratio_ * RATIO_SHARE + jaccard_ * JACCARD_SHARE, 4)


def hybrid(lexical_: Column, semantic: Column) -> Column:
    return F.greatest(lexical_, semantic * SEMANTIC_SHARE + lexical_ * LEXICAL_SHARE)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def usable(column: str, dim: int) -> Column:
    """Whether a vector has ``dim`` values, all finite, not all zero; false for null."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, cut to 0 to 1; null if one is null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def shortest_for_ratio(least: float) -> float:
    """The least quotient of the shorter and the longer length with which a ratio can reach ``least``."""
    return max(0.0, least / (2 - least))


def shortest_for_lexical(least: float) -> float:
    """The same for the lexical score, of which the Jaccard part can be 1 at most."""
    return shortest_for_ratio(max(0.0, (least - 5e-5 - JACCARD_SHARE) / RATIO_SHARE))


def _place(gram: str, dim: int) -> tuple[int, float]:
    h = hashlib.blake2b(gram.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "little") % dim, 1.0 if h[4] & 1 else -1.0


@lru_cache(maxsize=1 << 15)
def _word_vector(word: str, dim: int) -> np.ndarray:
    """What a word with its 3- to 5-grams adds."""
    pad, v = f"_{word}_", np.zeros(dim)
    for g in [word, *(pad[i : i + n] for n in (3, 4, 5) for i in range(len(pad) - n + 1))]:
        at, sign = _place(g, dim)
        v[at] += sign
    return v


def hashed_vector(text: str | None, dim: int = DIM) -> list[float]:
    """Unit vector of hashed words, word pairs and 3- to 5-grams of the padded words."""
    words = " ".join((text or "").split()).lower().split(" ")
    words = [w for w in words if w]
    v = np.zeros(dim)
    for w in words:  # sums of whole numbers: their order doesn't matter
        v += _word_vector(w, dim)
    for a, b in zip(words, words[1:], strict=False):
        at, sign = _place(f"{a} {b}", dim)
        v[at] += sign
    norm = float(np.linalg.norm(v))
    return (v / norm if norm else v).tolist()


@F.pandas_udf(ArrayType(FloatType()))
def hashed_vectors(text: pd.Series) -> pd.Series:
    """One vector for each different text of the batch."""
    codes, values = pd.factorize(text)
    made = [hashed_vector(v) for v in values]
    empty = hashed_vector("")
    return pd.Series([made[c] if c >= 0 else empty for c in codes])


@F.pandas_udf(BinaryType())
def packed(vector: pd.Series) -> pd.Series:
    """Vectors as 32-bit floats, little-endian, one after the other; null stays null."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def unpacked(packed: pd.Series) -> pd.Series:
    """The inverse; null and empty give null, odd bytes at the end are left out."""
    return packed.map(lambda b: np.frombuffer(b[: len(b) // 4 * 4], "<f4") if b else None)
