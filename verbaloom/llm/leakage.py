"""Problem 7: passages of held-out items in documents, by a broadcast hash set of the items' n-grams.

The items' words are numbered and their n-grams hashed; both are broadcast, and their size is checked
against ``most`` n-grams first (items are a small, fixed table; beyond that they are taken in several
rounds over the documents). Documents are scanned window by window, in full length: only runs of at least
``n`` words that all occur in some item are hashed, and every hit is verified word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
ODD = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def placed_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text in lower case and where each stands in it, also where lower case is longer than the text."""
    low = text.lower()
    if len(low) == len(text):
        found = [(m.group(), m.span()) for m in WORD.finditer(low)]
    else:
        size = [len(c.lower()) for c in text]
        if sum(size) != len(low):  # a sign whose lower case depends on its neighbours keeps its length
            low = "".join(c.lower() for c in text)
        owner = [i for i, n in enumerate(size) for _ in range(n)]
        found = [(m.group(), (owner[m.start()], owner[m.end() - 1] + 1)) for m in WORD.finditer(low)]
    return [w for w, _ in found], [s for _, s in found]


class Passages:
    """The n-grams of the items: by rolling hash, the items and places where each begins."""

    def __init__(self, items: list[tuple[int, str | None]], n: int):
        self.n, self.number, self.grams, self.items = n, {}, defaultdict(list), {}
        self.powers = np.array([pow(ODD, n - 1 - k, 1 << 64) for k in range(n)], np.uint64)
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int64)
            self.items[item] = ids
            for at, h in enumerate(self.hashes(ids).tolist()):
                self.grams[h].append((item, at))
        self.known = np.array(sorted(self.grams), np.uint64)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < self.n:
            return np.zeros(0, np.uint64)
        spread = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(31)
        return (np.lib.stride_tricks.sliding_window_view(spread, self.n) * self.powers).sum(axis=1, dtype=np.uint64)

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.int64)

    def hits(self, words: list[str]) -> set[tuple[int, int]]:
        """(item, place of the passage's first word among the text's words) for every verified n-gram."""
        ids = self.numbers(words)
        if len(ids) < self.n:
            return set()
        known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
        turns = np.diff(known)
        out = set()
        for lo, hi in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), strict=True):
            if hi - lo < self.n:
                continue
            run = ids[lo:hi]
            h = self.hashes(run)
            at = np.searchsorted(self.known, h).clip(max=max(0, len(self.known) - 1))
            for k in np.flatnonzero(self.known[at] == h) if len(self.known) else ():
                out |= {(item, int(lo + k)) for item, start in self.grams[int(h[k])] if np.array_equal(self.items[item][start : start + self.n], run[k : k + self.n])}
        return out


def _rounds(items: DataFrame, item_col: str, text_col: str, n: int, most: int) -> list[Passages]:
    rows = [(r.item, r.text) for r in items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null").distinct().toLocalIterator()]
    made, part, size = [], [], 0
    for row in rows:
        k = max(0, len(words_of(row[1])) - n + 1)
        if part and size + k > most:
            made.append(Passages(part, n))
            part, size = [], 0
        part.append(row)
        size += k
    return [*made, Passages(part, n)]


def leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, n: int = 12, most: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, passages): documents that share at least ``n`` consecutive words with an item.

    passages counts the different places at which a shared n-gram begins. Null, empty and shorter texts
    share nothing; a document or item delivered twice counts once; empty tables give no rows.
    """
    sc = documents.sparkSession.sparkContext
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    out = None
    for passages in _rounds(items, item_col, item_text, n, most):
        shared = sc.broadcast((dict(passages.grams), passages.items, passages.number, passages.known, n))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = _restore(*shared.value)
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                    by: dict[int, int] = defaultdict(int)
                    for item, _ in own.hits(words_of(text)):
                        by[item] += 1
                    rows += [(doc, item, k) for item, k in by.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "passages"])

        one = docs.mapInPandas(scan, "doc_id long, item_id long, passages long")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max("passages").alias("passages"))


def _restore(grams: dict, items: dict, number: dict, known: np.ndarray, n: int) -> Passages:
    own = Passages([], n)
    own.grams, own.items, own.number, own.known = grams, items, number, known
    return own


def remove_leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, n: int = 12, most: int = 2_000_000) -> DataFrame:
    """(doc_id, clean, removed_words): every document without the words of its leaked passages.

    A null text stays null and counts 0. What stands between words is kept around the cut.
    """
    sc = documents.sparkSession.sparkContext
    shared = [sc.broadcast((dict(p.grams), p.items, p.number, p.known, n)) for p in _rounds(items, item_col, item_text, n, most)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [_restore(*s.value) for s in shared]
        for pdf in batches:
            clean, gone = [], []
            for text in pdf.text:
                words, spans = placed_words(text or "")
                starts = sorted({at for p in own for _, at in p.hits(words)})
                if not starts:
                    clean.append(text)
                    gone.append(0)
                    continue
                lost = np.zeros(len(spans), bool)
                for at in starts:
                    lost[at : at + n] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
                kept, last = [], 0
                for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                    kept.append(text[last : spans[lo][0]])
                    last = spans[hi - 1][1]
                clean.append("".join([*kept, text[last:]]))
                gone.append(int(lost.sum()))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "clean": clean, "removed_words": gone})

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, "doc_id long, clean string, removed_words long")
