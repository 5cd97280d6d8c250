"""Problem 2: records that repeat another's content apart from small edits, by Golay-code fuzzy hashing.

A record is the multiset of its words. For each of ``tables`` tables it gets a segment of 23 bits,
each bit from one weighted min-hash, and one more min-hash in full. The perfect binary Golay code
(23, 12) decodes every 23-bit vector to one of 4096 codewords; a segment's keys are the codewords to
which it and its 23 neighbours at distance one decode (six or one). Two segments that differ in at
most two bits then share a key. A pair whose errors are spread over all segments has, by the
pigeonhole principle, segments with few of them, so several tables find it. Records that share a key
and the full min-hash are candidates, so that what is found is a matter of chance, table by table: a pair
of similarity s shares the full min-hash of a table with chance s, weights aside; a comparison of 64 fingerprint bits thins them out, and the
words of the rest are compared exactly.

Words found in more than ``common`` of the records weigh less. There are at most (mean number of
different words) / common of them, which bounds what is broadcast. Records with the same multiset form
one class, which is searched once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.llm.graph import connected_components
from verbaloom.session import checkpointed

WORD = re.compile(r"[^\W_]+")
#: Generator of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
BITS = 23


@lru_cache(1)
def decoder() -> np.ndarray:
    """Of each 23-bit vector, the index of the codeword within distance three."""
    words = np.zeros(4096, np.int64)
    for bit in range(12):
        words ^= np.where(np.arange(4096) >> bit & 1, GOLAY << bit, 0)
    to = np.full(1 << BITS, -1, np.int16)
    for weight in range(4):
        for bits in combinations(range(BITS), weight):
            to[words ^ sum(1 << b for b in bits)] = np.arange(4096)
    return to


def golay_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index): the different codewords of each segment's sphere of radius one."""
    near = np.stack([v, *(v ^ (1 << b) for b in range(BITS))], axis=1)
    keys = np.sort(decoder()[near], axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, col = np.nonzero(new)
    return row, keys[row, col].astype(np.int64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Fingerprints:
    """Segments, full min-hashes and class hashes of texts. weights: inverse weight of common words."""

    def __init__(self, weights: dict[str, int], tables: int, seed: int = 7):
        self.weights, self.tables, self.known = weights, tables, {}
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 2**63, size=tables * (BITS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and inverse weight of every word of every text, and the number of words by text.

        The n-th repetition of a word in a text is a word of its own.
        """
        if len(self.known) > 400_000:
            self.known.clear()
        hashes, inverse, sizes = [], [], []
        for text in texts:
            seen: dict[str, int] = {}
            found = words_of(text)
            for w in found:
                if w not in self.known:
                    self.known[w] = (xxhash.xxh3_64_intdigest(w), self.weights.get(w, 4))
                h, i = self.known[w]
                n = seen.get(w, 0)
                seen[w] = n + 1
                hashes.append((h + n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
                inverse.append(i)
            sizes.append(len(found))
        return _mix(np.array(hashes, np.uint64)), np.array(inverse, np.uint64), np.array(sizes, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows with words, their numbers of words, class hash, 64 bits, segment << 20 | full min-hash by table)."""
        x, inverse, sizes = self.features(texts)
        rows = np.flatnonzero(sizes)
        if not len(rows):
            return rows, rows, rows, rows, np.zeros((0, self.tables), np.int64)
        at = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        cls = (np.add.reduceat(_mix(x), at) ^ (sizes[rows].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)
        out = np.zeros((len(rows), self.tables), np.int64)
        sketch = np.zeros(len(rows), np.uint64)
        for k, odd in enumerate(self.odd):
            h = x * odd
            low = np.minimum.reduceat((((h >> np.uint64(33)) * inverse) << np.uint64(20)) | ((h >> np.uint64(10)) & np.uint64(0xFFFFF)), at) & np.uint64(0xFFFFF)
            table, bit = divmod(k, BITS + 1)
            if bit == BITS:
                out[:, table] = (out[:, table] << 20) | low.astype(np.int64)
            else:
                one = (low >> np.uint64(3)) & np.uint64(1)
                out[:, table] |= one.astype(np.int64) << bit
                if (place := table * BITS + bit) < 64:
                    sketch |= one << np.uint64(place)
        return rows, sizes[rows], cls, sketch.view(np.int64), out


def common_words(text: Column, records: DataFrame, common: float) -> dict[str, int]:
    """Inverse weight (from 4) of each word that more than ``common`` of the different texts hold.

    Copies count once, so that the words of a text that much of the table repeats keep their weight.
    """
    once = records.groupBy(F.xxhash64(text).alias("h")).agg(F.first(text).alias("text"))
    total = once.count()
    text = F.col("text")
    held = once.select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("w")).filter("w <> ''")
    often = held.groupBy("w").count().filter(F.col("count") >= F.lit(common * total)).collect()
    full = math.log(1 / common)
    return {r.w: min(1023, round(4 / max(0.1, math.log(total / min(total, r["count"])) / full))) for r in often}


def near_duplicates(records: DataFrame, id_col: str, text_cols: list[str], threshold: tuple[int, int] = (4, 5),
                    tables: int = 6, common: float = 0.002, differ: int = 17, crowd: int = 2048, small: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(id, class) of every record with words, and (class_a, class_b, common_words, all_words) of linked classes.

    threshold: least share of common words in all words of two multisets, as a fraction. differ: the
    most of 64 fingerprint bits in which candidates differ. crowd: classes of a key that one task compares with each other;
    small: most divided keys that are broadcast (16 bytes each). Neither changes the result. Null columns count as empty; records without
    any word belong to no class; a record delivered twice counts once; other columns are not read.
    """
    spark = records.sparkSession
    text = F.concat_ws(" ", *text_cols)
    base = records.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).filter("id is not null")
    weights = spark.sparkContext.broadcast(common_words(F.col("text"), base, common))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = Fingerprints(weights.value, tables)
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                rows, n, cls, sketch, segs = prints(part.text.tolist())
                yield pd.DataFrame({"id": part.id.to_numpy()[rows], "n": n, "cls": cls, "sketch": sketch, "segs": list(segs)})

    marked = checkpointed(base.mapInPandas(mark, "id long, n int, cls long, sketch long, segs array<long>"))
    members = marked.select("id", "cls").distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            segs = np.stack(pdf.segs.to_numpy()) if len(pdf) else np.zeros((0, tables), np.int64)
            for t in range(segs.shape[1]):
                row, word = golay_keys(segs[:, t] >> 20)
                yield pd.DataFrame({"key": (t << 32) | (word << 20) | (segs[row, t] & 0xFFFFF), "cls": pdf.cls.to_numpy()[row], "n": pdf.n.to_numpy()[row], "sketch": pdf.sketch.to_numpy()[row]})

    keyed = marked.dropDuplicates(["cls"]).select("cls", "n", "sketch", "segs").mapInPandas(keys, "key long, cls long, n int, sketch long")
    # A key that many classes share is divided into blocks, each pair of which is compared by itself: no task holds the whole key.
    crowded = keyed.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > crowd)
    crowded = checkpointed(crowded.select("key", F.ceil(F.col("held") / crowd).cast("int").alias("blocks")))
    number = crowded.count()
    if number:
        keyed = keyed.join(F.broadcast(crowded) if number <= small else crowded, "key", "left")
        keyed = keyed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
        left = keyed.withColumn("other", F.explode(F.expr("sequence(block, blocks - 1)")))
        right = keyed.withColumn("other", F.col("block")).withColumn("block", F.explode(F.expr("sequence(0, other)")))
    else:
        left = right = keyed.withColumns({"block": F.lit(0), "other": F.lit(0)})
    a, b = left.alias("a"), right.alias("b")
    close = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.other") == F.col("b.other"))
    close &= ((F.col("a.block") < F.col("a.other")) | (F.col("a.cls") < F.col("b.cls"))) & (F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) <= differ)
    # Multisets this similar differ in size by no more than the threshold allows; that loses nothing.
    close &= F.least("a.n", "b.n") * threshold[1] >= F.greatest("a.n", "b.n") * threshold[0]
    candidates = checkpointed(a.join(b, close).select(F.least("a.cls", "b.cls").alias("class_a"), F.greatest("a.cls", "b.cls").alias("class_b")).distinct())

    ends = candidates.select(F.explode(F.array("class_a", "class_b")).alias("cls")).distinct()
    one = members.join(ends, "cls").groupBy("cls").agg(F.min("id").alias("id"))
    words = base.join(one, "id").dropDuplicates(["cls"]).select("cls", "text")
    both = candidates.join(words.select(F.col("cls").alias("class_a"), F.col("text").alias("text_a")), "class_a").join(words.select(F.col("cls").alias("class_b"), F.col("text").alias("text_b")), "class_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shared, whole = [], []
            for x, y in zip(pdf.text_a, pdf.text_b, strict=True):
                p, q = Counter(words_of(x)), Counter(words_of(y))
                n = sum(min(k, q[w]) for w, k in p.items() if w in q)
                shared.append(n)
                whole.append(p.total() + q.total() - n)
            out = pd.DataFrame({"class_a": pdf.class_a, "class_b": pdf.class_b, "common_words": shared, "all_words": whole})
            yield out[out.common_words * threshold[1] >= out.all_words * threshold[0]]

    return members, both.mapInPandas(verify, "class_a long, class_b long, common_words long, all_words long")


def duplicate_pairs(records: DataFrame, id_col: str, text_cols: list[str], **options) -> DataFrame:
    """(entry_a, entry_b), entry_a < entry_b: all pairs of records over the threshold."""
    members, links = near_duplicates(records, id_col, text_cols, **options)
    members = checkpointed(members)
    whole = links.select("class_a", "class_b").unionByName(members.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("cls").alias("class_a"), F.col("cls").alias("class_b")))
    left = members.select(F.col("id").alias("x"), F.col("cls").alias("class_a"))
    right = members.select(F.col("id").alias("y"), F.col("cls").alias("class_b"))
    pairs = whole.join(left, "class_a").join(right, "class_b").filter("class_a <> class_b or x < y")
    return pairs.select(F.least("x", "y").alias("entry_a"), F.greatest("x", "y").alias("entry_b")).filter("entry_a < entry_b").distinct()


def duplicate_groups(records: DataFrame, id_col: str, text_cols: list[str], **options) -> DataFrame:
    """(entry_id, group_id, links): groups of records tied by links over the threshold.

    One row per record of a group of at least two; group_id is the smallest id in it. links counts the
    other classes (different texts) that its class is linked to; copies count as one class.
    """
    members, links = near_duplicates(records, id_col, text_cols, **options)
    members, links = checkpointed(members), checkpointed(links)
    named = members.groupBy("cls").agg(F.min("id").alias("head"), F.count("*").alias("n"))
    parts = connected_components(links, "class_a", "class_b")
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    cls = named.join(degree, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left").filter("n > 1 or links is not null")
    cls = cls.withColumn("component", F.coalesce("component", "cls"))
    heads = cls.groupBy("component").agg(F.min("head").alias("group_id"))
    return members.join(cls.join(heads, "component").select("cls", "group_id", F.coalesce("links", F.lit(0)).alias("links")), "cls").select(F.col("id").alias("entry_id"), "group_id", "links")
