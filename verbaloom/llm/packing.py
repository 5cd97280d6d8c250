"""Problem 6: texts into containers of fixed capacity, whole, with little space unused.

Texts are measured in tokens of a public tokenizer and counted by length. For each capacity, from the
largest down, combinations of at most three lengths that fill a container exactly, one of them too long for
the next smaller capacity, are the columns of a non-negative least-squares problem whose right side is the
histogram; shorter lengths may fill gaps or be left for later. The repeat counts found are rounded down and
what remains is packed greedily, best fit first. Lengths are rounded up to 1/512 of the capacity, so the
problem has the same size whatever the number of texts; only the histogram reaches the driver.

Every text then gets its place: texts of one length are numbered, and the ranges of numbers that each
repeated combination takes are looked up.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.session import checkpointed

UNITS = 512
SCHEMA = "doc_id long, part int, first_token long, tokens long, container_id long, capacity int"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(2)
def encoder(path: str):
    """The tokenizer of a file of ranks, as tiktoken reads it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, tokens) of every text; null counts as empty."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "tokens": [len(encode(t)) if t else 0 for t in pdf.text]})

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null").mapInPandas(count, "id long, tokens long")


def combinations(least: int) -> np.ndarray:
    """[n, 3] units that sum to UNITS, falling, zero for no part, the first at least ``least``."""
    out = [(UNITS, 0, 0)]
    for a in range(UNITS - 1, max(least, math.ceil(UNITS / 3)) - 1, -1):
        rest = UNITS - a
        if rest <= a:
            out.append((a, rest, 0))
        b = np.arange(min(a, rest - 1), math.ceil(rest / 2) - 1, -1)
        out += [(a, int(x), rest - int(x)) for x in b]
    return np.array(out, np.int64)


def non_negative(columns: np.ndarray, have: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings the columns' sums near to ``have``, by accelerated projected gradient.

    Each column holds one part in each of its places (equal places add up).
    """
    def down(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(columns[:, k], x, UNITS + 1) for k in range(3))

    # A longest part is needed in every column: its row counts fully, fillers only where they lack.
    step = 1.0 / max(1.0, 3.0 * np.bincount(columns.ravel(), minlength=UNITS + 1)[1:].max())
    x = np.zeros(len(columns))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        r = down(y) - have
        r[0] = 0
        new = np.maximum(0, y - step * (r[columns[:, 0]] + r[columns[:, 1]] + r[columns[:, 2]]))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(sizes: dict[int, int], capacities: list[int]) -> list[tuple[int, tuple[int, ...], int]]:
    """(capacity, lengths, repeats) that place every length as often as it occurs. Lengths are at most the largest capacity."""
    left = {s: n for s, n in sizes.items() if s > 0 and n > 0}
    out: list[tuple[int, tuple[int, ...], int]] = []
    caps = sorted(set(capacities))
    for at in range(len(caps) - 1, -1, -1):
        cap, lower = caps[at], caps[at - 1] if at else 0
        unit = cap / UNITS
        of: dict[int, list[int]] = {}
        for s in sorted(left):
            if s <= cap:
                of.setdefault(math.ceil(s / unit), []).append(s)
        have = np.zeros(UNITS + 1)
        for u, group in of.items():
            have[u] = sum(left[s] for s in group)
        if not have.any():
            continue
        must = math.ceil((lower + 1) / unit)
        columns = combinations(must)
        columns = columns[(have[columns[:, 0]] > 0) & ((columns[:, 1] == 0) | (have[columns[:, 1]] > 0)) & ((columns[:, 2] == 0) | (have[columns[:, 2]] > 0))]
        repeats: list[tuple[tuple[int, ...], int]] = []
        if len(columns):
            # A filler that is left over costs nothing, so its row asks for no more than the long lengths can use.
            x = non_negative(columns, have)
            for row, n in sorted(zip(columns.tolist(), np.floor(x + 1e-6).astype(int).tolist(), strict=True), key=lambda p: -p[1]):
                parts = tuple(u for u in row if u)
                n = min(n, *(int(have[u]) // parts.count(u) for u in parts))
                if n > 0:
                    repeats.append((parts, n))
                    for u in parts:
                        have[u] -= n
        repeats += _greedy(have, must)
        for parts, n in repeats:
            out += [(cap, lengths, k) for lengths, k in _lengths(parts, n, of, left)]
    return out


def _greedy(have: np.ndarray, must: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, in bulk: every container that starts with a part of at least ``must``."""
    out = []
    for u in range(UNITS, must - 1, -1):
        while have[u] >= 1:
            parts, room, use = [u], UNITS - u, {u: 1}
            while room:
                fits = [v for v in range(min(room, UNITS), 0, -1) if have[v] - use.get(v, 0) >= 1]
                if not fits:
                    break
                v = fits[0]
                k = min(room // v, int(have[v]) - use.get(v, 0))
                parts += [v] * k
                use[v] = use.get(v, 0) + k
                room -= v * k
            n = max(1, min(int(have[v]) // k for v, k in use.items()))
            for v, k in use.items():
                have[v] -= n * k
            out.append((tuple(parts), n))
    return out


def _lengths(parts: tuple[int, ...], n: int, of: dict[int, list[int]], left: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """The units' combination as combinations of real lengths, in as few runs as the supplies allow."""
    out = []
    while n > 0:
        chosen, use = [], {}
        for u in parts:
            group = of[u]
            while left.get(group[-1], 0) - use.get(group[-1], 0) < 1:
                if left.get(group[-1], 0) > 0:  # taken by this very container
                    s = next(s for s in reversed(group) if left.get(s, 0) - use.get(s, 0) >= 1)
                    break
                group.pop()
            else:
                s = group[-1]
            chosen.append(s)
            use[s] = use.get(s, 0) + 1
        k = min(n, *(left[s] // c for s, c in use.items()))
        for s, c in use.items():
            left[s] -= k * c
            if not left[s]:
                del left[s]
        out.append((tuple(chosen), k))
        n -= k
    return out


def places(made: list[tuple[int, tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length the runs of its numbers: (length, start, container, each, capacity).

    Numbers start, start + 1, ... of a length go to containers container, container + 1, ..., ``each`` to one.
    """
    used: dict[int, int] = {}
    rows, container = [], 0
    for cap, lengths, n in made:
        for s in dict.fromkeys(lengths):
            each = lengths.count(s)
            rows.append((s, used.get(s, 0), container, each, cap))
            used[s] = used.get(s, 0) + each * n
        container += n
    return pd.DataFrame(rows, columns=["length", "start", "container", "each", "capacity"]).sort_values(["length", "start"], ignore_index=True)


def pack(texts: DataFrame, id_col: str, text_col: str, capacities: list[int], vocabulary: str | None = None, task: int = 50_000) -> DataFrame:
    """(doc_id, part, first_token, tokens, container_id, capacity): the place of every text.

    A text longer than the largest capacity is split into full containers and a rest; no other text is. A
    container is of the smallest capacity that holds what it got. Texts without tokens (null, empty) take no
    space and get no row; an id that comes twice counts once; an empty table gives no rows, and neither do
    texts for which there are no capacities at all. A capacity below one is refused.
    """
    spark = texts.sparkSession
    if not capacities:
        return spark.createDataFrame([], SCHEMA)
    if min(capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    counted = checkpointed(token_counts(texts, id_col, text_col, vocabulary).groupBy("id").agg(F.max("tokens").alias("tokens")))
    parts = counted.filter("tokens > 0").select(F.col("id").alias("doc_id"), "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / largest))).alias("part"))
    parts = parts.select("doc_id", F.col("part").cast("int").alias("part"), (F.col("part") * largest).alias("first_token"), F.least(F.lit(largest), F.col("tokens") - F.col("part") * largest).cast("long").alias("tokens"))
    # Numbers within a length are given out by (length, salt), about ``task`` parts to one, so the salts of a length grow with its count.
    # By length there are at most ``largest`` rows, which bounds the broadcast; groups are as many, plus parts / task.
    ways = parts.groupBy("tokens").agg(F.ceil(F.count("*") / task).cast("int").alias("ways"))
    parts = parts.join(F.broadcast(ways), "tokens").withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), "ways").cast("int")).drop("ways")
    groups = parts.groupBy("tokens", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["tokens", "salt"], ignore_index=True)
    groups["before"] = groups.groupby("tokens").n.cumsum() - groups.n if len(groups) else pd.Series(dtype="int64")
    made = plan({int(k): int(v) for k, v in groups.groupby("tokens").n.sum().items()}, capacities)
    table = places(made)
    load = np.array([sum(lengths) for _, lengths, n in made for _ in range(1)], np.int64)
    caps = np.array(sorted(set(capacities)))
    fit = {c: int(caps[np.searchsorted(caps, w)]) for c, w in zip(np.cumsum([0, *(n for *_, n in made)])[:-1].tolist(), load.tolist(), strict=True)}
    table["capacity"] = table.container.map(fit)
    first = ((groups.tokens.to_numpy(np.int64) << 32) + groups.salt.to_numpy(np.int64), groups.before.to_numpy(np.int64))
    runs = (table.length.to_numpy(np.int64) << 40) + table.start.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((*first, runs, *(table[c].to_numpy(np.int64) for c in ("start", "container", "each", "capacity"))))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, before, run, start, container, each, capacity = shared.value
        for pdf in batches:
            number = before[np.searchsorted(keys, (pdf.tokens.to_numpy(np.int64) << 32) + pdf.salt.to_numpy())] + pdf.number.to_numpy() - 1
            k = np.searchsorted(run, (pdf.tokens.to_numpy() << 40) + number, side="right") - 1
            yield pd.DataFrame({"doc_id": pdf.doc_id, "part": pdf.part, "first_token": pdf.first_token, "tokens": pdf.tokens, "container_id": container[k] + (number - start[k]) // each[k], "capacity": capacity[k]})

    numbered = parts.withColumn("number", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "part")))
    return numbered.mapInPandas(put, SCHEMA)


def fill(packed: DataFrame) -> DataFrame:
    """(capacity, containers, tokens, space, used_share) by capacity."""
    each = packed.groupBy("container_id", "capacity").agg(F.sum("tokens").alias("tokens"))
    by = each.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity").cast("long")).alias("space"))
    return by.withColumn("used_share", F.col("tokens") / F.col("space"))
