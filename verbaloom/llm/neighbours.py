"""Problem 1: the k most similar vectors of every vector, by a hash-prefix forest.

Each tree turns a vector into a long string of bits: the sides it falls on while it descends hyperplanes fitted on a
bounded sample, then the sides of random hyperplanes centred on the leaf. A tree is the sorted array of the strings of
all vectors. It is held in segments, each the run of strings under one prefix, which tasks sort and search.

Every vector is a query. It descends all trees to its own string, the longest match there is, and then ascends in all
trees at once: the prefix is shortened by the same number of bits everywhere until the vectors under it number about
``block`` for each tree together (numbers by the sample). In the sorted array the prefix is a run; where the run's true
length is far from the one foreseen, the prefix is lengthened or shortened by the counts of the array itself. The query
is compared with the run by a matrix product, and the trees' candidates are merged.

The sample (``sample`` vectors, chosen by a hash of their id) fits hyperplanes and foresees sizes only; equal vectors
in it count as one when hyperplanes are fitted. Sizes of segments are counted over all vectors, and one beyond four
times its size is divided by further bits of its strings, and where three times that doesn't help (copies of one vector)
by the ids, as in any part the other copies are as near. Work is n * block * trees. As a collection grows, more vectors lie
about as near as the nearest: beyond ``usual`` vectors block and segment grow with the fourth root of their number, the
sample with its square root, so work grows with the power 1.25.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaloom.llm.sampling import hash_sample

#: Bits of a string, and the most that come from fitted hyperplanes.
BITS, DEEPEST = 62, 40


def usable(column: str, dim: int):
    """A vector with ``dim`` values, all finite, not all zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) == dim) & ~bad & F.exists(c, lambda x: x != 0)


class Tree:
    """Hyperplanes by node, fitted on different vectors; weight: how often each of them stands in the sample."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, least: int, seed: int):
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        self.w, self.b, self.kids, self.size, self.depth, self.path = [], [], [], [], [], []
        self.mid: dict[int, np.ndarray] = {}
        self.heavy: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a leaf: its most repeated vectors, and how often
        self.tail = rng.standard_normal((dim, BITS)).astype(np.float32)
        todo = [(np.arange(len(x)), 0, 0, -1, 0)]
        while todo:
            ix, path, depth, up, side = todo.pop()
            me = len(self.w)
            if up >= 0:
                self.kids[up][side] = me
            self.size.append(int(weight[ix].sum()))
            self.depth.append(depth)
            self.path.append(path << BITS - depth)
            self.kids.append([-1, -1])
            cut = self._cut(x[ix], rng) if len(ix) > least and depth < DEEPEST else None
            if cut is None:
                self.w.append(np.zeros(dim, np.float32))
                self.b.append(0.0)
                self.mid[me] = np.median(x[ix] @ self.tail, axis=0) if len(ix) else np.zeros(BITS, np.float32)
                top = ix[np.argsort(-weight[ix], kind="stable")[:8]]
                self.heavy[me] = (x[top], weight[top])
                continue
            w, b, right = cut
            self.w.append(w)
            self.b.append(b)
            todo += [(ix[~right], path << 1, depth + 1, me, 0), (ix[right], path << 1 | 1, depth + 1, me, 1)]

    @staticmethod
    def _cut(x: np.ndarray, rng: np.random.Generator):
        """A hyperplane between two means; where it would be lopsided, at the median. None only if all vectors are equal, up to rounding."""
        y = x if len(x) <= 2048 else x[rng.choice(len(x), 2048, replace=False)]
        first = y[rng.integers(len(y))]
        others = np.flatnonzero(np.abs(x - first).max(axis=1) > 1e-6)
        if not len(others):
            return None
        c = start = np.stack([first, x[rng.choice(others)]])
        for _ in range(6):
            right = (y @ (c[0] - c[1])) > (c[0] @ c[0] - c[1] @ c[1]) / 2
            if right.all() or not right.any():
                break
            c = np.stack([y[right].mean(0), y[~right].mean(0)])
        w = c[0] - c[1]
        if np.linalg.norm(w) < 1e-6:
            c = start
            w = c[0] - c[1]
        w = w / float(np.linalg.norm(w))
        p, b = x @ w, float(((c[0] + c[1]) / 2) @ w)
        if min((p > b).sum(), (p <= b).sum()) < 0.1 * len(x):
            b = float(np.median(p))
        right = p > b
        if right.all() or not right.any():  # copies hold the median: between the outermost
            b = float((p.min() + p.max()) / 2)
            right = p > b
        return None if right.all() or not right.any() else (w.astype(np.float32), b, right)

    def descend(self, x: np.ndarray, scale: float, segment: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(string, vectors foreseen under its prefix of each length, length and copies' divisor of its segment, whether it is a copy).

        scale: vectors of the collection for each of the sample. The segment is the longest prefix not below the leaf
        under which no more than ``segment`` vectors are foreseen, or bits of the tail where a leaf holds more.
        """
        n = len(x)
        key, size, cut, ways, copy = np.zeros(n, np.int64), np.zeros((n, levels)), np.full(n, -1, np.int64), np.ones(n, np.int64), np.zeros(n, bool)
        todo = [(0, np.arange(n))]
        while todo:
            at, rows = todo.pop()
            depth, here = self.depth[at], self.size[at] * scale
            if depth < levels:
                size[rows, depth] = here
            if here <= segment:
                cut[rows[cut[rows] < 0]] = depth
            if self.kids[at][0] >= 0:
                right = x[rows] @ self.w[at] > self.b[at]
                todo += [(kid, part) for kid, part in zip(self.kids[at], (rows[~right], rows[right]), strict=True) if len(part)]
                continue
            left = BITS - depth
            sides = (x[rows] @ self.tail[:, :left]) > self.mid[at][:left]
            key[rows] = self.path[at] | (sides.astype(np.int64) << np.arange(left - 1, -1, -1)).sum(axis=1)
            for k in range(depth + 1, levels):
                size[rows, k] = here / 2.0 ** (k - depth)
            vectors, often = self.heavy[at]
            rest = here
            for v, times in zip(vectors, often, strict=True):
                if here > segment and times * scale > segment / 2:
                    same = rows[np.abs(x[rows] - v).max(axis=1) < 1e-4]
                    copy[same], ways[same], cut[same] = True, math.ceil(times * scale / segment), depth
                    rest -= times * scale
            open_rows = rows[cut[rows] < 0]
            cut[open_rows] = min(BITS, depth + max(0, math.ceil(math.log2(max(1.0, rest / segment)))))
        return key, size, cut, ways, copy


def ascent(sizes: list[np.ndarray], enough: float) -> np.ndarray:
    """The longest prefix under which all trees together hold ``enough`` vectors; 0 if none does. sizes: by tree, (query, length)."""
    total = sum(sizes)
    return np.where((ok := total >= enough).any(axis=1), total.shape[1] - 1 - ok[:, ::-1].argmax(axis=1), 0)


def _unit(values: pd.Series, dim: int) -> np.ndarray:
    x = np.concatenate([np.asarray(v, dtype=np.float64) for v in values]).reshape(-1, dim) if len(values) else np.zeros((0, dim))
    x /= np.abs(x).max(axis=1, keepdims=True).clip(1e-300)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _pack(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    top = np.abs(x).max(axis=1).clip(1e-30)
    return [r.tobytes() for r in np.rint(x / top[:, None] * 32767).astype(np.int16)], (top / 32767).astype(np.float32)


def _runs(key: np.ndarray, length: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of each place of a sorted array: that of its prefix of the given length, made longer or shorter where the run holds too many or too few."""
    at = np.arange(len(key))

    def bounds(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        free = (BITS - n).astype(np.int64)
        low = key[rows] >> free << free
        return np.searchsorted(key, low), np.searchsorted(key, low + (np.int64(1) << free))

    length = length.copy()
    lo, hi = bounds(at, length)
    many, few, least = 4 * block, max(1, block // 4), 0
    while len(rows := np.flatnonzero((hi - lo > many) & (length < BITS))):
        length[rows] += 1
        lo[rows], hi[rows] = bounds(rows, length[rows])
    while len(rows := np.flatnonzero((hi - lo < few) & (length > least))):
        length[rows] -= 1
        lo[rows], hi[rows] = bounds(rows, length[rows])
    wide = hi - lo > many  # equal strings to the last bit: those around the own place
    first = np.clip(at // block * block - block // 2, lo, np.maximum(lo, hi - 2 * block))
    return np.where(wide, first, lo), np.where(wide, np.minimum(hi, first + 2 * block), hi)


def _search(key: np.ndarray, length: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int) -> pd.DataFrame:
    """The k best of its run for each vector of a segment, ties by the smaller id."""
    order = np.lexsort((ids, key))
    key, length, ids, x = key[order], length[order], ids[order], x[order]
    lo, hi = _runs(key, length, block)
    near, cos = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -9.0)
    by = np.lexsort((hi, lo))
    for rows in np.split(by, np.flatnonzero((np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0)) + 1):
        if not len(rows):
            continue
        a, z = int(lo[rows[0]]), int(hi[rows[0]])
        names = ids[a:z]
        for part in np.array_split(rows, math.ceil(len(rows) / 1024)):
            s = x[part] @ x[a:z].T
            s[np.arange(len(part)), part - a] = -9
            m = min(k + 3, s.shape[1])
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            v = np.take_along_axis(s, top, 1)
            o = np.lexsort((names[top], -v), axis=1)[:, :k]
            got = o.shape[1]
            near[part, :got], cos[part, :got] = names[np.take_along_axis(top, o, 1)], np.take_along_axis(v, o, 1)
    real = cos > -5
    return pd.DataFrame({"id": ids, "near": [r[q].tolist() for r, q in zip(near, real, strict=True)], "cos": [r[q].tolist() for r, q in zip(cos, real, strict=True)]})


class Forest:
    """The trees and the division of their arrays into segments."""

    def __init__(self, trees: list[Tree], scale: float, block: int, segment: int):
        self.trees, self.scale, self.block, self.segment = trees, scale, block, segment
        self.split: list[dict[str, int]] = []  # in rounds: segments that held too many, and how many

    def places(self, x: np.ndarray, ids: np.ndarray) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """By tree: the segment of each vector, its string, and the length of the prefix to which it ascends."""
        found = [t.descend(x, self.scale, self.segment, BITS) for t in self.trees]
        length = ascent([f[1] for f in found], self.block * len(self.trees))
        out = []
        for t, (key, _, cut, ways, copy) in enumerate(found):
            names = [f"{t}:{n}:{k >> BITS - n}" for k, n in zip(key.tolist(), cut.tolist(), strict=True)]
            # Copies beyond a segment are dealt out; the first part stays with the rest of the leaf.
            names = [f"{s}#{i % w}" if c and i % w else s for s, i, w, c in zip(names, ids.tolist(), ways.tolist(), copy.tolist(), strict=True)]
            cut = cut.tolist()
            for turn, held in enumerate(self.split):
                for i, s in enumerate(names):
                    if s in held:
                        bits = min(BITS - cut[i], math.ceil(math.log2(held[s] / self.segment))) if turn < 3 else 0
                        parts = math.ceil(held[s] / self.segment)
                        names[i] = f"{s}.{key[i] >> BITS - cut[i] - bits & (1 << bits) - 1:0{bits}b}" if bits else f"{s}/{ids[i] % parts}"
                        cut[i] += bits
            out.append((names, key, length))
        return out


def grown(total: int, block: int, segment: int, sample: int, usual: int) -> tuple[int, int, int]:
    """block, segment and sample for a collection of ``total`` vectors; they are meant for ``usual``."""
    times = max(1.0, total / usual)
    return round(block * times**0.25), round(segment * times**0.25), round(sample * times**0.5)


def nearest(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 96, trees: int = 4,
            block: int = 768, segment: int = 8192, sample: int = 16384, usual: int = 80_000) -> DataFrame:
    """(id, neighbour, cosine, rank) for every usable vector, rank 1 to k.

    Unusable vectors (null, another length, a null or non-finite value, all zero) are left out.
    An id that comes twice counts once. Fewer than k others give fewer rows; an empty table none.
    Ties are broken by the smaller id. Other columns are not read.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(F.col("id").isNotNull() & usable("vec", dim))
    total = base.count()
    block, segment, sample = grown(total, block, segment, sample, usual)
    some = hash_sample(base, "id", sample, total).toPandas().drop_duplicates("id").sort_values("id")
    scale = total / max(1, len(some))
    parts = [_unit(some.vec.iloc[lo : lo + 8192], dim).round(5) for lo in range(0, max(1, len(some)), 8192)]
    different, weight = np.unique(np.concatenate(parts), axis=0, return_counts=True)
    forest = Forest([Tree(different, weight, 32, 17 + t) for t in range(trees)] if len(some) else [], scale, block, segment)
    while forest.trees:
        shared = spark.sparkContext.broadcast(forest)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held: Counter[str] = Counter()
            for pdf in batches:
                for names, _, _ in shared.value.places(_unit(pdf.vec, dim), pdf.id.to_numpy()):
                    held.update(names)
            if held:
                yield pd.DataFrame({"g": list(held), "n": list(held.values())})

        held = base.mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") > 4 * segment)
        over = {r.g: r.n for r in held.collect() if "/" not in r.g}  # at most a quarter of trees * vectors / segment rows
        if not over:
            break
        forest.split.append(over)
    shared = spark.sparkContext.broadcast(forest)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _unit(pdf.vec, dim)
            packed, unit = _pack(x)
            for names, key, length in shared.value.places(x, pdf.id.to_numpy()):
                yield pd.DataFrame({"g": names, "id": pdf.id, "key": key, "m": length.astype(np.int32), "q": packed, "u": unit})

    spread_out = base.mapInPandas(spread, "g string, id long, key long, m int, q binary, u float")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        x = np.frombuffer(b"".join(pdf.q), np.int16).reshape(-1, dim).astype(np.float32) * pdf.u.to_numpy()[:, None]
        return _search(pdf.key.to_numpy(), pdf.m.to_numpy(), pdf.id.to_numpy(), x, k, block)

    lists = spread_out.groupBy("g").applyInPandas(compare, "id long, near array<long>, cos array<double>")
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("near", "cos"), lambda p: F.struct((-p["cos"]).alias("d"), p["near"].alias("near")))))
    merged = lists.groupBy("id").agg(pairs.alias("p"))
    # One neighbour found in several trees comes with the same cosine up to rounding: keep its first.
    first = F.aggregate(
        F.array_sort("p"),
        F.array().cast("array<struct<d:double,near:bigint>>"),
        lambda acc, p: F.when((F.size(acc) < k) & ~F.exists(acc, lambda q: q["near"] == p["near"]), F.concat(acc, F.array(p))).otherwise(acc),
    )
    top = merged.select("id", F.posexplode(first).alias("pos", "p"))
    return top.select("id", F.col("p.near").alias("neighbour"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("p.d"))).alias("cosine"), (F.col("pos") + 1).cast("int").alias("rank"))


def neighbour_pairs(vectors: DataFrame, id_col: str, vec_col: str, **options) -> DataFrame:
    """(entry_a, entry_b): unordered pairs of which at least one is among the other's k nearest."""
    n = nearest(vectors, id_col, vec_col, **options)
    return n.select(F.least("id", "neighbour").alias("entry_a"), F.greatest("id", "neighbour").alias("entry_b")).distinct()
