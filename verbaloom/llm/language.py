"""Problem 3: the language or languages of each text, by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a segment in both directions and gives every position a probability
for each language; positions are pooled to segments (sentences, or parts between line breaks, slashes,
dashes and brackets) and to the document. It is trained in numpy by backpropagation through time on at
most ``sample`` rows that carry a usable label; wrong labels among them are tolerated, as segments that
the half-trained network contradicts are dropped. Every text is labelled, in full length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.llm.sampling import hash_sample

CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
LINK = re.compile(r"\]\([^)\s]*\)|https?://\S+|<[^<>\s][^<>]*>")
BREAK = re.compile(r"[\r\n]+|(?<=[.!?…])[\"»”“')\]]*\s+|\s+[/|–—•·]+\s+|[()]|\s;\s|\t+")
EDGE = re.compile(r"\A[^\w`]+|\s+\Z")
LETTERS = re.compile(r"[^\W\d_]+")


def segments_of(text: str | None) -> list[str]:
    """The parts of a text that are labelled by themselves; code, links and markup are no language."""
    if not text:
        return []
    plain = LINK.sub(" ] ", CODE.sub(" ` ", text))
    return [p for p in (EDGE.sub("", x) for x in BREAK.split(plain)) if LETTERS.search(p)]


class Network:
    """A gated recurrent layer in each direction and a softmax over both states at every position."""

    def __init__(self, langs: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        small = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.p = {f"{d}{n}": v for d in "fb" for n, v in (("E", small(257, 3 * hidden)), ("U", small(hidden, 3 * hidden) * (3 / hidden**0.5)), ("c", np.zeros(hidden, np.float32)))}
        self.p |= {"V": small(2 * hidden, len(langs)), "o": np.zeros(len(langs), np.float32)}

    def state(self) -> dict:
        return {"langs": self.langs, "hidden": self.h, "p": self.p}

    @classmethod
    def of(cls, state: dict) -> Network:
        net = cls.__new__(cls)
        net.langs, net.h, net.p = state["langs"], state["hidden"], state["p"]
        return net

    def _run(self, d: str, x: np.ndarray, keep: bool):
        """States of one direction, [time, row, hidden]; x: [time, row] bytes, 256 where there is none."""
        h, (E, U, c) = self.h, (self.p[d + n] for n in "EUc")
        s = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((len(x), x.shape[1], h), np.float32)
        tape = []
        for t in range(len(x)):
            e, u = E[x[t]], s @ U
            # logistic(a) = (1 + tanh(a / 2)) / 2
            g = np.tanh((e[:, : 2 * h] + u[:, : 2 * h]) * np.float32(0.5))
            g += 1
            g *= np.float32(0.5)
            z, r = g[:, :h], g[:, h:]
            m = u[:, 2 * h :] + c
            n = np.tanh(e[:, 2 * h :] + r * m)
            new = n + z * (s - n)
            if keep:
                tape.append((s, z, r, m, n))
            s = out[t] = new
        return out, tape

    def _logits(self, x: np.ndarray, sizes: np.ndarray, keep: bool):
        """x: [row, time]. The second direction reads each row from its own end."""
        steps = np.arange(x.shape[1])
        turn = np.where(steps < sizes[:, None], sizes[:, None] - 1 - steps, steps)
        f, ft = self._run("f", x.T, keep)
        b, bt = self._run("b", np.take_along_axis(x, turn, 1).T, keep)
        back = np.take_along_axis(b, turn.T[:, :, None], 0)
        both = np.concatenate([f, back], axis=2)
        return both @ self.p["V"] + self.p["o"], both, turn, ft, bt

    def probabilities(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[row, language]: positions' probabilities, pooled by their mean."""
        y = self._logits(x, sizes, False)[0]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        y *= (np.arange(x.shape[1])[:, None] < sizes)[:, :, None]
        return y.sum(0) / np.maximum(sizes, 1)[:, None]

    def gradients(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        y, both, turn, ft, bt = self._logits(x, sizes, True)
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        y[:, np.arange(len(label)), label] -= 1
        y *= ((np.arange(x.shape[1])[:, None] < sizes) / sizes.sum())[:, :, None]
        y = y.astype(np.float32)
        g = {"V": np.einsum("tbh,tbl->hl", both, y, optimize=True), "o": y.sum((0, 1))}
        dh = y @ self.p["V"].T
        db = np.empty_like(dh[:, :, self.h :])
        np.put_along_axis(db, turn.T[:, :, None], dh[:, :, self.h :], 0)
        for d, tape, data, grad in (("f", ft, x.T, dh[:, :, : self.h]), ("b", bt, np.take_along_axis(x, turn, 1).T, db)):
            g |= self._back(d, tape, data, grad)
        return g

    def _back(self, d: str, tape: list, x: np.ndarray, grad: np.ndarray) -> dict[str, np.ndarray]:
        h, U = self.h, self.p[d + "U"]
        gE, gU, gc = (np.zeros_like(self.p[d + n]) for n in "EUc")
        after = np.zeros((x.shape[1], h), np.float32)
        each = np.empty((*x.shape, 3 * h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            s, z, r, m, n = tape[t]
            ds = grad[t] + after
            dn = ds * (1 - z) * (1 - n * n)
            dm = dn * r
            de = np.concatenate([ds * (s - n) * z * (1 - z), dn * m * r * (1 - r), dn], axis=1)
            du = np.concatenate([de[:, : 2 * h], dm], axis=1)
            each[t] = de
            gU += s.T @ du
            gc += dm.sum(0)
            after = ds * z + du @ U.T
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        gE[flat[order][first]] = np.add.reduceat(each.reshape(-1, 3 * h)[order], first)
        return {d + "E": gE, d + "U": gU, d + "c": gc}


def rows_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    x = np.full((len(parts), max(1, sizes.max(initial=1))), 256, np.int64)
    for i, p in enumerate(parts):
        x[i, : len(p)] = np.frombuffer(p, np.uint8)
    return x, sizes


def as_bytes(part: str) -> bytes:
    return re.sub(r"\d+", "0", part.lower()).encode()


def train(parts: list[bytes], labels: np.ndarray, langs: list[str], hidden: int = 32, steps: int = 300, batch: int = 128,
          window: int = 64, seed: int = 5) -> Network:
    """Adam over windows of labelled segments, each language drawn equally often."""
    rng = np.random.default_rng(seed)
    net = Network(langs, hidden, seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    of = [np.flatnonzero(labels == i) for i in range(len(langs))]
    have = [i for i in range(len(langs)) if len(of[i])]
    # Before it could learn single wrong labels by heart: after three passes, at most half of the steps.
    doubt = min(steps // 2, max(40, 3 * len(parts) // batch))
    for step in range(1, steps + 1):
        if step == doubt:
            ok = np.zeros(len(parts), bool)
            for lo in range(0, len(parts), 1024):
                x, sizes = rows_of([p[:window] for p in parts[lo : lo + 1024]])
                ok[lo : lo + 1024] = net.probabilities(x, sizes)[np.arange(len(x)), labels[lo : lo + 1024]] > 0.25
            of = [o[ok[o]] if ok[o].any() else o for o in of]
        pick = np.array([rng.choice(of[i]) for i in rng.choice(have, batch)])
        cut = []
        for k in pick:
            p = parts[k]
            at = rng.integers(0, max(1, len(p) - window // 2)) if len(p) > window else 0
            cut.append(p[at : at + window])
        g = net.gradients(*rows_of(cut), labels[pick])
        norm = float(np.sqrt(sum((v**2).sum() for v in g.values())))
        rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.7
        for k, v in g.items():
            v = v * min(1.0, 1.0 / max(norm, 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net.p[k] = (net.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label_parts(net: Network, parts: list[str], cells: int = 120_000) -> np.ndarray:
    """[part, language] for every part, batched by length; equal parts are read once."""
    data, back = np.unique(np.array([as_bytes(p) for p in parts], object), return_inverse=True) if parts else (np.zeros(0, object), np.zeros(0, np.int64))
    out = np.zeros((len(data), len(net.langs)))
    sizes = np.array([len(d) for d in data], np.int64)
    order, lo = np.argsort(sizes, kind="stable"), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo) < 2048 and (hi - lo + 1) * sizes[order[hi]] <= cells:
            hi += 1
        rows = order[lo:hi]
        out[rows] = net.probabilities(*rows_of([data[i] for i in rows]))
        lo = hi
    return out[back]


def code_of(label: Column) -> Column:
    """The language code in a label: without case, outer blanks and what follows ``-`` or ``_``."""
    return F.split(F.lower(F.trim(label)), "[-_]")[0]


def fit(texts: DataFrame, id_col: str, text_col: str, label_col: str, langs: list[str], sample: int = 4000, **options) -> Network:
    """Train on at most ``sample`` rows whose label is one of ``langs``; the only rows that reach the driver."""
    usable = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), code_of(F.col(label_col)).alias("lang")).filter(F.col("lang").isin(langs) & (F.length("text") > 0))
    parts, labels = [], []
    for r in hash_sample(usable, "id", sample).toPandas().drop_duplicates("id").sort_values("id").itertuples():
        for p in segments_of(r.text):
            if len(LETTERS.findall(p)) >= 3:
                parts.append(as_bytes(p))
                labels.append(langs.index(r.lang))
    return train(parts, np.array(labels, np.int64), langs, **options) if parts else Network(langs, options.get("hidden", 32), 5)


def _judge(parts: list[str], p: np.ndarray, words: int, sure: float) -> dict[int, float]:
    """Language index -> confidence. Each language needs a whole sentence of its own."""
    best, n = p.argmax(1), np.array([len(LETTERS.findall(x)) for x in parts])
    whole = (n >= words) & (p.max(1) >= sure)
    if not whole.any():
        pooled = np.average(p, axis=0, weights=[len(x) for x in parts])
        return {int(pooled.argmax()): float(pooled.max())}
    return {int(k): float(p[whole & (best == k), k].mean()) for k in np.unique(best[whole])}


def _settle(parts: list[str], p: np.ndarray, words: int, sure: float) -> np.ndarray:
    """Parts too short to tell lean on the languages of the text's whole sentences."""
    n = np.array([len(LETTERS.findall(x)) for x in parts])
    whole = (n >= words) & (p.max(1) >= sure)
    if not whole.any() or whole.all():
        return p
    q = p.copy()
    q[~whole] *= p[whole].mean(0) + 1e-3
    return q / q.sum(1, keepdims=True)


def languages(texts: DataFrame, id_col: str, text_col: str, net: Network, words: int = 4, sure: float = 0.6, by_segment: bool = False) -> DataFrame:
    """(id, found_lang, confidence) for each language of each text; by_segment: (id, segment, part, found_lang, confidence).

    A language counts if one segment of at least ``words`` words is in it with a mean probability of
    ``sure``; a text without such a segment gets its likeliest language. Texts without any letter outside
    code (null, empty, blank) give no row. An id that comes twice gives its rows twice.
    """
    shared = texts.sparkSession.sparkContext.broadcast(net.state())

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Network.of(shared.value)
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                split = [segments_of(t) for t in part.text]
                p = label_parts(own, [x for s in split for x in s])
                rows, at = [], 0
                for i, s in zip(part.id, split, strict=True):
                    if s:
                        mine = p[at : at + len(s)]
                        at += len(s)
                        if by_segment:
                            mine = _settle(s, mine, words, sure)
                            rows += [(i, n, x, own.langs[int(q.argmax())], float(q.max())) for n, (x, q) in enumerate(zip(s, mine, strict=True))]
                        else:
                            rows += [(i, own.langs[k], c) for k, c in _judge(s, mine, words, sure).items()]
                yield pd.DataFrame(rows, columns=names)

    shape = "id long, segment int, part string, found_lang string, confidence double" if by_segment else "id long, found_lang string, confidence double"
    names = [c.split()[0] for c in shape.split(", ")]
    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").mapInPandas(label, shape)


def mislabelled(texts: DataFrame, id_col: str, text_col: str, label_col: str, langs: list[str], sample: int = 4000, **options) -> DataFrame:
    """(id, found_lang, confidence) of texts whose label is missing or wrong or that are in several languages."""
    net = fit(texts, id_col, text_col, label_col, langs, sample)
    found = languages(texts, id_col, text_col, net, **options).groupBy("id", "found_lang").agg(F.max("confidence").alias("confidence"))
    labels = texts.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.first(code_of(F.col(label_col)), ignorenulls=True).alias("label"))
    # One row by text, as wide as its languages are many.
    whole = found.groupBy("id").agg(F.collect_list(F.struct("found_lang", "confidence")).alias("all")).join(labels, "id")
    wrong = (F.size("all") > 1) | F.col("label").isNull() | (F.col("label") != F.col("all")[0]["found_lang"])
    return whole.filter(wrong).select("id", F.inline("all"))
