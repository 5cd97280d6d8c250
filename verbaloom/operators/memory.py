"""Translation memory: exact and fuzzy lookup, upsert with revisions, history."""

from __future__ import annotations

import difflib
import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from verbaloom.functions import similarity as S
from verbaloom.functions import text as T
from verbaloom.operators import qa as Q
from verbaloom.operators.catalogue import latest
from verbaloom.session import stored


def entries(memory: DataFrame) -> DataFrame:
    """One row by (source_key, lang), the one updated last."""
    return latest(memory, ["source_key", "lang"], ["updated_at"])


def exact(segs: DataFrame, memory: DataFrame, source: str = "source") -> DataFrame:
    """Segments joined with the memory's target for their normalised source and language.

    memory has one row by (source_key, lang). Adds tm_target (null without a hit), tm_score and tm_status.
    Null languages match nothing.
    """
    keyed = segs.withColumn("source_key", T.source_key(F.col(source)))
    hits = memory.filter("target <> ''").select("source_key", "lang", F.col("target").alias("tm_target"))
    joined = keyed.join(hits, ["source_key", "lang"], "left")
    return joined.withColumns({"tm_score": F.when(F.col("tm_target").isNotNull(), F.lit(1.0)), "tm_status": F.when(F.col("tm_target").isNotNull(), F.lit("needs_review"))})


def prefill(segs: DataFrame, memory: DataFrame, key: str, least: float = 0.82) -> DataFrame:
    """Segments without a target, frozen ones aside, filled from the memory: by the exact source, else by the best fuzzy hit.

    segs: key, source, lang, target, status, meta (JSON), frozen. memory: one row by (source_key, lang), with entry_id, vector.
    Gives (key, target, status, meta) of those filled: an exact hit keeps a status of translated, any other is needs_review;
    meta gets tm_reused or tm_fuzzy, tm_score, and the source of a fuzzy hit. Ties as in the fuzzy search.
    """
    gaps = segs.filter(~F.coalesce("frozen", F.lit(False)) & (T.text_or_empty(F.col("target")) == "") & (F.col("source") != ""))
    # Read four times below; the segments' table isn't gathered again for each.
    looked = stored(exact(gaps.select(key, "source", "lang", "status", "meta"), memory.select("source_key", "lang", "target")), "looked")
    said = lambda *extra: Q.with_meta(F.col("meta"), F.to_json(F.struct(*extra)))
    hits = looked.filter("tm_target is not null").select(key, F.col("tm_target").alias("target"), F.when(F.col("status") == "translated", "translated").otherwise("needs_review").alias("status"), said(F.lit(True).alias("tm_reused"), F.lit(1.0).alias("tm_score")).alias("meta"))
    rest = looked.filter("tm_target is null").select(F.col(key).alias("query_id"), "source", "lang", S.hashed_vectors("source").alias("vector"))
    best = fuzzy_hybrid(rest, memory, least, 1).withColumnRenamed("query_id", key)
    near = best.join(memory.select("entry_id", F.col("target").alias("found"), F.col("source").alias("of")), "entry_id").filter("found <> ''").join(looked.select(key, "meta"), key)
    fuzzy = near.select(key, F.col("found").alias("target"), F.lit("needs_review").alias("status"), said(F.lit(True).alias("tm_fuzzy"), F.col("score").alias("tm_score"), F.col("of").alias("tm_source")).alias("meta"))
    return hits.unionByName(fuzzy)


def recent(memory: DataFrame, n: int = 10_000) -> DataFrame:
    """The n entries of each language updated last, a null time before all others; ties by the smaller id."""
    w = Window.partitionBy("lang").orderBy(F.desc_nulls_last("updated_at"), "entry_id")
    return memory.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory with the rows of ``new``; both have one schema and ``seq`` orders rows of equal time.

    The spelling of the source stays that of the first row, vectors that are missing are kept from before.
    Rows without source or target are ignored. A new table results; the caller writes it as a new version.
    """
    usable = new.filter("source <> '' and target <> ''")
    whole = memory.withColumn("_new", F.lit(0)).unionByName(usable.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "updated_at", "seq")
    rest = [c for c in memory.columns if c not in ("source_key", "lang", "source", "embedding", "embedding_backend", "seq")]
    vector = F.struct("embedding", "embedding_backend")
    return whole.groupBy("source_key", "lang").agg(
        F.min_by("source", order).alias("source"),
        *[F.max_by(c, order).alias(c) for c in rest],
        F.max_by(vector, F.when(F.col("embedding").isNotNull(), order)).alias("v"),
        F.max_by("seq", order).alias("seq"),
    ).select(*[F.col(f"v.{c}").alias(c) if c.startswith("embedding") else F.col(c) for c in memory.columns])


def author(meta: Column, given: Column | None = None) -> Column:
    said = [F.get_json_object(meta, f"$.{k}") for k in ("author", "auto_translated_by", "provider")]
    return F.coalesce(*([given] if given is not None else []), *said, F.lit("unknown"))


def new_revisions(revisions: DataFrame, new: DataFrame, audit_all: bool = False) -> DataFrame:
    """Revisions to append for ``new``: those that change target or status, or all."""
    made = new.select("source_key", "lang", "target", author(F.col("meta_json")).alias("author"), "status", F.col("updated_at").alias("revised_at"), "meta_json")
    if audit_all:
        return made
    last = latest(revisions.select("source_key", "lang", "revised_at", "id", "target", "status"), ["source_key", "lang"], ["revised_at", "id"])
    same = last.select("source_key", "lang", F.col("target").alias("_target"), F.col("status").alias("_status"))
    joined = made.alias("n").join(same.alias("o"), (F.col("n.source_key") == F.col("o.source_key")) & F.col("n.lang").eqNullSafe(F.col("o.lang")), "left")
    return joined.filter(~(F.col("_target").eqNullSafe(F.col("n.target")) & F.col("_status").eqNullSafe(F.col("n.status")))).select("n.*")


def history(revisions: DataFrame, n: int) -> DataFrame:
    """The last n revisions of each (source_key, lang), rank 1 the newest; a null time is oldest."""
    once = revisions.dropDuplicates(["id"])
    w = Window.partitionBy("source_key", "lang").orderBy(F.desc_nulls_last("revised_at"), F.desc("id"))
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def segment_history(memory: DataFrame, revisions: DataFrame, n: int) -> DataFrame:
    """History by segment id; an id the memory doesn't know has none."""
    known = memory.filter("segment_id is not null").groupBy("segment_id", "lang").agg(F.max_by("source_key", F.struct("updated_at", "source_key")).alias("source_key"))
    return known.join(history(revisions, n), ["source_key", "lang"])


#: Of hashed words and characters: how many bins bound what two texts have in common.
WORD_BINS, SIGN_BINS = 256, 64


def _prepared(df: DataFrame, ident: str, source: str, extra: list[Column | str]) -> DataFrame:
    text = T.normalised(F.col(source))
    return df.select(F.col(ident).cast("long").alias("i"), "lang", text.alias("norm"), F.concat_ws(" ", S.tokens(F.col(source))).alias("words"), *extra).filter("norm <> '' and lang is not null")


def _word_bins(sets: list[set[str]]) -> np.ndarray:
    """How many words of each set fall into each bin. The product of two rows is at least the number of words in common."""
    numbers: dict[str, int] = {}
    at = [[numbers.setdefault(w, len(numbers)) % WORD_BINS for w in s] for s in sets]
    owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
    flat = np.fromiter((b for x in at for b in x), np.int64, len(owner))
    return np.bincount(owner * WORD_BINS + flat, minlength=WORD_BINS * len(at)).reshape(-1, WORD_BINS).astype(np.float32)


def _sign_bins(texts: pd.Series) -> np.ndarray:
    """The number of characters of each text by bin."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % SIGN_BINS
    return np.bincount(np.repeat(np.arange(len(size)), size) * SIGN_BINS + codes, minlength=SIGN_BINS * len(size)).reshape(-1, SIGN_BINS).astype(np.int32)


def _tiles(q_sets: list[set[str]], m_sets: list[set[str]], share: float, vectors: tuple[np.ndarray, np.ndarray] | None, least_product: float):
    """(rows of the left, rows of the right) by tile: the pairs that can have an overlap of words of ``share``, or a product of ``least_product``."""
    both = _word_bins(q_sets + m_sets)
    a, b = both[: len(q_sets)], both[len(q_sets) :]
    n, k = (np.array([len(s) for s in sets], np.float32)[:, None] for sets in (q_sets, m_sets))
    part = np.float32(share / (1 + share))  # of the words of both together
    a, b = np.hstack([a, n, np.ones_like(n)]), np.hstack([b, np.full_like(k, -part), -part * k])
    for lo in range(0, len(b), 8192):
        for at in range(0, len(a), 1024):
            ok = a[at : at + 1024] @ b[lo : lo + 8192].T >= -1e-2
            if vectors is not None:
                ok |= vectors[0][at : at + 1024] @ vectors[1][lo : lo + 8192].T >= least_product - 1e-4
            x, y = np.nonzero(ok)
            yield x + at, y + lo


def _vectors(v: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.zeros(dim, np.float32) if x is None else np.asarray(x, np.float32) for x in v]) if len(v) else np.zeros((0, dim), np.float32)


def _fuzzy(queries: DataFrame, memory: DataFrame, least: float, k: int, semantic: bool) -> DataFrame:
    """(query_id, entry_id, score, rank) by the lexical or the hybrid score.

    Blocks of queries meet chunks of the memory by language, and a task leaves only what may be among the k best: pairs are
    never shuffled. Products of hashed words, lengths, and numbers of characters bound a score from above, which loses
    nothing; pairs are compared from the highest bound down until k are better than what a bound allows.
    """
    zoned = isinstance(memory.schema["updated_at"].dataType, TimestampType)
    time, kind = (F.unix_micros("updated_at"), "bigint") if zoned else (F.col("updated_at"), memory.schema["updated_at"].dataType)
    vector = ["vector"] if semantic else []
    q = _prepared(queries, "query_id", "source", vector)
    m = _prepared(memory, "entry_id", "source", [time.cast("string").alias("t"), *vector])
    a, b = _blocks(q, m, 65536, 65536)
    share = max(0.0, (least - 5e-5 - S.RATIO_SHARE) / S.JACCARD_SHARE)
    length_share = S.shortest_for_lexical(least)
    least_product = (least - 5e-5 - S.LEXICAL_SHARE) / S.SEMANTIC_SHARE
    near = least - 1e-4
    kinds = "query_id long, entry_id long, ratio double, jaccard double, sem double, t string"

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(x) and len(y):
            q_sets, m_sets = ([set(w.split(" ")) - {""} for w in d.words] for d in (x, y))
            dim = max([len(v) for d in (x, y) for v in d.vector if v is not None], default=1) if semantic else 1
            vectors = (_vectors(x.vector, dim), _vectors(y.vector, dim)) if semantic else None
            (h, n), (g, l) = ((_sign_bins(d.norm), np.array([len(t) for t in d.norm], np.int64)) for d in (x, y))
            q_norm, m_norm, q_ids, m_ids, times = x.norm.tolist(), y.norm.tolist(), x.i.tolist(), y.i.tolist(), y.t.tolist()
            found: dict[int, list[tuple[float, int, float, float]]] = {}
            for xs, ys in _tiles(q_sets, m_sets, share, vectors, least_product):
                for lo in range(0, len(xs), 65536):
                    r, c = xs[lo : lo + 65536], ys[lo : lo + 65536]
                    sem = np.einsum("ij,ij->i", vectors[0][r].astype(np.float64), vectors[1][c].astype(np.float64)).clip(0, 1) if semantic else np.zeros(len(r))
                    # Lengths before characters, and these before words: what is left gets dearer.
                    high = 2 * np.minimum(n[r], l[c]) / (n[r] + l[c])
                    best = lambda ratio, jac, sem=sem: np.maximum(lex := S.RATIO_SHARE * ratio + S.JACCARD_SHARE * jac, S.SEMANTIC_SHARE * sem + S.LEXICAL_SHARE * lex if semantic else lex)
                    ok = np.flatnonzero(best(high, 1.0) >= near)
                    r, c, sem = r[ok], c[ok], sem[ok]
                    jac = np.array([s / (len(q_sets[i]) + len(m_sets[j]) - s) if (s := len(q_sets[i] & m_sets[j])) else 0.0 for i, j in zip(r.tolist(), c.tolist(), strict=True)])
                    high = 2 * np.minimum(h[r], g[c]).sum(axis=1) / (n[r] + l[c])
                    bound = best(high, jac, sem)
                    ok = bound >= near
                    for i, u, j, w, s in zip(r[ok].tolist(), bound[ok].tolist(), c[ok].tolist(), jac[ok].tolist(), sem[ok].tolist(), strict=True):
                        found.setdefault(i, []).append((u, j, w, s))
            match, known, last = difflib.SequenceMatcher(None), {}, None
            for i in sorted(found, key=lambda i: q_norm[i]):
                if q_norm[i] != last:
                    last, known = q_norm[i], {}
                    match.set_seq1(last)
                top: list[float] = []
                for u, j, w, s in sorted(found[i], reverse=True):
                    # Scores are rounded to four digits, so what may be equal then stays.
                    if len(top) >= k and u < top[0] - 2e-4:
                        break
                    if (ratio := known.get(m_norm[j])) is None:
                        if m_norm[j] == last:
                            ratio = 1.0
                        else:
                            match.set_seq2(m_norm[j])
                            ratio = match.ratio()
                        known[m_norm[j]] = ratio
                    lex = S.RATIO_SHARE * ratio + S.JACCARD_SHARE * w
                    score = max(lex, S.SEMANTIC_SHARE * s + S.LEXICAL_SHARE * lex) if semantic else lex
                    if score >= near:
                        (heapq.heappush if len(top) < k else heapq.heappushpop)(top, score)
                        out.append((q_ids[i], m_ids[j], ratio, w, s, times[j]))
        return pd.DataFrame(out, columns=["query_id", "entry_id", "ratio", "jaccard", "sem", "t"])

    pairs = a.groupBy("lang", "b", "c").cogroup(b.groupBy("lang", "b", "c")).applyInPandas(compare, kinds)
    lex = S.lexical(F.col("ratio"), F.col("jaccard"))
    score = F.round(S.hybrid(lex, F.col("sem")), 4) if semantic else lex
    return _top(pairs.withColumn("score", score).withColumn("updated_at", F.col("t").cast(kind)).filter(F.col("score") >= least), k)


def fuzzy_lexical(queries: DataFrame, memory: DataFrame, least: float, k: int) -> DataFrame:
    """(query_id, entry_id, score, rank): the k entries of the query's language with the best lexical score.

    Ties: later update, then id. Null or empty sources and null languages match nothing.
    """
    return _fuzzy(queries, memory, least, k, False)


def fuzzy_hybrid(queries: DataFrame, memory: DataFrame, least: float, k: int) -> DataFrame:
    """The same with the hybrid score; both tables bring ``vector`` (unit, or null).

    A pair can qualify by words or by vectors: with the pairs of the lexical search come those whose cosine
    is at least (least - 0.22) / 0.78.
    """
    return _fuzzy(queries, memory, least, k, True)


def fuzzy_vector(queries: DataFrame, memory: DataFrame, least: float, k: int) -> DataFrame:
    """The same by the cosine of the vectors alone."""
    keep = lambda df, ident, *more: df.select(F.col(ident).alias("i"), "lang", F.col("vector").alias("v"), *more)
    q, m = keep(queries, "query_id"), keep(memory, "entry_id", "updated_at")
    pairs = above(q, m.drop("updated_at"), least - 5e-5).filter("query_id <> entry_id")
    both = pairs.join(q.select(F.col("i").alias("query_id"), F.col("v").alias("a")), "query_id").join(m.select(F.col("i").alias("entry_id"), F.col("v").alias("b"), "updated_at"), "entry_id")
    return _top(both.withColumn("score", F.round(S.cosine(F.col("a"), F.col("b")), 4)).filter(F.col("score") >= least), k)


def _bigram_bins(texts: pd.Series, bins: int = 256) -> np.ndarray:
    """The number of each text's pairs of neighbouring characters by bin."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    inside = owner[:-1] == owner[1:]
    at = (owner[:-1] * bins + (codes[:-1] * 31 + codes[1:] * 7) % bins)[inside]
    return np.bincount(at, minlength=bins * len(size)).reshape(-1, bins).astype(np.int32)


def _anchors(text: str) -> str:
    """The characters at which difflib begins a match in its second text: in long ones, those that aren't frequent."""
    if len(text) < 200:
        return text
    most, held = len(text) // 100 + 1, Counter(text)
    return "".join(c for c in text if held[c] <= most)


def _common(masks: dict[str, int], n: int, text: str) -> int:
    """The length of the longest common subsequence with a text of n characters, given by the places of each of them."""
    whole = v = (1 << n) - 1
    for c in text:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & whole
    return n - v.bit_count()


def most_matching(q_bins: tuple[np.ndarray, ...], m_bins: tuple[np.ndarray, ...], n: int, l: np.ndarray) -> np.ndarray:
    """Most characters that difflib can match of one text with each of others. Bins: characters, pairs of them; of the others also anchors.

    M characters in B blocks hold M - B pairs. Between two blocks a character of either text is left, and in a long text
    each block but one at the start holds an anchor, which bounds B.
    """
    signs, pairs = (np.minimum(a, b).sum(axis=1) for a, b in zip(q_bins, m_bins[:2], strict=True))
    anchors = np.minimum(q_bins[0], m_bins[2]).sum(axis=1)
    return np.minimum(np.minimum(signs, (pairs + 1 + n + l) // 3), pairs + anchors + 1)


def fuzzy_ratio(queries: DataFrame, memory: DataFrame, least: float = 0.75, k: int = 5, block: int = 1024) -> DataFrame:
    """(query_id, entry_id, score, rank): the k entries whose source has the highest ratio of matching characters, whatever the language.

    Query blocks meet chunks of the memory. In a task lengths, characters, pairs of characters and then the longest common
    subsequence bound the ratio of a pair from above, which loses nothing; the rest is compared by difflib, from the highest
    bound down until k are better than what a bound allows. Ties by the smaller id; empty sources match nothing.
    """
    text = T.normalised(F.col("source")).alias("v")
    q, m = (df.select(F.col(c).alias("i"), text).filter("v <> ''") for df, c in ((queries, "query_id"), (memory, "entry_id")))
    a, b = _blocks(q, m, block)

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            ids, texts = y.i.tolist(), y.v.tolist()
            l = np.array([len(t) for t in texts], np.int64)
            h, g = (_sign_bins(x.v), _bigram_bins(x.v)), (_sign_bins(y.v), _bigram_bins(y.v), _sign_bins([_anchors(t) for t in texts]))
            match = difflib.SequenceMatcher(None)
            for j, (i, v) in enumerate(zip(x.i.tolist(), x.v.tolist(), strict=True)):
                n = len(v)
                rows = np.flatnonzero(np.minimum(n, l) * 2 >= (n + l) * least - 1e-9)
                rows = rows[2 * np.minimum(h[0][j], g[0][rows]).sum(axis=1) >= (n + l[rows]) * least - 1e-9]
                bound = 2 * most_matching((h[0][j], h[1][j]), tuple(d[rows] for d in g), n, l[rows]) / (n + l[rows])
                near = bound >= least - 1e-9
                masks: dict[str, int] = {}
                for at, c in enumerate(v):
                    masks[c] = masks.get(c, 0) | 1 << at
                match.set_seq1(v)
                known: dict[str, float] = {}
                found, top = [], []
                for u, r in sorted(zip(bound[near].tolist(), rows[near].tolist(), strict=True), key=lambda p: -p[0]):
                    # Ratios are rounded to four digits, so what may be equal then stays.
                    floor = max(least - 1e-9, top[0] - 2e-4) if len(top) >= k else least - 1e-9
                    if u < floor:
                        break
                    if ids[r] == i:
                        continue
                    if (s := known.get(t := texts[r])) is None:
                        if 2 * _common(masks, n, t) / (n + len(t)) < floor:
                            continue
                        # The order of the two matters to the matcher: the query is the first sequence.
                        match.set_seq2(t)
                        s = known[t] = match.ratio()
                    if s >= least:
                        (heapq.heappush if len(top) < k else heapq.heappushpop)(top, s)
                        found.append((-round(s, 4), ids[r]))
                out += [(i, e, -s) for s, e in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "entry_id", "score"])

    near = a.groupBy("b", "c").cogroup(b.groupBy("b", "c")).applyInPandas(compare, "query_id long, entry_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(left: DataFrame, right: DataFrame, block: int, chunk: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out so that every block of the left (b) meets every chunk of the right (c) once; a chunk is eight blocks unless said."""
    blocks = max(1, math.ceil(left.count() / block))
    chunks = max(1, math.ceil(right.count() / (chunk or 8 * block)))
    part = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    # Both sides may come of one table: columns of the same identity would be dropped where the result's aren't read.
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    a = left.withColumn("b", part(blocks)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return a, right.withColumn("c", part(chunks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def above(queries: DataFrame, rows: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """(query_id, entry_id) of one language whose unit vectors (i, lang, v) have a product of at least ``least``."""
    a, b = _blocks(queries.filter("v is not null"), rows.filter("v is not null"), block)

    def multiply(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "entry_id": []}, dtype="int64")
        x, y = np.nonzero(np.stack(q.v.to_numpy()).astype(np.float64) @ np.stack(r.v.to_numpy()).astype(np.float64).T >= least - 1e-6)
        return pd.DataFrame({"query_id": q.i.to_numpy()[x], "entry_id": r.i.to_numpy()[y]})

    return a.groupBy("lang", "b", "c").cogroup(b.groupBy("lang", "b", "c")).applyInPandas(multiply, "query_id long, entry_id long")


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), "entry_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "entry_id", "score", "rank")


def exact_nearest(rows: DataFrame, ident: str, vector: str, k: int, dim: int, every: int = 50, block: int = 2048) -> DataFrame:
    """(query_id, entry_id, cosine, rank): for ids divisible by ``every``, the k nearest of all usable vectors, exactly.

    Query blocks meet chunks of rows: each task multiplies one block by one chunk and keeps k of it, and the
    chunks' lists are merged. Nothing is broadcast; memory is a block and a chunk, whatever the table's size.
    """
    base = rows.filter(S.usable(vector, dim) & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    left, right = _blocks(base.filter(F.col("i") % every == 0), base, block)

    def multiply(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "entry_id": [], "cosine": []}).astype({"query_id": "int64", "entry_id": "int64", "cosine": "float64"})
        r = r.sort_values("i")
        x, y = (np.stack(d.v.to_numpy()) for d in (q, r))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        s = x @ y.T
        ids = r.i.to_numpy()
        s[q.i.to_numpy()[:, None] == ids[None, :]] = -9
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(q.i.to_numpy(), top.shape[1]), "entry_id": ids[top].ravel(), "cosine": np.take_along_axis(s, top, 1).ravel()})
        return out[out.cosine > -5]

    near = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(multiply, "query_id long, entry_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "entry_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def by_words(rows: DataFrame, least: int, of: int, every: int = 50) -> DataFrame:
    """(query_id, entry_id, shared, together): pairs of one language that share at least least/of of their different words.

    Queries are the ids divisible by ``every``. Blocks of queries meet chunks of the rows by language; products of hashed
    words bound the words in common from above, and the rest is counted. Only pairs found leave a task.
    """
    words = rows.filter("source is not null and lang is not null").select(F.col("entry_id").cast("long").alias("i"), "lang", F.concat_ws(" ", S.tokens(F.col("source"))).alias("words")).filter("words <> ''")
    a, b = _blocks(words.filter(F.col("i") % every == 0), words, 65536, 65536)

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(x) and len(y):
            q_sets, m_sets = ([set(w.split(" ")) for w in d.words] for d in (x, y))
            q_ids, m_ids = x.i.tolist(), y.i.tolist()
            for xs, ys in _tiles(q_sets, m_sets, least / of, None, 0.0):
                for i, j in zip(xs.tolist(), ys.tolist(), strict=True):
                    shared = len(q_sets[i] & m_sets[j])
                    together = len(q_sets[i]) + len(m_sets[j]) - shared
                    if shared * of >= together * least and q_ids[i] != m_ids[j]:
                        out.append((q_ids[i], m_ids[j], shared, together))
        return pd.DataFrame(out, columns=["query_id", "entry_id", "shared", "together"])

    return a.groupBy("lang", "b", "c").cogroup(b.groupBy("lang", "b", "c")).applyInPandas(compare, "query_id long, entry_id long, shared long, together long")


def backfill(memory: DataFrame) -> DataFrame:
    """Vectors for entries that lack one; the others aren't computed again."""
    lacking = memory.filter("embedding is null").withColumns({"embedding": S.hashed_vectors("source"), "embedding_backend": F.lit("hash-ngram")})
    return memory.filter("embedding is not null").unionByName(lacking)
