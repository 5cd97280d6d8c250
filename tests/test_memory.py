import difflib
import random

from pyspark.sql import functions as F

from verbaloom.functions import similarity as S
from verbaloom.operators import memory as M


def lex(a, b):
    n = lambda s: " ".join(s.split())
    r = difflib.SequenceMatcher(None, n(a), n(b)).ratio()
    x, y = set(n(a).lower().split()), set(n(b).lower().split())
    return round(0.72 * r + 0.28 * (len(x & y) / len(x | y) if x and y else 0), 4)


def corpus(n, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("the a red green house tree saves opens reads file page list".split()) for _ in range(r.randrange(3, 12))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        if r.random() < 0.6:
            w[r.randrange(len(w))] = r.choice(["blue", "house", "x"])
        out.append((i, " ".join(w), r.choice(["de", "en"])))
    return out


def frames(spark, data):
    mem = spark.createDataFrame([(i, s, lang, 1) for i, s, lang in data] + [(900, None, "de", 1), (901, "", "de", 1), (902, "x", None, 1)], "entry_id long, source string, lang string, updated_at int")
    return mem.filter("entry_id % 4 = 0").withColumnRenamed("entry_id", "query_id"), mem


def test_fuzzy_lexical_equals_all_pairs(spark):
    data = corpus(90, 3)
    q, mem = frames(spark, data)
    for least in (0.55, 0.82):
        got = {(r.query_id, r.entry_id): r.score for r in M.fuzzy_lexical(q, mem, least, 1000).collect()}
        want = {(i, j): lex(a, b) for i, a, la in data if i % 4 == 0 for j, b, lb in data if la == lb and lex(a, b) >= least}
        assert got == want


def test_fuzzy_hybrid_equals_all_pairs(spark):
    data = corpus(60, 4)
    q, mem = frames(spark, data)
    got = {(r.query_id, r.entry_id): r.score for r in M.fuzzy_hybrid(q.withColumn("vector", S.hashed_vectors("source")), mem.withColumn("vector", S.hashed_vectors("source")), 0.7, 1000).collect()}
    v = {i: S.hashed_vector(s) for i, s, _ in data}
    want = {}
    for i, a, la in data:
        for j, b, lb in data:
            if i % 4 == 0 and la == lb:
                sem = max(0.0, min(1.0, sum(x * y for x, y in zip(v[i], v[j]))))
                score = round(max(lex(a, b), 0.78 * sem + 0.22 * lex(a, b)), 4)
                if score >= 0.7:
                    want[i, j] = score
    assert set(got) >= {k for k, s in want.items() if s > 0.7001} and all(abs(got[k] - want.get(k, 0.7)) < 2e-4 for k in got)


def test_top_k_ties_by_update_then_id(spark, rows):
    mem = spark.createDataFrame([(1, "same text", "de", 5), (2, "same text", "de", 9), (3, "same text", "de", 9), (4, "same text", "de", None)], "entry_id long, source string, lang string, updated_at int")
    got = M.fuzzy_lexical(mem.filter("entry_id = 1").withColumnRenamed("entry_id", "query_id"), mem, 0.9, 3)
    assert [r.entry_id for r in got.orderBy("rank").collect()] == [2, 3, 1]


COLS = "source_key string, source string, target string, lang string, kind string, segment_id string, status string, updated_at int, meta_json string, embedding array<float>, embedding_backend string, seq long"


def test_upsert(spark):
    old = spark.createDataFrame([("k", "First", "a", "de", "p", "s", "translated", 9, "{}", [1.0], "h", 1)], COLS)
    new = spark.createDataFrame([("k", "first", "b", "de", "p", "s", "needs_review", 5, "{}", None, None, 2), ("k", "first", "c", "de", "p", "s", "x", 5, "{}", None, None, 3), ("m", "n", "o", "de", "p", "s", "x", 1, "{}", None, None, 4), ("q", "", "o", "de", "p", "s", "x", 1, "{}", None, None, 5)], COLS)
    got = {r.source_key: r for r in M.upsert(old, new).collect()}
    assert (got["k"].source, got["k"].target, got["k"].embedding, got["k"].embedding_backend) == ("First", "c", [1.0], "h")
    assert set(got) == {"k", "m"} and got["m"].embedding is None
    assert M.upsert(old.limit(0), new.limit(0)).count() == 0


def test_history_and_new_revisions(spark, rows):
    rev = spark.createDataFrame([(1, "k", "de", "a", 1, "x"), (2, "k", "de", "b", 3, "x"), (2, "k", "de", "b", 3, "x"), (3, "k", "de", "c", None, "x"), (4, "k", None, "d", 2, "x")], "id long, source_key string, lang string, target string, revised_at int, status string")
    assert rows(M.history(rev, 2).select("id", "rank")) == [(1, 2), (2, 1), (4, 1)]
    new = spark.createDataFrame([("k", "de", "b", "x", 9, '{"author": "me"}'), ("k", "de", "z", "x", 9, "{}"), ("k", None, "d", "x", 9, None)], "source_key string, lang string, target string, status string, updated_at int, meta_json string")
    assert rows(M.new_revisions(rev, new).select("target", "author")) == [("z", "unknown")]
    assert M.new_revisions(rev, new, audit_all=True).count() == 3
    mem = spark.createDataFrame([("k", "de", "s1", 1), ("k", "de", None, 1)], "source_key string, lang string, segment_id string, updated_at int")
    assert rows(M.segment_history(mem, rev, 1).select("segment_id", "id")) == [("s1", 2)]


def test_exact(spark):
    import hashlib

    mem = spark.createDataFrame([(hashlib.sha256(b"a b").hexdigest(), "de", "T")], "source_key string, lang string, target string")
    segs = spark.createDataFrame([(1, " a \n b", "de"), (2, "a b", "en"), (3, None, "de"), (4, "a b", None)], "i int, source string, lang string")
    assert {r.i: r.tm_target for r in M.exact(segs, mem).collect()} == {1: "T", 2: None, 3: None, 4: None}


def test_exact_nearest_and_words_equal_brute_force(spark):
    import numpy as np

    g = np.random.default_rng(1)
    x = g.standard_normal((120, 8))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0])]
    df = spark.createDataFrame(data, "entry_id long, v array<double>")
    got = {(r.query_id, r.rank): r.entry_id for r in M.exact_nearest(df, "entry_id", "v", 3, 8, every=10, block=5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(i, k + 1): int(j) for i in range(0, 120, 10) for k, j in enumerate(np.argsort(-s[i])[:3])}
    words = corpus(80, 9)
    rows_ = spark.createDataFrame([(i, t, lang) for i, t, lang in words] + [(990, None, "de"), (991, " ", "de")], "entry_id long, source string, lang string")
    got = {(r.query_id, r.entry_id): (r.shared, r.together) for r in M.by_words(rows_, 1, 3, every=5).collect()}
    sets = {i: set(t.split()) for i, t, _ in words}
    want = {(i, j): (len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i, _, a in words for j, _, b in words if i % 5 == 0 and i != j and a == b and 3 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    assert got == want


def test_backfill(spark):
    df = spark.createDataFrame([(1, "a", None, None), (2, "b", [1.0], "m")], "i int, source string, embedding array<float>, embedding_backend string")
    got = {r.i: (len(r.embedding), r.embedding_backend) for r in M.backfill(df).collect()}
    assert got == {1: (96, "hash-ngram"), 2: (1, "m")} and F is not None


def test_ratio_alone_equals_a_plain_search(spark):
    data = corpus(120, 9) + [(500, "", "de"), (501, None, "de"), (502, "  ", None)]
    df = spark.createDataFrame([(*d, 0) for d in data], "entry_id long, source string, lang string, score int")
    q = df.filter("entry_id % 5 = 0").withColumnRenamed("entry_id", "query_id")
    n = lambda s: " ".join(s.split())
    want = []
    for i, a, _ in data:
        if i % 5 == 0 and a and n(a):
            scored = sorted((-round(s, 4), j) for j, b, _ in data if j != i and b and n(b) and (s := difflib.SequenceMatcher(None, n(a), n(b)).ratio()) >= 0.75)[:5]
            want += [(i, j, -s, k) for k, (s, j) in enumerate(scored, 1)]
    got = sorted(map(tuple, M.fuzzy_ratio(q, df, 0.75, 5, block=16).select("query_id", "entry_id", "score", "rank").collect()))
    assert got == sorted(want) and want
    assert M.fuzzy_ratio(q.limit(0), df).count() == 0


def test_vectors_alone_pack_and_recency(spark):
    df = spark.createDataFrame([(0, "de", [1.0, 0.0], 1), (1, "de", [0.96, 0.28], 2), (2, "de", [0.6, 0.8], 3), (3, "en", [1.0, 0.0], 9), (4, "de", None, None)], "entry_id long, lang string, vector array<float>, updated_at int")
    got = M.fuzzy_vector(df.withColumnRenamed("entry_id", "query_id"), df, 0.9, 3)
    assert sorted((r.query_id, r.entry_id, r.score) for r in got.collect()) == [(0, 1, 0.96), (1, 0, 0.96)]
    both = df.withColumn("p", S.packed("vector")).withColumn("u", S.unpacked("p")).collect()
    assert [r.u for r in both] == [r.vector for r in both] and len(both[0].p) == 8
    assert sorted((r.entry_id, r["rank"]) for r in M.recent(df, 2).collect()) == [(1, 2), (2, 1), (3, 1)]


def test_prefill_takes_exact_before_fuzzy(spark):
    import json

    from verbaloom.functions import text as T

    memory = spark.createDataFrame([(1, "Open the file menu now", "Datei", "de", 1), (2, "Open the file menu today and wait", "Heute", "de", 2), (3, "Empty", "", "de", 3)], "entry_id long, source string, target string, lang string, updated_at int")
    memory = memory.withColumns({"source_key": T.source_key(F.col("source")), "vector": S.hashed_vectors("source")})
    segs = [(10, "Open  the file menu now", "de", "", "translated", '{"level": 1}', False), (11, "Open the file menu today and wait!", "de", None, None, None, False), (12, "Quite different", "de", "", "new", "{}", False), (13, "Open the file menu now", "de", "", "new", "{}", True), (14, "Open the file menu now", "en", "", "new", "{}", None), (15, None, "de", None, None, None, None), (16, "Empty", "de", "", "new", "{}", False)]
    df = spark.createDataFrame(segs, "pair_id long, source string, lang string, target string, status string, meta string, frozen boolean")
    got = {r.pair_id: r for r in M.prefill(df, memory, "pair_id").collect()}
    assert set(got) == {10, 11} and (got[10].target, got[10].status) == ("Datei", "translated") and json.loads(got[10].meta) == {"level": 1, "tm_reused": True, "tm_score": 1.0}
    assert (got[11].target, got[11].status) == ("Heute", "needs_review") and json.loads(got[11].meta)["tm_source"] == "Open the file menu today and wait"


def test_edits_reach_the_first_entry_of_each_document(spark):
    from verbaloom.operators import catalogue as C

    rows = [("a", "de", 0, "x", "t", "new"), ("a", "de", 1, "x", "t", "new"), ("b", "de", 0, "x", None, None), ("a", "en", 0, "x", "t", "new"), ("a", "de", 2, None, "t", "new")]
    cat = spark.createDataFrame(rows, "doc_path string, lang string, ord int, id string, target string, status string")
    edits = spark.createDataFrame([("x", "de", "N", None), ("none", "de", "N", None), (None, "de", "N", "new")], "id string, lang string, target string, status string")
    assert sorted((r.doc_path, r.ord, r.target, r.status) for r in C.edited(cat, edits).collect()) == [("a", 0, "N", "translated"), ("b", 0, "N", "translated")]
    after = {(r.doc_path, r.lang, r.ord): (r.target, r.status) for r in C.with_edits(cat, edits).collect()}
    assert len(after) == 5 and after["a", "de", 0] == ("N", "translated") and after["a", "de", 1] == ("t", "new") and after["a", "en", 0] == ("t", "new") and after["b", "de", 0] == ("N", "translated")
    assert C.with_edits(cat, edits.limit(0)).count() == 5


def test_the_dashboard_shows_shares(spark):
    from verbaloom.operators import catalogue as C

    pages = spark.createDataFrame([("a<b", 1, 2, 1, 4, 3)], "doc_path string, translated int, missing int, needs_review int, total int, lint_issues int")
    page = C.dashboard(pages, "de")
    assert "a&lt;b" in page and "<dd>25.0%</dd>" in page and "<dd>50.0%</dd>" in page and "<dt>QA warnings</dt><dd>3</dd>" in page and "value='25.0'" in page
    assert "0.0%" in C.dashboard(pages.limit(0), "de")


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_searches_never_shuffle_pairs(spark):
    """All texts of a language share most words, so nearly all pairs meet; what is written follows the rows."""
    r = random.Random(8)
    words = "the a red green house tree saves opens reads file page list".split()
    texts = [(i, " ".join(r.sample(words, 6)), "de", 1) for i in range(1500)]
    mem = spark.createDataFrame(texts, "entry_id long, source string, lang string, updated_at int")
    q = mem.filter("entry_id % 4 = 0").withColumnRenamed("entry_id", "query_id")
    vector = S.hashed_vectors("source")
    for search in (
        lambda: M.by_words(mem, 1, 3, every=4),
        lambda: M.fuzzy_lexical(q, mem, 0.82, 3),
        lambda: M.fuzzy_hybrid(q.withColumn("vector", vector), mem.withColumn("vector", vector), 0.82, 3),
    ):
        before = written(spark)
        assert search().count() > 400
        assert written(spark) - before < 1_500_000, written(spark) - before


def test_bounds_of_the_matcher_hold_and_are_close(spark):
    """No pair matches more than its bounds, also in long texts with frequent characters; most unlike pairs never reach difflib."""
    import numpy as np
    import pandas as pd

    r = random.Random(5)
    words = "der die das und Öffnen speichern Übersicht Datei lesen schreiben Wörter x y kenortana `a/b.md` 82 Minuten the file reads lines".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(80)]
    texts += [t[:k] + "qq" + t[k:] for t in texts for k in [r.randrange(len(t))]] + ["a" * 250, "ab" * 150, "a" * 199]
    s = pd.Series(texts)
    signs, pairs, anchors, l = M._sign_bins(s), M._bigram_bins(s), M._sign_bins(pd.Series([M._anchors(t) for t in texts])), np.array([len(t) for t in texts])
    left = 0
    for j, v in enumerate(texts):
        most = M.most_matching((signs[j], pairs[j]), (signs, pairs, anchors), len(v), l)
        masks = {c: sum(1 << k for k, x in enumerate(v) if x == c) for c in set(v)}
        for i, t in enumerate(texts):
            real = sum(b.size for b in difflib.SequenceMatcher(None, v, t).get_matching_blocks())
            assert real <= most[i] and real <= M._common(masks, len(v), t)
            left += 2 * min(most[i], M._common(masks, len(v), t)) >= 0.75 * (len(v) + len(t))
    assert left < 0.1 * len(texts) ** 2
