import math
import random
from collections import Counter

import numpy as np

from verbaloom.llm import fuzzy as Z


def test_the_code_is_perfect():
    to = Z.decoder()
    assert (to >= 0).all() and (np.bincount(to) == 2048).all()


def test_two_errors_share_a_key():
    g = np.random.default_rng(0)
    v = g.integers(0, 1 << 23, 300)
    for flips in ((), (3,), (0, 22), (5, 17)):
        w = v.copy()
        for b in flips:
            w ^= 1 << b
        a, b = (dict() for _ in range(2))
        for own, x in ((a, v), (b, w)):
            for r, k in zip(*Z.golay_keys(x)):
                own.setdefault(int(r), set()).add(int(k))
        assert all(a[i] & b[i] for i in range(len(v)))
    assert {len(x) for x in a.values()} <= {1, 6}


WORDS = [f"w{i}" for i in range(400)]


def corpus(n, seed):
    r = random.Random(seed)
    out, i = [], 0
    while i < n:
        base = [r.choice(WORDS) for _ in range(r.randrange(20, 50))]
        for _ in range(r.randrange(1, 4)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            if r.random() < 0.3:
                r.shuffle(w)
            half = len(w) // 2
            out.append((i, " ".join(w[:half]), ", ".join(w[half:])))
            i += 1
    return out


def brute(rows):
    c = {i: Counter(Z.words_of(f"{a or ''} {b or ''}")) for i, a, b in rows}
    out = set()
    for i in c:
        for j in c:
            if i < j and c[i] and c[j]:
                n = (c[i] & c[j]).total()
                if 5 * n >= 4 * (c[i].total() + c[j].total() - n):
                    out.add((i, j))
    return out


def test_pairs_equal_brute_force(spark):
    rows = corpus(150, 1) + [(900, None, None), (901, "", " .,!"), (902, "w1 w2", None), (903, "W1", "W2"), (903, "W1", "W2"), (None, "w1 w2", "")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "id long, text string, target string, cls int, key string")
    got = {tuple(r) for r in Z.duplicate_pairs(df, "id", ["text", "target"], tables=10).collect()}
    true = brute([r for r in rows if r[0] is not None])
    assert got <= true and len(got) >= 0.98 * len(true) and (902, 903) in got


def test_copies_form_one_class(spark):
    text = " ".join(WORDS[:30])
    rows = [(i, text) for i in range(60)] + [(100, text + " extra"), (200, " ".join(WORDS[100:130]))]
    df = spark.createDataFrame(rows, "entry_id long, t string")
    members, links = Z.near_duplicates(df, "entry_id", ["t"])
    assert links.count() == 1 and members.count() == 62
    assert Z.duplicate_pairs(df, "entry_id", ["t"]).count() == math.comb(61, 2)
    groups = {r.entry_id: (r.group_id, r.links) for r in Z.duplicate_groups(df, "entry_id", ["t"]).collect()}
    assert set(groups) == {*range(60), 100} and set(groups.values()) == {(0, 1)}


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    assert Z.duplicate_pairs(df.limit(0), "id", ["t"]).count() == 0 and Z.duplicate_groups(df.limit(0), "id", ["t"]).count() == 0
    long = " ".join(WORDS * 100)
    two = spark.createDataFrame([(1, long), (2, long + " tail")], "id long, t string")
    assert Z.duplicate_pairs(two, "id", ["t"]).count() == 1


def test_crowded_keys_are_divided_without_a_loss(spark):
    rows = [r for r in corpus(90, 4)]
    df = spark.createDataFrame(rows, "id long, text string, target string")
    whole = {tuple(r) for r in Z.duplicate_pairs(df, "id", ["text", "target"]).collect()}
    assert whole and whole == {tuple(r) for r in Z.duplicate_pairs(df, "id", ["text", "target"], crowd=2).collect()}
    assert whole == {tuple(r) for r in Z.duplicate_pairs(df, "id", ["text", "target"], crowd=1, small=0).collect()}
