import numpy as np

from verbaloom.llm import neighbours as N

DIM = 16


def frame(spark, vectors, extra=()):
    rows = [(i, [float(x) for x in v], "x", -1) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "entry_id long, vec array<float>, g string, id int")


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_on_clusters_in_small_blocks(spark):
    g = np.random.default_rng(0)
    x = np.concatenate([g.standard_normal(DIM) * 3 + g.standard_normal((30, DIM)) * 0.5 for _ in range(60)])
    df = frame(spark, x, [(9001, None, "x", 1), (9002, [1.0], "x", 1), (9003, [0.0] * DIM, "x", 1), (9004, [float("nan")] + [1.0] * (DIM - 1), "x", 1), (9005, [float("inf")] * DIM, "x", 1), (None, [1.0] * DIM, "x", 1), (0, [float(v) for v in x[0]], "y", 2)])
    got = N.nearest(df, "entry_id", "vec", k=5, dim=DIM, block=100, segment=400, sample=600).collect()
    assert len(got) == 5 * len(x)
    true = {(i, int(j)) for i, r in enumerate(brute(x, 5)) for j in r}
    assert len({(r.id, r.neighbour) for r in got} & true) >= 0.9 * len(true)
    assert all(r.id != r.neighbour and -1 <= r.cosine <= 1 for r in got)
    again = {(r.id, r.neighbour) for r in N.nearest(df, "entry_id", "vec", k=5, dim=DIM, block=100, segment=400, sample=600).collect()}
    assert again == {(r.id, r.neighbour) for r in got}


def test_a_third_of_equal_vectors(spark):
    g = np.random.default_rng(1)
    x = np.concatenate([np.tile(g.standard_normal(DIM), (200, 1)), g.standard_normal((400, DIM))])
    got = N.nearest(frame(spark, x), "entry_id", "vec", k=3, dim=DIM, block=48, segment=64, sample=300).collect()
    hot = [r for r in got if r.id < 200]
    assert len(hot) == 600 and all(r.cosine > 0.9999 for r in hot)


def test_few_rows_and_empty(spark):
    df = frame(spark, np.eye(DIM)[:3])
    assert {(r.entry_a, r.entry_b) for r in N.neighbour_pairs(df, "entry_id", "vec", k=5, dim=DIM).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert N.nearest(df.limit(0), "entry_id", "vec", dim=DIM).count() == 0
    assert N.nearest(df.limit(1), "entry_id", "vec", dim=DIM).count() == 0


def forest(x, rows, block, segment, seed=3):
    u, w = np.unique(x[rows], axis=0, return_counts=True)
    return N.Forest([N.Tree(u, w, 32, seed + i) for i in range(4)], len(x) / len(rows), block, segment)


def test_strings_are_one_sorted_array_of_segments():
    g = np.random.default_rng(2)
    x = N._unit([r for r in g.standard_normal((4000, DIM))], DIM)
    for names, key, length in forest(x, np.arange(500), 100, 400).places(x, np.arange(len(x))):
        order = np.argsort(key, kind="stable")
        changes = np.count_nonzero(np.array(names)[order][1:] != np.array(names)[order][:-1])
        sizes = np.unique(names, return_counts=True)[1]
        assert changes == len(sizes) - 1 and sizes.max() <= 1600 and len(sizes) >= 8 and (key >= 0).all() and length.min() >= 0


def test_all_trees_ascend_together():
    sizes = [np.array([[100, 60, 20, 4]]), np.array([[100, 30, 10, 5]])]
    assert [int(N.ascent(sizes, n)[0]) for n in (9, 10, 30, 31, 90, 91, 999)] == [3, 2, 2, 1, 1, 0, 0]


def test_runs_follow_the_counts_of_the_array():
    key = np.sort(np.random.default_rng(0).integers(0, 1 << 62, 4096))
    for length, low, high in ((7, 20, 50), (0, 40, 128), (40, 8, 128)):
        lo, hi = N._runs(key, np.full(4096, length), 32)
        at = np.arange(4096)
        assert (lo <= at).all() and (at < hi).all() and (hi - lo <= high).all() and np.median(hi - lo) >= low
    lo, hi = N._runs(np.full(1000, 5, np.int64), np.full(1000, 62), 32)
    assert (lo <= np.arange(1000)).all() and (np.arange(1000) < hi).all() and (hi - lo).max() <= 64


def test_recall_of_different_vectors_beside_copies():
    for share in (0.05, 0.2, 0.4):
        for seed in range(10):
            g = np.random.default_rng(seed)
            x = np.concatenate([c + g.standard_normal((20, DIM)) * 0.3 for c in g.standard_normal((60, DIM))])
            x = np.concatenate([x, np.tile(x[7], (int(len(x) * share / (1 - share)), 1))])
            x, ids = N._unit(list(x), DIM), g.permutation(len(x))
            best = {i: {} for i in ids}
            for names, key, length in forest(x, g.permutation(len(x))[: len(x) // 2], 64, 256, seed).places(x, ids):
                names = np.array(names)
                for s in np.unique(names):
                    r = np.flatnonzero(names == s)
                    assert len(r) <= 1024
                    for i, near, cos in N._search(key[r], length[r], ids[r], x[r], 5, 64).itertuples(index=False):
                        best[i].update(zip(near, cos, strict=True))
            s = x[:1200] @ x.T
            s[np.arange(1200), np.arange(1200)] = -9
            kth = np.sort(s, axis=1)[:, -5]
            hits = sum(sum(c >= kth[j] - 1e-5 for c in sorted(best[ids[j]].values())[-5:]) for j in range(1200))
            assert hits >= 0.95 * 6000, (share, seed, hits)


def test_segments_that_hold_too_many_are_divided(spark):
    """A copied vector that the sample misses is found by the counts."""
    g = np.random.default_rng(4)
    x = np.concatenate([g.standard_normal((300, DIM)), np.tile(g.standard_normal(DIM), (700, 1))])
    got = N.nearest(frame(spark, x), "entry_id", "vec", k=3, dim=DIM, block=16, segment=16, sample=40).collect()
    assert len(got) == 3000 and all(r.cosine > 0.9999 for r in got if r.id >= 300)
    f = forest(x, np.arange(200), 16, 16)
    f.split = [{f.places(x, np.arange(1000))[0][0][-1]: 700}]
    parts = np.unique(f.places(x, np.arange(1000))[0][0])
    assert any("." in p for p in parts)


def test_recall_holds_as_a_collection_grows(spark):
    """Ten times the vectors in as many clusters; fixed sizes find too little."""
    g = np.random.default_rng(6)
    x = np.concatenate([c + g.standard_normal((800, DIM)) * 0.3 for c in g.standard_normal((10, DIM))])
    best = brute(x, 5)
    for usual, held in ((100, True), (len(x), False)):
        got = N.nearest(frame(spark, x), "entry_id", "vec", k=5, dim=DIM, block=48, segment=512, sample=512, usual=usual).collect()
        hits = sum(r.neighbour in best[r.id] for r in got)
        assert (hits >= 0.9 * 5 * len(x)) == held, (usual, hits / 5 / len(x))
