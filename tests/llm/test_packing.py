from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbaloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 60), max_size=60), st.sampled_from([[2048], [512, 2048], [2048, 4096], [2500]]))
def test_every_length_is_placed_once(sizes, caps):
    made = P.plan(dict(sizes), caps)
    placed = Counter()
    for cap, lengths, n in made:
        assert 0 < sum(lengths) <= cap and n > 0
        for s in lengths:
            placed[s] += n
    assert placed == Counter(sizes)
    table = P.places(made)
    for s, g in table.groupby("length"):
        starts = g.start.tolist()
        assert starts[0] == 0 and starts == sorted(starts)


def test_little_is_left_unused():
    sizes = {s: 1 + 4000 // s for s in range(20, 513)}
    made = P.plan(sizes, [512])
    used = sum(s * n for s, n in sizes.items()) / sum(512 * n for *_, n in made)
    assert used > 0.99


def test_combinations_fill_exactly():
    c = P.combinations(129)
    assert (c.sum(1) == P.UNITS).all() and (c[:, 0] >= 129).all() and len({tuple(x) for x in c.tolist()}) == len(c)


def test_pack(spark):
    text = "one two three four five six seven eight nine ten "
    rows = [(i, text * (1 + i % 7), "c") for i in range(80)] + [(900, None, "c"), (901, "", "c"), (902, text * 60, "c"), (902, text * 60, "c"), (None, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container_id string")
    out = P.pack(df, "doc_id", "text", [64, 128]).collect()
    load, cap, parts = Counter(), {}, defaultdict(list)
    for r in out:
        load[r.container_id] += r.tokens
        assert cap.setdefault(r.container_id, r.capacity) == r.capacity
        parts[r.doc_id].append((r.part, r.first_token, r.tokens))
    assert all(load[c] <= cap[c] for c in cap) and set(parts) == {*range(80), 902}
    assert all(cap[c] == 128 or load[c] <= 64 for c in cap) and all(cap[c] == 64 or load[c] > 64 for c in cap)
    assert all(len(v) == 1 for k, v in parts.items() if k != 902)
    pieces = sorted(parts[902])
    assert len(pieces) > 1 and all(t == 128 for *_, t in pieces[:-1]) and [f for _, f, _ in pieces] == [128 * k for k in range(len(pieces))]
    fill = P.fill(P.pack(df, "doc_id", "text", [64, 128])).collect()
    assert all(0.5 < r.used_share <= 1 for r in fill)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(df, "doc_id", "text", [64]).count() == 0 and P.pack(df, "doc_id", "text", []).count() == 0
    with pytest.raises(ValueError, match="positive"):
        P.pack(df, "doc_id", "text", [0])
