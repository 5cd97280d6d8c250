import random

from verbaloom.llm.graph import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(17)]
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    got = {x.node: x.component for x in connected_components(df, "a", "b").collect()}
    assert got == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
