import random

import pytest

from rankloom.llm.components import components


def expected(edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {x: root(x) for x in parent}


@pytest.mark.parametrize(
    "edges",
    [
        [(k, k + 1) for k in range(60)],
        [(k + 1, k) for k in range(60)] + [(3, 3), (99, 99)],
        [(500, k) for k in range(200)] + [(500, 500)],
        [(a, b) for a in range(12) for b in range(12)],
        [(-(2**62), 2**62), (2**62, 7), (7, 7)],
    ],
)
def test_shapes(spark, edges):
    frame = spark.createDataFrame(edges, "u long, v long")
    rows = components(frame).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == expected(edges)


def test_random_graph_and_no_edges(spark):
    source = random.Random(4)
    edges = [(source.randrange(900), source.randrange(900)) for _ in range(700)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == expected(edges)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
