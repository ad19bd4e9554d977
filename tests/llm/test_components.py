"""Connected components: chains, hubs, rings, nulls, repeated edges and none."""

import pytest
from lucera.llm.common import Work
from lucera.llm.components import connected


def found(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["root"] for r in connected(spark, df, Work(spark, "components")).collect()}


def expected(edges):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            label[q] = p
    return {x: find(x) for x in label}


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1), (None, 2), (3, None), (None, None)],
        [(k, k + 1) for k in range(60)],
        [(0, k) for k in range(1, 80)] + [(80, 79), (100, 101), (101, 100), (100, 101)],
        [(-5, 3), (3, 9), (9, -5), (7, 8), (8, 20), (20, 7), (2**62, -(2**62))],
        [(k, k * 7 % 50) for k in range(50)],
    ],
)
def test_components(spark, edges):
    assert found(spark, edges) == expected(edges)
