"""Connected components against union-find."""

import random

import pytest

from trialweave.llm.graph import components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


RNG = random.Random(1)


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1)],
        [(-5, 0), (0, 7), (7, -5), (0, 7)],
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(50)] + [(100 + i, 101 + i) for i in range(5)],
        [(RNG.randrange(400), RNG.randrange(400)) for _ in range(220)],
    ],
    ids=["empty", "loop", "cycle", "chain", "hub", "random"],
)
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len(brute(edges))
    assert {r["node"]: r["component"] for r in got} == brute(edges)
