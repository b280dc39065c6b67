import random

import pytest

from risklake.llm.components import components


def roots(pairs):
    parent = {n: n for p in pairs for n in p}
    for _ in parent:
        for a, b in pairs:
            least = min(parent[a], parent[b])
            parent[a] = parent[b] = least
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    return {n: parent[n] for n in linked}


@pytest.mark.parametrize("pairs", [[(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 50), (50, 51), (7, 7), (90, 90)], [(-5, 2**62), (2**62, -(2**62))]])
def test_chains_stars_loops_and_large_ids(spark, pairs):
    edges = spark.createDataFrame([(*p, 1) for p in pairs], "a long, b long, root int").repartition(3)
    assert {r["node"]: r["root"] for r in components(edges).collect()} == roots(pairs)


def test_random_graphs_null_ends_and_no_edges(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = spark.createDataFrame([*pairs, (None, 3), (4, None), (None, None)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == roots(pairs)
    assert components(edges.limit(0)).collect() == []
