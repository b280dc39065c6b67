"""Graph searches on random and hand-made graphs against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from risklake import registry
from risklake.operators import graph, insights


def edges_of(spark, pairs, kind="imports"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src long, dst long, type string")


def reach(pairs, root, depth=10**9):
    found, frontier, k = {root: 0}, {root}, 0
    while frontier and k < depth:
        k += 1
        frontier = {b for a, b in pairs if a in frontier} - set(found)
        found |= dict.fromkeys(frontier, k)
    return found


def test_bfs_with_more_roots_than_one_mask_has(spark):
    rng = random.Random(1)
    pairs = {(rng.randrange(120), rng.randrange(120)) for _ in range(260)}
    seeds = spark.createDataFrame([(r, r) for r in range(100)] + [(5, 7)], "root long, node long")
    got = sorted(map(tuple, graph.bfs(edges_of(spark, pairs), seeds, 4).collect()))
    want = []
    for r in range(100):
        best = reach(pairs, r, 4)
        if r == 5:
            for n, k in reach(pairs, 7, 4).items():
                best[n] = min(k, best.get(n, k))
        want += [(r, n, k) for n, k in best.items()]
    assert got == sorted(want)


def test_a_round_has_one_row_for_each_lane_and_node(spark):
    pairs = [(k, k + 1) for k in range(6)]
    seeds = spark.createDataFrame([(r, 0) for r in range(50)], "root long, node long")
    lane = graph.lanes(seeds)
    rows = graph.masks(edges_of(spark, pairs), seeds, lane, 10).collect()
    assert len(rows) == 7 and {r["depth"] for r in rows} == set(range(7)) and all(bin(r["fresh"] & (2**64 - 1)).count("1") == 50 for r in rows)


def test_components_of_large_ids(spark):
    big = 9 * 10**18
    pairs = [(big + 1, big + 2), (big + 2, big + 3), (big + 3, big + 1), (big + 3, 5), (5, 6), (6, 5), (7, 8)]
    got = sorted((r["component"], r["node"], r["size"]) for r in graph.scc(edges_of(spark, pairs)).collect())
    assert got == sorted([(big + 3, big + k, 3) for k in (1, 2, 3)] + [(6, 5, 2), (6, 6, 2)])


def all_cycles(pairs, n):
    out = set()
    for k in range(2, n + 1):
        for path in itertools.permutations(range(n), k):
            if path[0] == min(path) and all((path[i], path[(i + 1) % k]) in pairs for i in range(k)):
                out.add(tuple(sorted(path)))
    return out


def test_cycles_of_any_length(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(7), rng.randrange(7)) for _ in range(16)} | {(10, 11), (11, 12), (12, 13), (13, 14), (14, 10), (20, 20)}
    got = {tuple(r["members"]): (r["length"], r["severity"]) for r in graph.cycles(edges_of(spark, pairs)).collect()}
    assert set(got) == all_cycles(pairs, 7) | {(10, 11, 12, 13, 14)}
    assert all(s == ("high" if n >= 4 else "medium" if n == 3 else "low") and n == len(m) for m, (n, s) in got.items())


def test_cycle_report_counts_files_and_risk(spark):
    found = graph.cycles(edges_of(spark, [(1, 2), (2, 1), (2, 3), (3, 2)])).withColumn("graph", F.lit(1))
    nodes = spark.createDataFrame([(k, 1) for k in range(20)], "id long, graph int")
    assert {(r["affected"], r["risk"]) for r in graph.cycle_report(found, nodes).collect()} == {(3, 25)}


def test_hubs_are_found_in_every_graph(spark):
    pairs = [(1000 + k, 1010) for k in range(4)] + [(2000, 2001), (2001, 2002), (2000, 2002)]
    got = {(r["graph"], r["node"]): (r["reach_count"], r["degree"]) for r in graph.hubs(edges_of(spark, pairs), F.floor(F.col("node") / 1000)).collect()}
    assert got == {(1, 1010): (4, 4)}


def weighed(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, confidence double")


def ids(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def test_taint_paths_and_sanitised_states(spark):
    edges = weighed(spark, [(1, 2, 0.9), (2, 3, 0.8), (2, 4, 0.9), (4, 3, 0.9), (3, 5, 0.9), (1, 6, 0.5), (6, 3, 0.5), (4, 9, 0.1)])
    got = sorted(map(tuple, graph.taint_paths(edges, ids(spark, 1), ids(spark, 3, 5), ids(spark, 9)).collect()))
    assert got == [(1, 3, "1-2-3", 0.684, False), (1, 3, "1-2-4-3", 0.6926, True), (1, 5, "1-2-3-5", 0.6156, False), (1, 5, "1-2-4-3-5", 0.6233, True)]


def test_walks_that_cannot_reach_a_sink_are_cut_before_they_grow(spark):
    # A fan of chains without a sink beside one chain that ends in one.
    fan = [(1, 100 + k, 0.9) for k in range(50)] + [(100 + k, 200 + k, 0.9) for k in range(50)]
    edges = weighed(spark, [*fan, (1, 2, 0.9), (2, 3, 0.9)])
    best = {r["node"]: round(r["best"], 3) for r in graph.best_to_sinks(edges, ids(spark, 3), 0.3).collect()}
    assert best == {3: 1.0, 2: 0.9, 1: 0.81}
    assert [r["path"] for r in graph.taint_paths(edges, ids(spark, 1), ids(spark, 3), ids(spark)).collect()] == ["1-2-3"]


def test_provenance_classes_and_confidence(spark):
    edges = weighed(spark, [(2, 1, 0.95), (3, 1, 0.6), (4, 2, 0.8), (5, 4, 0.8), (8, 7, 0.9)])
    nodes = spark.createDataFrame([(1, "pci", 0), (2, None, 0), (3, None, 0), (4, "session", 0), (5, "phi", 1), (7, None, 0), (8, None, 0)], "id long, data_class string, points int")
    got = graph.provenance(edges, spark.createDataFrame([(1,), (7,)], "id long"), nodes).collect()
    assert list(map(tuple, got)) == [(1, "5-4-2-1", 3, "phi", 0.89)]


def test_parallelisable_cost(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 7), (3, 4), (4, 1)], "id long, cost long")
    edges = edges_of(spark, [(1, 2), (1, 3), (3, 4)], "calls")
    got = sorted(map(tuple, graph.path_cost(spark.createDataFrame([(1,), (3,), (4,)], "id long"), nodes, edges, ["calls"]).collect()))
    assert got == [(1, 4, 17, 4), (3, 2, 5, 0), (4, 1, 1, 0)]


@pytest.mark.parametrize("most", [1000, 12])
def test_small_graphs_in_tasks_and_large_ones_by_rounds_give_the_same(spark, most):
    """Graphs of up to 40 edges, with repeats and loops; at 12 edges, most of them go by rounds."""
    rng = random.Random(5)
    pairs = []
    for g in range(30):
        n = rng.randrange(1, 15)
        pairs += [(g * 1000 + rng.randrange(n), g * 1000 + rng.randrange(n)) for _ in range(rng.randrange(1, 40))]
    reach = {}
    for g in range(30):
        own = {p for p in pairs if p[0] // 1000 == g}
        found = set(own)
        while True:
            more = found | {(a, d) for a, b in found for c, d in own if b == c}
            if more == found:
                break
            found = more
        reach[g] = found
    edges = edges_of(spark, pairs)
    number = F.floor(F.col("src") / 1000)
    keyed = edges.select(number.alias("key"), "src", "dst")
    assert sorted((r.key, r.src, r.dst) for r in graph.closure(keyed, most).collect()) == sorted((g, *p) for g, ps in reach.items() for p in ps)
    mutual = {}
    for ps in reach.values():
        for a, b in ps:
            if (b, a) in ps and a != b:
                mutual.setdefault(a, {a}).add(b)
    assert sorted((r.component, r.node, r["size"]) for r in graph.scc_by_graph(edges, number, most).collect()) == sorted((max(x), a, len(x)) for a, x in mutual.items())
    goals = [(g, g * 1000 + 3) for g in range(0, 30, 2)]
    led = graph.reaching(keyed.withColumnRenamed("key", "graph"), spark.createDataFrame(goals, "graph long, node long"), most)
    assert sorted((r.graph, r.node) for r in led.collect()) == sorted({(g, a) for g, goal in goals for a, b in reach[g] if b == goal} | set(goals))
    by = F.floor(F.col("node") / 1000)
    top = lambda k: sorted(tuple(r) for r in graph.hubs(edges, by, 3, 4, k).collect())
    assert top(most) == top(0) and len(top(0)) > 30


def test_names_of_states_may_be_strings(spark):
    rows = spark.createDataFrame([("m", "a", "b"), ("m", "b", "c"), ("n", "b", "a")], "key string, src string, dst string")
    for most in (1000, 0):
        assert sorted((r.key, r.src, r.dst) for r in graph.closure(rows, most).collect()) == [("m", "a", "b"), ("m", "a", "c"), ("m", "b", "c"), ("n", "b", "a")]


def test_matches_come_in_order_and_the_sort_is_of_one_side(spark):
    """Before, all matches were sorted."""
    scored = spark.createDataFrame([(k, k % 3, float(k * 37 % 50)) for k in range(200)], "id long, _key long, match_score double").repartition(5)
    patterns = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "pattern long, _key long")
    got = insights.ranked_pairs(scored, patterns)
    rows = [tuple(r) for r in got.select("id", "pattern", "match_score").collect()]
    assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
    assert sorted(rows) == sorted((k, p, float(k * 37 % 50)) for k in range(200) for p, key in ((1, 0), (2, 0), (3, 1)) if k % 3 == key)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Sort ")
    full = registry.queries()["jn_fingerprint_patterns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert full.index("Join Inner") < full.index("Sort ")


def test_pair_features_in_tasks_and_by_joins_give_the_same(spark):
    rng = random.Random(8)
    nodes = [(g, g * 1000 + k, rng.randrange(4), k * 25, rng.randrange(20), rng.randrange(13)) for g in range(12) for k in range(rng.randrange(1, 12))]
    pairs = [(g * 1000 + rng.randrange(12), g * 1000 + rng.randrange(12)) for g in range(12) for _ in range(rng.randrange(0, 30))]
    made = spark.createDataFrame(nodes, "repo long, id long, type long, line long, bundle long, complexity long")
    edges, repo = edges_of(spark, pairs), F.floor(F.col("src") / 1000)
    want = sorted(tuple(r) for r in insights.pair_features(made, edges, 8).collect())
    for rows in (1000, 12):
        assert sorted(tuple(r) for r in insights.pair_features_by_repo(made, edges, repo, 8, rows).collect()) == want
    # No pairs are joined; before, each was joined with the edges.
    plan = insights.pair_features_by_repo(made, edges, repo)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
