"""Queries over graphs, evidence and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.operators import aggregates, fusion, graph, risk
from risklake.plans.book import Book
from risklake.plans.domain import Domain
from risklake.plans.relational import COUNTS, ISSUE_ORDER

BOOK = Book()
Q = BOOK.add

PAIRS = "p AS (SELECT DISTINCT src, dst FROM d_edges)"
DEGREE = "deg AS (SELECT id, sum(i) AS in_degree, sum(o) AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM p UNION ALL SELECT dst, 1, 0 FROM p) GROUP BY id)"


def _at(d: Domain, *places: int):
    """The nodes at these places of every repository's graph."""
    return d.nodes.filter((F.col("id") % 1000).isin(*places)).select("id")


def _roots(d: Domain, *places: int):
    return _at(d, *places).select(F.col("id").alias("root"), F.col("id").alias("node"))


Q(
    "gr_degree",
    f"""WITH {PAIRS}, {DEGREE}, n AS (SELECT n.id, CAST(coalesce(in_degree, 0) AS BIGINT) AS in_degree, CAST(coalesce(out_degree, 0) AS BIGINT) AS out_degree, coalesce(degree, 0) AS degree FROM (SELECT id FROM d_nodes) n LEFT JOIN deg ON deg.id = n.id)
    SELECT *, degree = 0 AS isolated, (SELECT floor(round(sum(degree) / count(*), 9) * 10000 + 0.5) / 10000 FROM n) AS mean_degree FROM n""",
)(lambda d: graph.degree_report(d.nodes, d.edges.select("src", "dst").distinct()))
Q(
    "gr_fan_instability",
    f"""WITH {PAIRS}, {DEGREE}, x AS (SELECT id, CAST(in_degree AS BIGINT) AS fan_in, CAST(out_degree AS BIGINT) AS fan_out, floor(round(out_degree / degree, 9) * 10000 + 0.5) / 10000 AS instability FROM deg)
    SELECT *, (fan_in > 5 AND fan_out > 10) OR fan_out > 15 AS god_module, instability > 0.8 AND fan_in > 5 AS unstable FROM x""",
)(lambda d: graph.instability(d.edges))
Q(
    "gr_bfs",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges WHERE type IN ('calls', 'imports')), r AS (SELECT id AS root, id AS node, 0 AS depth FROM d_nodes WHERE id % 1000 IN (1, 5) UNION SELECT root, dst, depth + 1 FROM r JOIN s ON node = src WHERE depth < 10)
    SELECT CAST(root AS BIGINT) AS root, CAST(node AS BIGINT) AS node, min(depth) AS depth FROM r GROUP BY ALL""",
)(lambda d: graph.bfs(d.edges, _roots(d, 1, 5), 10, ["calls", "imports"]))
Q(
    "gr_bfs_backward",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges), r AS (SELECT id AS root, id AS node, 0 AS depth FROM d_nodes WHERE id % 1000 = 7 UNION SELECT root, src, depth + 1 FROM r JOIN s ON node = dst WHERE depth < 4)
    SELECT CAST(root AS BIGINT) AS root, CAST(node AS BIGINT) AS node, min(depth) AS depth FROM r GROUP BY ALL""",
)(lambda d: graph.bfs(d.edges, _roots(d, 7), 4, backward=True))
Q(
    "gr_paths",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges), r AS (SELECT id AS node, [id] AS path FROM d_nodes WHERE id % 1000 = 1 UNION ALL SELECT dst, list_append(path, dst) FROM r JOIN s ON node = src WHERE node % 1000 <> 9 AND len(path) < 6 AND NOT list_contains(path, dst))
    SELECT array_to_string(path, '-') AS path FROM r WHERE node % 1000 = 9 AND len(path) > 1""",
)(lambda d: graph.paths(d.edges, _at(d, 1).select(F.col("id").alias("start"), (F.col("id") + 8).alias("goal")), 5).select(F.array_join("path", "-").alias("path")))
Q(
    "gr_scc",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges WHERE src <> dst), r AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src),
    c AS (SELECT a.src AS node, greatest(a.src, max(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
    SELECT component, node, count(*) OVER (PARTITION BY component) AS size FROM c""",
)(lambda d: graph.scc_by_graph(d.links, F.floor(F.col("src") / 1000)))
Q(
    "gr_cycles",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges WHERE src <> dst AND type = 'imports'), r AS (SELECT src AS first, dst AS node, [src, dst] AS path FROM s WHERE dst > src UNION ALL SELECT first, dst, list_append(path, dst) FROM r JOIN s ON node = src WHERE dst > first AND NOT list_contains(path, dst)),
    m AS (SELECT DISTINCT first // 1000 AS graph, list_sort(path) AS members FROM r JOIN s ON node = src AND dst = first), f AS (SELECT graph, count(DISTINCT u) AS affected FROM (SELECT graph, unnest(members) AS u FROM m) GROUP BY graph), c AS (SELECT graph, count(*) AS cycles FROM m GROUP BY graph), n AS (SELECT id // 1000 AS graph, count(*) AS files FROM d_nodes GROUP BY ALL)
    SELECT graph, array_to_string(members, '-') AS members, len(members) AS length, CASE WHEN len(members) >= 4 THEN 'high' WHEN len(members) = 3 THEN 'medium' ELSE 'low' END AS severity, affected, CAST(least(100, floor(round(100 * affected / files + 5 * cycles, 9) + 0.5)) AS BIGINT) AS risk
    FROM m JOIN f USING (graph) JOIN c USING (graph) JOIN n USING (graph)""",
)(
    lambda d: graph.cycle_report(graph.cycles(d.edges.filter("type = 'imports'")).withColumn("graph", F.floor(F.get("members", F.lit(0)) / 1000)), d.nodes.withColumn("graph", F.floor(F.col("id") / 1000))).withColumn("members", F.array_join("members", "-"))
)
Q(
    "gr_hubs",
    f"""WITH RECURSIVE {PAIRS}, {DEGREE}, n AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY id // 1000 ORDER BY id) AS k FROM deg) WHERE k <= 50), r AS (SELECT id AS root, id AS node FROM n UNION SELECT root, dst FROM r JOIN p ON node = src), c AS (SELECT node, count(*) AS reach_count FROM r WHERE root <> node GROUP BY node),
    h AS (SELECT id // 1000 AS graph, id AS node, coalesce(reach_count, 0) AS reach_count, degree FROM deg LEFT JOIN c ON id = node WHERE coalesce(reach_count, 0) >= 3 OR degree >= 5)
    SELECT graph, node, reach_count, degree FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY reach_count DESC, degree DESC, node) AS k FROM h) WHERE k <= 10""",
)(lambda d: graph.hubs(d.links, F.floor(F.col("node") / 1000)))
Q(
    "gr_resilience",
    f"""WITH {PAIRS}, {DEGREE}, n AS (SELECT count(*) AS nodes, count(*) FILTER (degree IS NULL) AS isolated, count(*) FILTER (degree >= 5) AS hubs FROM (SELECT id AS i FROM d_nodes) LEFT JOIN deg ON i = id),
    e AS (SELECT count(*) AS edges, count(*) FILTER (a.degree = 1 OR b.degree = 1) AS spof FROM p JOIN deg a ON src = a.id JOIN deg b ON dst = b.id),
    s AS (SELECT *, CAST(floor(round(greatest(0, 100 - 40 * isolated / nodes - 30 * least(spof, 15) / greatest(edges, 1) - 20 * least(hubs, 10) / nodes), 6) + 0.5) AS BIGINT) AS score FROM n, e)
    SELECT nodes, edges, isolated, spof, hubs, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'weak' ELSE 'fragile' END AS band FROM s""",
)(lambda d: graph.resilience(d.nodes, d.edges))
Q(
    "gr_entropy",
    f"WITH {PAIRS}, {DEGREE}, t AS (SELECT degree / sum(degree) OVER () AS p FROM deg) SELECT count(*) AS n, floor(round(-sum(p * log2(p)) / log2(count(*)), 9) * 10000 + 0.5) / 10000 AS entropy FROM t",
)(lambda d: graph.degree_entropy(d.edges))


def _weighed(d: Domain):
    return d.edges.filter("src <> dst").select("src", "dst").distinct().withColumn("confidence", F.round(0.5 + (F.col("src") + F.col("dst")) % 5 / 10, 1))


Q(
    "gr_taint_paths",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst, round(0.5 + (src + dst) % 5 / 10, 1) AS c FROM d_edges WHERE src <> dst), k AS (SELECT id AS clean FROM d_nodes WHERE id % 10 = 3 UNION SELECT src FROM s WHERE dst % 10 = 3), r AS (SELECT n AS start, n AS node, [n] AS path, 1.0::DOUBLE AS p FROM (SELECT id AS n FROM d_nodes WHERE id % 10 = 0)
      UNION ALL SELECT start, dst, list_append(path, dst), p * c FROM r JOIN s ON node = src WHERE p * c >= 0.3 AND NOT list_contains(path, dst) AND len(path) < 20)
    SELECT start, node AS sink, array_to_string(path, '-') AS path, floor(round(p * 0.95, 9) * 10000 + 0.5) / 10000 AS confidence, list_has_any(path, (SELECT list(clean) FROM k)) AS sanitised FROM r WHERE node % 10 = 5 AND len(path) > 1""",
)(
    lambda d: graph.taint_paths(
        _weighed(d), d.nodes.filter("id % 10 = 0").select(F.col("id").alias("node")), d.nodes.filter("id % 10 = 5").select(F.col("id").alias("node")), d.nodes.filter("id % 10 = 3").select(F.col("id").alias("node"))
    )
)
Q(
    "gr_implicit_flow",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges WHERE type = 'imports'), r AS (SELECT n AS root, n AS node, 0 AS depth FROM (SELECT id AS n FROM d_nodes WHERE id % 1000 IN (5, 15, 25)) UNION SELECT root, src, depth + 1 FROM r JOIN s ON node = dst WHERE depth < 10)
    SELECT CAST(root AS BIGINT) AS sink, CAST(node AS BIGINT) AS source, min(depth) AS depth FROM r WHERE node % 10 = 0 GROUP BY ALL""",
)(lambda d: graph.bfs(d.edges, _roots(d, 5, 15, 25), 10, ["imports"], backward=True).filter("node % 10 = 0").select(F.col("root").alias("sink"), F.col("node").alias("source"), "depth"))
NODES = "nodes AS (SELECT * FROM d_nodes)"
Q(
    "gr_dep_cost",
    f"WITH {NODES}, s AS (SELECT DISTINCT src, dst FROM d_edges WHERE type IN ('calls', 'imports')), b AS (SELECT src, sum(cost) AS c FROM s JOIN nodes ON dst = id GROUP BY src) SELECT id, CAST(cost + coalesce(c, 0) AS BIGINT) AS total_cost FROM nodes LEFT JOIN b ON id = src",
)(lambda d: graph.dep_cost(d.nodes, d.edges))
for _name, _roots_of, _types in (("gr_path_cost", (0, 3, 6), ("calls",)), ("gr_bundle_impact", (1, 2, 4), ("imports",))):
    _t = ", ".join(f"'{t}'" for t in _types)
    Q(
        _name,
        f"""WITH RECURSIVE {NODES}, s AS (SELECT DISTINCT src, dst FROM d_edges WHERE type IN ({_t})), r AS (SELECT n AS root, n AS node FROM (SELECT id AS n FROM d_nodes WHERE id % 1000 IN ({', '.join(map(str, _roots_of))})) UNION SELECT root, dst FROM r JOIN s ON node = src)
        , k AS (SELECT src, sum(cost) - max(cost) AS saved FROM (SELECT DISTINCT src, dst FROM d_edges WHERE type = 'calls') JOIN nodes ON id = dst GROUP BY src)
        SELECT CAST(root AS BIGINT) AS root, count(*) AS reached, CAST(sum(cost) AS BIGINT) AS cost, CAST(coalesce(max(saved), 0) AS BIGINT) AS parallelisable FROM r JOIN nodes ON node = id LEFT JOIN k ON k.src = root GROUP BY root""",
    )(lambda d, roots=_roots_of, types=_types: graph.path_cost(_at(d, *roots), d.nodes, d.edges, list(types)))
Q(
    "gr_branch_depth",
    f"""WITH RECURSIVE {PAIRS}, b AS (SELECT id, cost * 3 AS complexity FROM d_nodes WHERE id % 1000 IN (8, 9)), r AS (SELECT id AS root, id AS node FROM b UNION SELECT root, dst FROM r JOIN p ON node = src)
    SELECT id AS branch, count(*) FILTER (node <> id) AS reachable, id NOT IN (SELECT src FROM p) AS dead_end, complexity > 20 AS complex FROM b JOIN r ON root = id GROUP BY id, complexity""",
)(lambda d: graph.branch_depth(d.nodes.filter("id % 1000 IN (8, 9)").select("id", (F.col("cost") * 3).alias("complexity")), d.edges))
Q("gr_cost_totals", f"WITH {NODES} SELECT exported, count(*) AS n, CAST(sum(cost) AS BIGINT) AS cost FROM nodes GROUP BY exported")(lambda d: d.nodes.groupBy("exported").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")))
Q("gr_dead_code", f"WITH {NODES} SELECT id FROM nodes WHERE NOT exported AND id NOT IN (SELECT dst FROM d_edges WHERE type IN ('calls', 'imports', 'renders'))")(lambda d: graph.dead_code(d.nodes, d.edges))
Q(
    "gr_failure_propagation",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges), r AS (SELECT n AS node, 0 AS depth FROM (SELECT id AS n FROM d_nodes WHERE id % 1000 IN (3, 30)) UNION SELECT src, depth + 1 FROM r JOIN s ON node = dst WHERE depth < 5), m AS (SELECT node, min(depth) AS k FROM r GROUP BY node), n AS (SELECT DISTINCT unnest([src, dst]) AS id FROM s)
    SELECT id, round(greatest(0.05, coalesce(0.8::DOUBLE * pow(0.7::DOUBLE, k), 0)), 6) AS probability FROM n LEFT JOIN m ON id = node""",
)(lambda d: graph.failure_prob(d.edges, _at(d, 3, 30)))
Q(
    "gr_markov_blanket",
    f"""WITH {PAIRS}, t AS (SELECT id AS target FROM d_nodes WHERE id % 1000 IN (2, 30)), c AS (SELECT target, dst AS node FROM t JOIN p ON src = target), m AS (SELECT target, src AS node FROM t JOIN p ON dst = target UNION SELECT * FROM c UNION SELECT target, p.src FROM c JOIN p ON p.dst = c.node)
    SELECT DISTINCT CAST(target AS BIGINT) AS target, node FROM m WHERE node <> target""",
)(lambda d: graph.markov_blanket(d.edges, _at(d, 2, 30)))
MODELS = """ev AS (SELECT DISTINCT src // 1000 AS model, 's' || src % 1000 AS src, 's' || dst % 1000 AS dst, type AS label FROM d_edges), st AS (SELECT DISTINCT model, state, state = 's0' AS initial, CAST(state[2:] AS INT) % 2 = 0 AS accepting
  FROM (SELECT model, src AS state FROM ev UNION SELECT model, dst FROM ev UNION SELECT model, 's0' FROM ev))"""


def _named(pairs):
    """Nodes as names of states."""
    name = lambda c: F.concat(F.lit("s"), (F.col(c) % 1000).cast("string")).alias(c)
    return pairs.select(*[name(c) if c in ("src", "dst") else F.col(c) for c in pairs.columns])


def _models(d: Domain):
    """A state machine per repository; events with repeats. States are numbers, which are names without their letter."""
    number = lambda c: (F.col(c) % 1000).alias(c)
    events = d.links.select(F.floor(F.col("src") / 1000).alias("model"), number("src"), number("dst"), F.col("type").alias("label"))
    states = events.select("model", F.explode(F.array("src", "dst", F.lit(0).cast("long"))).alias("state")).distinct()
    return states.withColumn("initial", F.col("state") == 0).withColumn("accepting", F.col("state") % 2 == 0), events


Q(
    "gr_fsm_report",
    f"""WITH RECURSIVE {MODELS}, r AS (SELECT model, state FROM st WHERE initial UNION SELECT r.model, dst FROM r JOIN ev ON ev.model = r.model AND src = state)
    SELECT m.model, (SELECT count(*) FROM st WHERE st.model = m.model AND NOT EXISTS (SELECT 1 FROM r WHERE r.model = st.model AND r.state = st.state)) AS unreachable,
      (SELECT count(*) FROM st WHERE st.model = m.model AND NOT accepting AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.model = st.model AND src = state)) AS deadlocks,
      (SELECT count(*) FROM (SELECT model, src, label FROM ev GROUP BY ALL HAVING count(DISTINCT dst) > 1) x WHERE x.model = m.model) AS races FROM (SELECT DISTINCT model FROM st) m""",
)(lambda d: graph.fsm_report(*_models(d)))
Q(
    "gr_fsm_closure",
    f"WITH RECURSIVE {MODELS}, r AS (SELECT model, src, dst FROM ev UNION SELECT r.model, r.src, ev.dst FROM r JOIN ev ON ev.model = r.model AND ev.src = r.dst) SELECT model AS key, src, dst FROM r",
)(lambda d: _named(graph.closure(d.links.select(F.floor(F.col("src") / 1000).alias("key"), "src", "dst"))))
Q(
    "gr_response_property",
    f"""WITH RECURSIVE {MODELS}, e AS (SELECT model, src, dst FROM ev UNION SELECT model, state, state FROM st), r AS (SELECT * FROM e UNION SELECT r.model, r.src, e.dst FROM r JOIN e ON e.model = r.model AND e.src = r.dst),
    bad AS (SELECT model, state FROM st WHERE contains(state, '1') AND NOT EXISTS (SELECT 1 FROM r WHERE r.model = st.model AND r.src = st.state AND contains(r.dst, '9'))),
    v AS (SELECT DISTINCT r.model, r.src FROM r JOIN bad ON bad.model = r.model AND bad.state = r.dst)
    SELECT s.model, count(v.src) AS violating, count(*) - count(v.src) AS verified, count(v.src) = 0 AS holds FROM st s LEFT JOIN v ON s.model = v.model AND s.state = v.src GROUP BY s.model""",
)(lambda d: graph.response_property(*_models(d), "1", "9"))
_CLASS = f"CASE WHEN id % 3 = 0 THEN ({graph.DATA_CLASSES!r})[1 + id * 7 % 10] END".replace("(('", "(['").replace("'))", "'])")


def _traced(d: Domain):
    """Edges with confidences, and nodes with the class of every third and points by number."""
    edges = d.edges.filter("type IN ('data_flow', 'imports') AND src <> dst").select("src", "dst").distinct().withColumn("confidence", F.round(0.5 + (F.col("src") + F.col("dst")) % 6 / 10, 1))
    names = F.array(*map(F.lit, graph.DATA_CLASSES))
    nodes = d.nodes.select("id", F.when(F.col("id") % 3 == 0, F.get(names, (F.col("id") * 7 % 10).cast("int"))).alias("data_class"), F.when(F.col("id") % 5 == 0, 3).when(F.col("id") % 5 == 1, -1).otherwise(0).alias("points"))
    return edges, nodes


Q(
    "gr_provenance",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst, round(0.5 + (src + dst) % 6 / 10, 1)::DOUBLE AS c FROM d_edges WHERE type IN ('data_flow', 'imports') AND src <> dst), n AS (SELECT id, {_CLASS} AS class, CASE id % 5 WHEN 0 THEN 3 WHEN 1 THEN -1 ELSE 0 END AS points FROM d_nodes),
    s AS (SELECT src, dst, c, class, CASE WHEN c > 0.9 THEN 3 WHEN c > 0.7 THEN 2 ELSE 1 END + CASE WHEN class IS NULL THEN 0 ELSE 2 END + points AS score FROM e JOIN n ON id = src),
    w AS (SELECT id AS sink, id AS here, [id] AS path, 0 AS hops, []::VARCHAR[] AS classes, 0.0::DOUBLE AS total FROM d_nodes WHERE id % 7 = 0
      UNION ALL SELECT sink, src, list_append(path, src), hops + 1, list_append(classes, class), total + c FROM (SELECT w.*, s.*, row_number() OVER (PARTITION BY sink ORDER BY score DESC, src) AS k FROM w JOIN s ON here = dst WHERE hops < 15 AND NOT list_contains(path, src)) WHERE k = 1),
    l AS (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY hops DESC) AS k FROM w), x AS (SELECT *, list_filter(classes, lambda c: c IS NOT NULL) AS met FROM l WHERE k = 1)
    SELECT sink, array_to_string(list_reverse(path), '-') AS path, hops, list_filter({list(graph.DATA_CLASSES)}, lambda c: list_contains(met, c))[1] AS data_class,
      floor(round(greatest(0.1, least(0.99, 0.7::DOUBLE + least(0.2::DOUBLE, 0.05::DOUBLE * len(list_distinct(met))) + 0.1::DOUBLE * total / hops)), 9) * 100 + 0.5) / 100 AS confidence FROM x WHERE len(met) > 0""",
)(lambda d: graph.provenance(_traced(d)[0], d.nodes.filter("id % 7 = 0").select("id"), _traced(d)[1]))

# Evidence
R4 = "floor(round({0}, 9) * 10000 + 0.5) / 10000"
EVIDENCE = f"""e0 AS (SELECT rid, scan_id, k1, k2, k3, severity, CASE severity WHEN 'critical' THEN 0.95::DOUBLE WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 ELSE 0.4 END AS sev,
    unnest([1, 2, 3]) AS layer, unnest([CASE WHEN source_evidence IN ('static', 'deep_scan') THEN confidence::DOUBLE ELSE confidence * 0.7::DOUBLE END, CASE WHEN has_repro THEN least(100.0::DOUBLE, confidence + 5) ELSE 20 END, confidence::DOUBLE]) AS c,
    unnest([0.9::DOUBLE, CASE WHEN has_repro THEN 0.85::DOUBLE ELSE 0.4 END, CASE WHEN source_evidence = 'ai_reasoning' THEN 0.6::DOUBLE ELSE 0.45 END]) AS r FROM (SELECT *, row_number() OVER () AS rid FROM d_issues)),
  e1 AS (SELECT *, least(greatest(c, 0), 100) / 100 * r * sev * 0.2 AS v, greatest(0.01, (1 - least(greatest(c, 0), 100) / 100) * r * 0.5) AS n FROM e0),
  e2 AS (SELECT *, {R4.format('v')} AS mv, {R4.format('n')} AS mn, {R4.format('greatest(0.02, 1 - v - n)')} AS mu FROM e1)"""
Q("sm_evidence_mass", f"WITH {EVIDENCE} SELECT scan_id, k1, k2, k3, layer - 1 AS layer, mv AS v, mn AS n, mu AS u FROM e2")(
    lambda d: fusion.evidence_mass(d.issues).select("scan_id", *ISSUE_ORDER, F.posexplode("masses").alias("layer", "m")).select("scan_id", *ISSUE_ORDER, "layer", "m.v", "m.n", "m.u")
)
FOLD = f"""{EVIDENCE}, w AS (SELECT scan_id, k1, k2, k3, max(severity) AS severity, {", ".join(f"max(CASE WHEN layer = {k} THEN mv * r END) AS v{k}, max(CASE WHEN layer = {k} THEN mn * r END) AS n{k}, max(CASE WHEN layer = {k} THEN greatest(0.02, 1 - (mv + mn) * r) END) AS u{k}" for k in (1, 2, 3))} FROM e2 GROUP BY rid, scan_id, k1, k2, k3),
  f1 AS (SELECT *, 1 - (v1 * n2 + n1 * v2) AS z FROM w), f2 AS (SELECT *, {R4.format('(v1 * v2 + v1 * u2 + u1 * v2) / z')} AS va, {R4.format('(n1 * n2 + n1 * u2 + u1 * n2) / z')} AS na, {R4.format('u1 * u2 / z')} AS ua FROM f1),
  f3 AS (SELECT *, 1 - (va * n3 + na * v3) AS y FROM f2), f4 AS (SELECT *, {R4.format('(va * v3 + va * u3 + ua * v3) / y')} AS vb, {R4.format('(na * n3 + na * u3 + ua * n3) / y')} AS nb, {R4.format('ua * u3 / y')} AS ub FROM f3),
  f5 AS (SELECT *, vb / (vb + nb + ub) AS b, ub / (vb + nb + ub) AS u, {R4.format('((v1 * n2 + n1 * v2) + (v1 * n3 + n1 * v3) + (v2 * n3 + n2 * v3)) / 3')} AS k FROM f4),
  fused AS (SELECT scan_id, k1, k2, k3, severity, {R4.format('b')} AS belief, {R4.format('b + u')} AS plausibility, k AS conflict, {R4.format('u')} AS uncertainty, CAST(least(greatest(floor(round(b * (1 - u * 0.5) * 100, 6) + 0.5), 0), 100) AS BIGINT) AS fused_confidence,
    CASE WHEN k > 0.95 THEN 'inconclusive' WHEN b >= 0.9 THEN 'vulnerable' WHEN b >= 0.7 THEN 'likely_vulnerable' WHEN b + u < 0.15 THEN 'safe' WHEN b + u < 0.35 THEN 'likely_safe' ELSE 'inconclusive' END AS verdict FROM f5)"""
Q("sm_ds_fusion", f"WITH {FOLD} SELECT * EXCLUDE (severity) FROM fused")(
    lambda d: fusion.ds_fusion(fusion.evidence_mass(d.issues)).select("scan_id", *ISSUE_ORDER, "belief", "plausibility", "conflict", "uncertainty", "fused_confidence", "verdict")
)
WS = "CASE severity WHEN 'critical' THEN 4.0::DOUBLE WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0.5 END"
Q(
    "sm_ds_scan",
    f"""WITH {FOLD} SELECT scan_id, {R4.format('avg(belief)')} AS belief, {R4.format('avg(plausibility)')} AS plausibility, {R4.format('avg(conflict)')} AS conflict, count(*) FILTER (verdict = 'vulnerable') AS vulnerable, count(*) FILTER (verdict = 'likely_vulnerable') AS likely_vulnerable,
    CAST(floor(round(avg(fused_confidence), 6) + 0.5) AS BIGINT) AS mean_confidence, CAST(floor(round(sum(fused_confidence * {WS}) / sum({WS}), 6) + 0.5) AS BIGINT) AS weighted_confidence, CAST(floor(round(sum(fused_confidence) / sum({WS}), 6) + 0.5) AS BIGINT) AS weighted_confidence_ref FROM fused GROUP BY scan_id""",
)(lambda d: fusion.ds_scan(fusion.ds_fusion(fusion.evidence_mass(d.issues))))


def _reports(d: Domain):
    one = fusion.evidence_mass(d.issues).select("scan_id", *ISSUE_ORDER, "title", F.element_at("masses", 1).alias("mass"))
    return fusion.ds_group(one, ["scan_id"], ISSUE_ORDER)


_join = lambda x: f"CASE WHEN 1 - (a.v * b.n + a.n * b.v) > 0 THEN {R4.format(f'({x}) / (1 - (a.v * b.n + a.n * b.v))')}"
GROUP_FOLD = f"""{EVIDENCE}, m AS (SELECT scan_id, k1, k2, k3, {{{{'v': mv * r, 'n': mn * r, 'u': greatest(0.02, 1 - (mv + mn) * r)}}}} AS m FROM e2 WHERE layer = 1), g AS (SELECT scan_id, list(m ORDER BY k1, k2, k3) AS ms FROM m GROUP BY scan_id),
  f AS (SELECT scan_id, len(ms) AS reports, list_reduce(ms, lambda a, b: {{{{'v': {_join('a.v * b.v + a.v * b.u + a.u * b.v')} ELSE 0 END, 'n': {_join('a.n * b.n + a.n * b.u + a.u * b.n')} ELSE 0 END, 'u': {_join('a.u * b.u')} ELSE 1 END}}}}) AS s FROM g),
  folded AS (SELECT scan_id, reports, {R4.format('s.v')} AS v, {R4.format('s.n')} AS n, {R4.format('s.u')} AS u FROM f)""".replace("{{", "{").replace("}}", "}")
Q("sm_ds_group_fusion", f"WITH {GROUP_FOLD} SELECT scan_id, CAST(reports AS INT) AS reports, v, n, u FROM folded")(_reports)
Q(
    "sm_agent_consensus",
    """WITH x AS (SELECT scan_id, k1, k2, k3, severity, category IN ('PROMO', 'ECONOMY') AS g, coalesce(regexp_matches(lower(description), 'user|payment'), false) AS p FROM d_issues), y AS (SELECT *, CASE WHEN g AND p THEN 'critical' ELSE severity END AS escalated FROM x)
    SELECT scan_id, k1, k2, k3, least(greatest(round(CASE WHEN g THEN 0.5::DOUBLE + CASE WHEN p THEN 0.2 ELSE -0.1 END + CASE WHEN escalated = 'critical' THEN 0.2 ELSE 0 END ELSE 0.6 END, 6), 0), 1) AS consensus, escalated, CASE WHEN escalated = 'critical' THEN 0.65::DOUBLE ELSE 0.25 END AS regression FROM y""",
)(lambda d: fusion.debate(d.issues.withColumn("category", F.when(F.col("category").isin("PROMO", "ECONOMY"), "Injection").otherwise("Other"))).select("scan_id", *ISSUE_ORDER, "consensus", "escalated", "regression"))


def _counts(d: Domain):
    return aggregates.issue_counts(d.issues).withColumn("total", F.col("critical") + F.col("high") + F.col("medium") + F.col("low"))


Q("sm_monte_carlo")(lambda d: risk.loss_simulation(_counts(d)))
Q(
    "fn_forecasts",
    f"""WITH {COUNTS}, s AS (SELECT scan_id, greatest(0, 100 - least(critical * 12, 55) - least(high * 5, 28) - least(medium * 2, 12) - least(low, 5)) AS s, critical AS c, high AS h, medium AS m FROM counts),
    v AS (SELECT scan_id, unnest(['release_confidence', 'outage_probability', 'churn_risk', 'user_frustration', 'customer_trust', 'rollback_probability']) AS metric,
      unnest([least(greatest(s - c * 8 - h * 3, 5), 98), least(greatest(c * 22 + h * 10 + m * 3, 5), 95), least(greatest(c * 12 + h * 6 + m * 2, 3), 85), least(greatest(100 - s + c * 5, 0), 100), least(greatest(s - c * 15 - h * 5, 5), 98), least(greatest(c * 20 + h * 8, 2), 90)]) AS value FROM s)
    SELECT scan_id, metric, value, CASE metric WHEN 'release_confidence' THEN CASE WHEN value >= 70 THEN 'green' WHEN value >= 45 THEN 'amber' ELSE 'red' END WHEN 'customer_trust' THEN CASE WHEN value >= 70 THEN 'green' WHEN value >= 45 THEN 'amber' ELSE 'red' END
      WHEN 'churn_risk' THEN CASE WHEN value >= 30 THEN 'red' WHEN value >= 15 THEN 'amber' ELSE 'green' END WHEN 'user_frustration' THEN CASE WHEN value >= 60 THEN 'red' WHEN value >= 35 THEN 'amber' ELSE 'green' END ELSE CASE WHEN value >= 60 THEN 'red' WHEN value >= 30 THEN 'amber' ELSE 'green' END END AS colour FROM v""",
)(lambda d: risk.forecasts(aggregates.scan_score(d.issues)))
