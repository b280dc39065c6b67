"""Queries of the further operators."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import functions as F

from risklake.functions import scalars as fn
from risklake.operators import aggregates, fusion, graph, insights, rules
from risklake.plans.book import Book
from risklake.plans.corpus import CALLS, CODE_LINES, IMPORTS, LEAK_SQL, LINES, LITERAL_SQL, ROUTES, SAME, SIGNED, _code_lines, _lines, _signatures
from risklake.plans.domain import Domain
from risklake.plans.graphs import GROUP_FOLD, NODES, PAIRS
from risklake.plans.relational import COUNTS, ISSUE_ORDER, LICENSES, _values, licenses
from risklake.sources import code

BOOK = Book()
Q = BOOK.add

Q("src_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "events")))(
    lambda d: d.table("customer").agg(F.count("*").alias("n")).select(F.lit("customer").alias("name"), "n")
    .unionByName(d.table("orders").agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n"))
    .unionByName(d.table("lineitem").agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("name"), "n"))
    .unionByName(d.table("events").agg(F.count("*").alias("n")).select(F.lit("events").alias("name"), "n"))
)
Q("prj_file_hint", "SELECT DISTINCT file_path, '/src/' || stem || '.ts' AS hint FROM (SELECT file_path, regexp_extract(file_path, '([^/]*)\\.ts$', 1) AS stem FROM d_issues)")(
    lambda d: d.issues.select("file_path", fn.file_hint(F.col("file_path")).alias("hint")).distinct()
)
KIND = "CASE k3 % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END"
Q(
    "prj_issue_normalise",
    f"""SELECT scan_id, k1, k2, k3, 'graph' AS source, {KIND} AS severity, CASE k3 % 3 WHEN 0 THEN 95 WHEN 1 THEN 85 ELSE 70 END AS confidence, CASE k3 % 3 WHEN 0 THEN 'Verified Exploit' WHEN 1 THEN 'Verified Code Risk' ELSE 'Likely Risk' END AS evidence_level FROM d_issues WHERE k1 < 4
    UNION ALL SELECT scan_id, k1, k2, k3, 'static', severity, confidence, CASE WHEN confidence >= 95 THEN 'Verified Exploit' WHEN confidence >= 85 THEN 'Verified Code Risk' WHEN confidence >= 70 THEN 'Likely Risk' ELSE 'Advisory' END FROM d_issues WHERE k1 >= 4""",
)(
    lambda d: d.issues.filter("k1 < 4")
    .withColumn("severity", F.when(F.col("k3") % 3 == 0, "critical").when(F.col("k3") % 3 == 1, "high").otherwise("medium"))
    .withColumn("confidence", F.when(F.col("severity") == "critical", 95).when(F.col("severity") == "high", 85).otherwise(70))
    .withColumn("source", F.lit("graph"))
    .unionByName(d.issues.filter("k1 >= 4").withColumn("source", F.lit("static")))
    .select("scan_id", *ISSUE_ORDER, "source", "severity", "confidence", fn.evidence_level(F.col("confidence")).alias("evidence_level"))
)
Q(
    "jn_boundary_match",
    f"""WITH {ROUTES}, {CALLS}, c AS (SELECT DISTINCT repo_id, path FROM calls), p AS (SELECT c.repo_id, c.path AS call, r.path AS route, string_split(ltrim(lower(c.path), '/'), '/') AS a, string_split(ltrim(lower(r.path), '/'), '/') AS b FROM c JOIN routes r ON r.repo_id = c.repo_id),
    s AS (SELECT repo_id, call, route, CASE WHEN a = b THEN 100 WHEN regexp_matches(lower(call), '^' || regexp_replace(lower(route), ':[a-z0-9_]+', '([^/]+)', 'g') || '$') THEN 90 WHEN (2 + (a[2] = b[2])::INT) / 3 > 0.6 THEN floor((2 + (a[2] = b[2])::INT) / 3 * 80 + 0.5) WHEN (a[1] = b[1])::INT + (a[2] = b[2])::INT >= 2 THEN 50 ELSE 0 END AS score FROM p)
    SELECT repo_id || ':' || call AS call_id, first(repo_id || ':' || route ORDER BY score DESC, route) AS route_id, CAST(max(score) AS INT) AS score FROM s WHERE score >= 30 GROUP BY 1""",
)(
    lambda d: insights.boundary_match(
        code.client_calls(d.code).select(F.concat_ws(":", F.col("repo_id").cast("string"), "path").alias("call_id"), "repo_id", F.lit("GET").alias("method"), "path"),
        code.routes(d.code).select(F.concat_ws(":", F.col("repo_id").cast("string"), "path").alias("route_id"), "repo_id", "method", "path"),
    )
)
#: Stages of routes by number: name and weight of a conversion.
STAGE_OF = (("Acquisition", 0.05), ("Activation", 0.25), ("Revenue", 0.6), ("Retention", 0.15), ("Referral", 0.1))
_stage = lambda what: f"CASE i % 5 {' '.join(f'WHEN {k} THEN {what(x)}' for k, x in enumerate(STAGE_OF))} END"


def _file_routes(d: Domain):
    """The files that issues name, each with its route, stage and weight."""
    number = F.regexp_extract("file_path", r"([0-9]+)", 1).cast("int")
    files = d.issues.select("file_path").distinct().withColumn("i", number)
    return files.select("file_path", F.concat(F.lit("/r"), (F.col("i") % 7).cast("string")).alias("route"), F.get(F.array(*[F.lit(n) for n, _ in STAGE_OF]), F.col("i") % 5).alias("stage"), F.get(F.array(*[F.lit(w) for _, w in STAGE_OF]), F.col("i") % 5).alias("weight"))


Q(
    "jn_issue_routes",
    f"""WITH f AS (SELECT DISTINCT file_path, CAST(regexp_extract(file_path, '([0-9]+)', 1) AS INT) AS i FROM d_issues), r AS (SELECT file_path, '/r' || i % 7 AS route, {_stage(lambda x: f"'{x[0]}'")} AS stage, {_stage(lambda x: f'{x[1]}::DOUBLE')} AS weight FROM f),
    x AS (SELECT route, stage, severity, weight * CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.5 WHEN 'medium' THEN 0.15 ELSE 0.03 END AS w FROM d_issues JOIN r USING (file_path)),
    y AS (SELECT route, stage, severity, CAST(floor(round(w * 100, 6) + 0.5) AS BIGINT) AS drop_percent, CAST(floor(round(10000 * w * 50, 6) + 0.5) AS BIGINT) AS impact FROM x)
    SELECT route, stage, severity, count(*) AS n, count(*) FILTER (drop_percent > 0 AND impact > 100) AS findings, CAST(sum(impact) AS BIGINT) AS revenue_impact FROM y GROUP BY ALL""",
)(lambda d: insights.issue_routes(d.issues, _file_routes(d)))
Q("jn_fingerprint_patterns", "SELECT p_partkey AS id, s_suppkey AS pattern, p_retailprice AS match_score FROM part JOIN supplier ON p_size = s_nationkey ORDER BY 3 DESC")(
    lambda d: insights.ranked_pairs(d.table("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("match_score"), F.col("p_size").cast("long").alias("_key")), d.table("supplier").select(F.col("s_suppkey").alias("pattern"), F.col("s_nationkey").cast("long").alias("_key"))).select("id", "pattern", "match_score")
)
Q("jn_ltl_violations", "SELECT r.id, s.id AS scan_id, duration_ms AS violating FROM d_results r JOIN d_scans s ON r.scan_id = s.id WHERE engine_name = 'error' AND duration_ms > 50 ORDER BY duration_ms DESC, r.id LIMIT 50")(
    lambda d: d.results.filter("engine_name = 'error' AND duration_ms > 50").join(d.scans.select(F.col("id").alias("scan_id")), "scan_id").orderBy(F.col("duration_ms").desc(), "id").limit(50).select("id", "scan_id", F.col("duration_ms").alias("violating"))
)
Q("jn_deadlocks", "SELECT s.id, deadlocks FROM (SELECT scan_id, count(*) AS deadlocks FROM d_issues WHERE severity = 'critical' GROUP BY scan_id) i JOIN d_scans s ON s.id = i.scan_id ORDER BY 2 DESC, 1 LIMIT 100")(
    lambda d: d.issues.filter("severity = 'critical'").groupBy("scan_id").agg(F.count("*").alias("deadlocks")).join(d.scans.select(F.col("id").alias("scan_id")), "scan_id").select(F.col("scan_id").alias("id"), "deadlocks").orderBy(F.col("deadlocks").desc(), "id").limit(100)
)
Q(
    "ag_sbom",
    f"""WITH l AS (SELECT * FROM (VALUES {_values(sorted(LICENSES.items()))}) v(package, license)) SELECT repo_id, seq, 'pkg:npm/' || name || '@' || version_spec AS purl, regexp_replace(name, '[^A-Za-z0-9]', '-', 'g') || '-' || version_spec AS bom_ref, coalesce(license, 'NOASSERTION') AS license FROM d_deps LEFT JOIN l ON name = package""",
)(lambda d: d.per_repo(insights.sbom(d.stock, licenses(d))))
Q("ag_mockup_score", f"WITH {LINES} SELECT repo_id, count(*) FILTER (regexp_matches(line, '(?i)mock|lorem|dummy')) AS mocks, CAST(floor(100 * avg((NOT regexp_matches(line, '(?i)mock|lorem|dummy'))::INT) + 0.5) AS BIGINT) AS score FROM lines GROUP BY repo_id")(
    lambda d: _lines(d).withColumn("_m", F.col("line").rlike("(?i)mock|lorem|dummy")).groupBy("repo_id").agg(F.count_if("_m").alias("mocks"), fn.half_up(100 * F.count_if(~F.col("_m")) / F.count("*")).alias("score"))
)
Q(
    "ag_traffic_light",
    f"""WITH {COUNTS}, j AS (SELECT id, coalesce(score, 0) AS s, coalesce(critical, 0) AS c, coalesce(high, 0) AS h FROM d_scans LEFT JOIN counts ON id = scan_id)
    SELECT id, CASE WHEN c > 0 OR s < 40 THEN 'red' WHEN h > 2 OR s < 70 THEN 'yellow' ELSE 'green' END AS light, concat_ws(', ', CASE WHEN c > 0 THEN 'critical issues' END, CASE WHEN s < 40 THEN 'low score' END) AS blockers FROM j""",
)(lambda d: insights.traffic_light(d.scans, aggregates.issue_counts(d.issues)))
Q(
    "ag_reality_penalty",
    f"""WITH {COUNTS} SELECT scan_id AS repo, CAST(floor(round(least(greatest(100 - (8 * critical + 10 * high + 5 * medium + 12 * (low % 2) + least(1.5 * low, 15) + 10 * (critical // 3)), 0), 100), 6) + 0.5) AS BIGINT) AS score FROM counts""",
)(
    lambda d: insights.reality_penalty(
        aggregates.issue_counts(d.issues).select(F.col("scan_id").alias("repo"), F.col("critical").alias("mockups"), F.col("high").alias("missing"), F.col("medium").alias("partial"), (F.col("low") % 2).alias("broken"), F.col("low").alias("cleanup"), F.floor(F.col("critical") / 3).alias("blockers"))
    )
)
Q("ag_deep_summary", "SELECT severity, count(*) AS n FROM (SELECT severity FROM d_issues WHERE k1 < 4 UNION ALL SELECT severity FROM d_issues WHERE k1 >= 4 UNION ALL SELECT 'info' FROM d_results WHERE duration_ms > 50) GROUP BY severity")(
    lambda d: d.issues.filter("k1 < 4").select("severity").unionByName(d.issues.filter("k1 >= 4").select("severity")).unionByName(d.results.filter("duration_ms > 50").select(F.lit("info").alias("severity"))).groupBy("severity").agg(F.count("*").alias("n"))
)
FUSED = {"confidence": "overallConfidence", "belief": "overallBelief", "plausibility": "overallPlausibility", "conflict": "overallConflict"}
Q("ag_json_fusion", f"SELECT id, scan_id, {', '.join(f"CAST(json_extract_string(result, '$.aggregate.{path}') AS DOUBLE) AS {name}" for name, path in FUSED.items())}, json_extract_string(result, '$.aggregate.verdict') AS verdict FROM d_reports WHERE engine_name = 'fusion' ORDER BY created_at DESC, id DESC LIMIT 20")(
    lambda d: aggregates.json_fusion(d.reports)
)
BR = "len(regexp_extract_all(line, '\\b(?:if|for|while|catch|switch)\\b'))"
Q(
    "wn_cognitive",
    f"""WITH {CODE_LINES}, x AS (SELECT repo_id, path, {BR} AS b, greatest(coalesce(sum(len(regexp_extract_all(line, '\\{{')) - len(regexp_extract_all(line, '\\}}'))) OVER (PARTITION BY repo_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS d FROM lines) SELECT repo_id, path, CAST(sum(b * (1 + d)) AS BIGINT) AS cognitive FROM x GROUP BY ALL""",
)(lambda d: insights.cognitive(_code_lines(d), ["repo_id", "path"]))
Q("fn_entropy_leak", f"WITH literals AS (SELECT DISTINCT unnest(regexp_extract_all(content, '{LITERAL_SQL}', 1)) AS literal FROM d_files), {LEAK_SQL} SELECT literal, leak FROM judged")(lambda d: d.files.select(F.explode(F.regexp_extract_all("content", F.lit(rules.LITERAL), F.lit(1))).alias("literal")).distinct().select("literal", rules.is_leak(F.col("literal")).alias("leak")))
Q("fn_bom_ref", "SELECT DISTINCT regexp_replace(name, '[^A-Za-z0-9]', '-', 'g') || '-' || version_spec AS bom_ref FROM d_deps")(lambda d: d.held(d.stock).select("name", "version_spec").distinct().select(fn.bom_ref(F.col("name"), F.col("version_spec")).alias("bom_ref")).distinct())
OWASP_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(concat_ws(' ', title, description)), '{p}') THEN '{i}'" for i, p, _ in insights.OWASP) + " END"
Q("fn_owasp", f"SELECT scan_id, k1, k2, k3, {OWASP_SQL} AS owasp, CASE {OWASP_SQL} " + " ".join(f"WHEN '{i}' THEN {s}::DOUBLE" for i, _, s in insights.OWASP) + " END AS base_score FROM d_issues")(lambda d: insights.owasp(d.issues).select("scan_id", *ISSUE_ORDER, "owasp", "base_score"))
Q("fn_data_class", "SELECT scan_id, k1, k2, k3, CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{n}'" for n, p in insights.DATA_CLASSES) + " END AS class FROM d_issues")(
    lambda d: d.issues.select("scan_id", *ISSUE_ORDER, insights.data_class(F.col("description")).alias("class"))
)
Q("fn_detect_framework", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'nextjs' WHEN s_suppkey % 3 = 0 THEN 'react' ELSE 'unknown' END AS framework FROM supplier")(
    lambda d: d.table("supplier").select(F.col("s_suppkey").alias("id"), insights.detect_framework(F.map_filter(F.create_map(F.lit("next"), F.col("s_suppkey") % 4, F.lit("react"), F.col("s_suppkey") % 3), lambda k, v: v == 0)).alias("framework"))
)
Q(
    "fn_detect_tool",
    "WITH x AS (SELECT id, lower(coalesce(business_type, '') || '-' || framework) AS name, 'src/' || coalesce(vibe_tool, '') || '/main.ts' AS paths FROM d_scans) SELECT id, CASE "
    + " ".join(f"WHEN contains(paths, '{mark}')" + (f" OR contains(name, '{mark}')" if named else "") + f" THEN '{tool}'" for tool, mark, named in insights.TOOLS)
    + " ELSE 'unknown' END AS tool FROM x",
)(lambda d: d.scans.select("id", insights.detect_tool(F.concat_ws("-", F.coalesce("business_type", F.lit("")), "framework"), F.concat(F.lit("src/"), F.coalesce("vibe_tool", F.lit("")), F.lit("/main.ts"))).alias("tool")))
Q(
    "fn_detect_business",
    "WITH x AS (SELECT scan_id, k1, k2, k3, lower(concat_ws(' ', file_path, description)) AS t FROM d_issues) SELECT scan_id, k1, k2, k3, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in insights.BUSINESS) + " ELSE 'unknown' END AS business FROM x",
)(lambda d: d.issues.select("scan_id", *ISSUE_ORDER, insights.detect_business(F.col("file_path"), F.col("description")).alias("business")))
Q(
    "fn_side_classify",
    """WITH x AS (SELECT file_id, regexp_matches(content, 'router\\.')::INT + regexp_matches(content, 'app\\.listen')::INT + regexp_matches(content, '\\brequire\\(')::INT + regexp_matches(content, 'process\\.env')::INT + CASE WHEN regexp_matches(path, '/(api|server|routes)/') THEN 2 ELSE 0 END AS b,
      regexp_matches(content, 'useState')::INT + regexp_matches(content, 'document\\.')::INT + regexp_matches(content, 'fetch\\(')::INT + regexp_matches(content, '<html')::INT + regexp_matches(content, 'className=')::INT + CASE WHEN regexp_matches(path, '\\.(tsx|jsx|html)$') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(path, '/(components|pages|web)/|^web/') THEN 2 ELSE 0 END AS f FROM d_files)
    SELECT file_id, b AS backend, f AS frontend, CASE WHEN b >= f THEN 'backend' ELSE 'frontend' END AS side FROM x""",
)(lambda d: insights.side(d.files))
Q(
    "fn_file_triage",
    "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'mock' WHEN event_type = 'view' AND value <= 50 THEN 'orphan-doc' WHEN event_type = 'click' THEN 'duplicate' WHEN value > 50 THEN 'keep' ELSE 'review' END AS triage FROM events",
)(
    lambda d: insights.file_triage(
        d.table("events").select(F.col("event_id").alias("id"), F.array(F.when(F.col("event_type") == "error", "mock data").when(F.col("event_type") == "view", "docs only").when(F.col("event_type") == "click", "duplicate of x").otherwise("other")).alias("reasons"), (F.col("value") > 50).alias("alive"))
    )
)
Q("fn_line_diff", "SELECT l_orderkey * 1000000 + k AS id, '-old ' || k || chr(10) || '+new ' || k AS diff FROM (SELECT DISTINCT l_orderkey, l_partkey AS k FROM lineitem)")(
    lambda d: insights.line_diff(
        d.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("k")).distinct().select((F.col("l_orderkey") * 1000000 + F.col("k")).alias("id"), F.concat(F.lit("same\nold "), F.col("k").cast("string")).alias("before"), F.concat(F.lit("same\nnew "), F.col("k").cast("string")).alias("after"))
    )
)
Q(
    "fn_rule_rewrite",
    f"""WITH {CODE_LINES} SELECT repo_id || path || line_no AS id, CASE WHEN regexp_matches(line, '\\beval\\s*\\(') THEN regexp_replace(line, '\\beval\\s*\\(', 'safeEval(', 'g') WHEN regexp_matches(line, 'password = "[^"]*"') THEN regexp_replace(line, 'password = "[^"]*"', 'password = process.env.PASSWORD', 'g') END AS patched FROM lines""",
)(lambda d: insights.rewrite(_code_lines(d).select(F.concat(F.col("repo_id").cast("string"), "path", F.col("line_no").cast("string")).alias("id"), F.lit("ts").alias("lang"), "line"), [("py", "eval", "x"), ("ts", r"\beval\s*\(", "safeEval("), ("ts", 'password = "[^"]*"', "password = process.env.PASSWORD")]))
Q("fn_json_map_counts", "SELECT scan_id, '{' || string_agg('\"' || engine_name || '\":' || n, ',' ORDER BY engine_name) || '}' AS counts FROM (SELECT scan_id, engine_name, count(*) AS n FROM d_results GROUP BY ALL) GROUP BY scan_id")(lambda d: insights.json_counts(d.results, "scan_id", "engine_name"))
_t = "(1 / (1 + 0.2316419::DOUBLE * abs({0})))"
_tail = f"0.3989423 * exp(-{{0}} * {{0}} / 2) * {_t} * (0.3193815 + {_t} * (-0.3565638 + {_t} * (1.781478 + {_t} * (-1.821256 + {_t} * 1.330274))))"
_ncdf = lambda x: f"CASE WHEN {x} > 0 THEN 1 - {_tail.format(x)} ELSE {_tail.format(x)} END"
Q(
    "fn_option_value",
    f"""WITH x AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS p, (ln(o_totalprice / 200000.0::DOUBLE) + (0.05 + 0.4 * 0.4 / 2) * 0.25) / (0.4 * sqrt(0.25)) AS d1 FROM orders), y AS (SELECT *, d1 - 0.4 * sqrt(0.25) AS d2 FROM x)
    SELECT id, round(p * ({_ncdf('d1')}) - 200000 * exp(-0.05 * 0.25::DOUBLE) * ({_ncdf('d2')}), 3) AS value FROM y""",
)(lambda d: d.table("orders").select(F.col("o_orderkey").alias("id"), F.round(fn.option_value(F.col("o_totalprice").cast("double"), F.lit(200000.0), 0.25, 0.05, 0.4), 3).alias("value")))
PHRASES = (*insights.BOILERPLATE, "const h = createHash", "return fallback;")
_hits = " + ".join(f"(length(content) - length(replace(content, '{p}', ''))) / {len(p)}" for p in PHRASES)
Q(
    "gr_genome",
    f"""WITH {PAIRS}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM p UNION ALL SELECT dst FROM p) GROUP BY id), t AS (SELECT degree / sum(degree) OVER () AS q FROM deg), h AS (SELECT floor(round(-sum(q * log2(q)) / log2(count(*)), 9) * 10000 + 0.5) / 10000 AS e FROM t),
    o AS (SELECT k, count(*) AS n FROM (SELECT id, count(src) AS k FROM (SELECT id FROM deg) LEFT JOIN p ON src = id GROUP BY id) GROUP BY k), s AS (SELECT sha256(string_agg(k || ':' || n, '|' ORDER BY k))[1:16] AS topology FROM o),
    m AS (SELECT repo_id, avg(len(regexp_extract_all(content, 'if|for|while|switch|catch|&&|\\|\\||\\?')) + 1) AS a, CASE WHEN sum(length(content)) > 0 THEN least(1.0::DOUBLE, 500 * sum({_hits}) / sum(length(content))) ELSE 0 END AS b FROM d_all GROUP BY repo_id), r AS (SELECT repo_id, a, b, topology, round(least(1.0, a / 15) * 0.35 + e * 0.45 + b * 0.2, 9) AS x FROM m, h, s)
    SELECT repo_id, floor(round(a, 9) * 100 + 0.5) / 100 AS mean_complexity, floor(round(b, 9) * 10000 + 0.5) / 10000 AS boilerplate, floor(x * 10000 + 0.5) / 10000 AS mutation, CASE WHEN x > 0.75 THEN 'critical_decay' WHEN x > 0.45 THEN 'degrading' ELSE 'stable' END AS decay,
      CAST(CASE WHEN x > 0.75 THEN greatest(7, floor(30 * (1 - x))) WHEN x > 0.45 THEN greatest(30, floor(180 * (1 - x))) ELSE 365 END AS BIGINT) AS days_left, topology FROM r""",
)(lambda d: insights.genome(d.everything, graph.degree_entropy(d.edges), insights.topology(graph.degree(d.edges.select("src", "dst").distinct())), PHRASES))


def _reach(d: Domain, types: list[str]):
    roots = d.nodes.filter("id % 1000 % 15 = 0").select(F.col("id").alias("root"), F.col("id").alias("node"))
    return graph.bfs(d.edges, roots, 10, types)


REACH = """r AS (SELECT n AS root, n AS node, 0 AS depth FROM (SELECT id AS n FROM d_nodes WHERE id % 1000 % 15 = 0) UNION SELECT root, dst, depth + 1 FROM r JOIN s ON node = src WHERE depth < 10)"""
Q(
    "gr_fat_handlers",
    f"""WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges WHERE type IN ('calls', 'data_flow')), {REACH} SELECT CAST(root AS BIGINT) AS root, count(DISTINCT node % 5) AS kinds FROM r WHERE node % 5 < 4 GROUP BY root HAVING count(DISTINCT node % 5) >= 3""",
)(lambda d: _reach(d, ["calls", "data_flow"]).filter("node % 5 < 4").groupBy("root").agg(F.count_distinct(F.col("node") % 5).alias("kinds")).filter("kinds >= 3"))
Q(
    "gr_reach_coverage",
    f"""WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges), {REACH}, x AS (SELECT root, count(DISTINCT node) FILTER (node % 10 = 5) AS sinks, bool_or(node % 10 = 3) AS washed FROM r GROUP BY root),
    g AS (SELECT root // 1000 AS graph, CAST(sum(sinks) AS BIGINT) AS boundaries, CAST(coalesce(sum(sinks) FILTER (washed), 0) AS BIGINT) AS sanitised FROM x GROUP BY ALL)
    SELECT CAST(graph AS BIGINT) AS graph, boundaries, sanitised, CAST(CASE WHEN boundaries > 0 THEN floor(round(100 * sanitised / boundaries, 9) + 0.5) ELSE 100 END AS BIGINT) AS coverage, CAST(CASE WHEN boundaries > 0 THEN floor(round((1 - (boundaries - sanitised) / boundaries) * 100, 9) + 0.5) ELSE 100 END AS BIGINT) AS integrity,
      CAST(greatest(0, least(100, CASE WHEN boundaries > 0 THEN floor(round((1 - (boundaries - sanitised) / boundaries) * 100, 9) + 0.5) ELSE 100 END - 5 * (boundaries - sanitised))) AS BIGINT) AS score FROM g""",
)(
    lambda d: graph.reach_coverage(
        d.edges, d.nodes.filter("id % 1000 % 15 = 0").select(F.col("id").alias("root"), F.col("id").alias("node")), F.col("node") % 10 == 5, F.col("node") % 10 == 3, F.floor(F.col("root") / 1000)
    )
)
Q(
    "gr_complexity_score",
    f"""WITH {CODE_LINES}, {IMPORTS}, x AS (SELECT repo_id, path, {BR} AS b, greatest(coalesce(sum(len(regexp_extract_all(line, '\\{{')) - len(regexp_extract_all(line, '\\}}'))) OVER (PARTITION BY repo_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS d FROM lines),
    c AS (SELECT repo_id, path, CAST(sum(b * (1 + d)) AS BIGINT) AS cognitive FROM x GROUP BY ALL), i AS (SELECT repo_id, path, count(DISTINCT target) AS dependencies FROM imports GROUP BY ALL),
    m AS (SELECT repo_id, path, CAST(len(regexp_extract_all(content, '\\b(?:if|for|while|case|catch)\\b|&&|\\|\\||\\?')) + 1 AS INT) AS cyclomatic, coalesce(cognitive, 0) AS cognitive, coalesce(dependencies, 0) AS dependencies FROM d_code LEFT JOIN c USING (repo_id, path) LEFT JOIN i USING (repo_id, path))
    SELECT *, CAST(least(100, floor(round((0.4::DOUBLE * cyclomatic + 0.4::DOUBLE * cognitive + 0.2::DOUBLE * dependencies) * 5, 6) + 0.5)) AS BIGINT) AS score FROM m""",
)(lambda d: insights.node_complexity(d.code, _code_lines(d), code.imports(d.code), ["repo_id", "path"]))
Q(
    "gr_async_chains",
    """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM d_edges WHERE type = 'calls' AND src % 2 = 0 AND dst % 2 = 0 AND src <> dst), r AS (SELECT n AS root, n AS node, 0 AS depth FROM (SELECT id AS n FROM d_nodes WHERE id % 2 = 0) UNION SELECT root, dst, depth + 1 FROM r JOIN s ON node = src WHERE depth < 6)
    SELECT CAST(root AS BIGINT) AS root, max(d) AS chain FROM (SELECT root, node, min(depth) AS d FROM r GROUP BY ALL) GROUP BY root HAVING max(d) > 0""",
)(
    lambda d: graph.bfs(d.edges.filter("type = 'calls' AND src % 2 = 0 AND dst % 2 = 0 AND src <> dst"), d.nodes.filter("id % 2 = 0").select(F.col("id").alias("root"), F.col("id").alias("node")), 6).groupBy("root").agg(F.max("depth").alias("chain")).filter("chain > 0")
)


#: What shows a source, a sink and a sanitiser in a file, and the files that patterns are made of: vulnerable, clean.
TAINT = (("source", "(?i)user|track|password"), ("sink", "(?i)html|query|eval"), ("sanitiser", "(?i)sanit|licen"))
PATTERNS = ((3, 10), (4, None))


def _pattern_sigs(d: Domain):
    """Every file's signature with what shows in it, from one scan."""
    return _signatures(d.files.select("*", *[F.col("content").rlike(p).alias(n) for n, p in TAINT]), *[n for n, _ in TAINT])


def _matched(d: Domain):
    """The files that patterns are made of are looked up before they are signed."""
    wanted = sorted({k for pattern in PATTERNS for k in pattern if k is not None})
    own = _signatures(d.files.filter(F.col("file_id").isin(wanted))).agg(*[F.first(F.when(F.col("id") == k, F.col("signature")), ignorenulls=True).alias(f"s{k}") for k in wanted])
    pair = lambda bad, clean: F.struct(F.lit(f"p{bad}").alias("pattern"), F.col(f"s{bad}").alias("vulnerable"), (F.col(f"s{clean}") if clean is not None else F.lit(None).cast("array<bigint>")).alias("clean"))
    # A pattern without one of its files has no rows.
    whole = [F.when(F.col(f"s{bad}").isNotNull() & (F.col(f"s{clean}").isNotNull() if clean is not None else F.lit(True)), pair(bad, clean)) for bad, clean in PATTERNS]
    return insights.pattern_match(_pattern_sigs(d), own.select(F.explode(F.array_compact(F.array(*whole))).alias("x")).select("x.*"))


_taint = ", ".join(f"regexp_matches(content, '{p}') AS {n}" for n, p in TAINT)
_pattern = lambda bad, clean: f"SELECT a.id, 'p{bad}' AS pattern, {SAME} AS s, " + (f"{SAME} - {SAME.replace('b.', 'c.')} AS d FROM sigs a, sigs b, sigs c WHERE b.id = {bad} AND c.id = {clean}" if clean else f"{SAME} AS d FROM sigs a, sigs b WHERE b.id = {bad}")
Q(
    "sm_pattern_match",
    f"""WITH {SIGNED}, t AS (SELECT file_id AS id, {_taint} FROM d_files), m AS ({' UNION ALL '.join(_pattern(*p) for p in PATTERNS)}), x AS (SELECT m.*, source AND sink AS tainted, sanitiser FROM m JOIN t USING (id))
    SELECT id, pattern, floor(round(s, 9) * 10000 + 0.5) / 10000 AS similarity, floor(round(d, 9) * 10000 + 0.5) / 10000 AS differential, tainted, CASE WHEN s = 1 AND tainted AND NOT sanitiser THEN 'match' WHEN s > 0.5 AND tainted AND NOT sanitiser THEN 'zero-day' WHEN d < -0.15 OR (tainted AND sanitiser) THEN 'looks-clean' ELSE 'insufficient-evidence' END AS verdict,
      floor(round(least(1.0::DOUBLE, greatest(0, (s = 1)::INT * 0.35::DOUBLE + 0.25::DOUBLE * s + tainted::INT * 0.2::DOUBLE + (tainted AND NOT sanitiser)::INT * 0.1::DOUBLE + 0.1::DOUBLE * greatest(d, 0) - sanitiser::INT * 0.15::DOUBLE)), 9) * 10000 + 0.5) / 10000 AS probability FROM x""",
)(_matched)
Q(
    "sm_depth_node_ratio",
    "SELECT a.id, b.id AS other, floor(round(least(a.n, b.n) / greatest(a.n, b.n), 9) * 10000 + 0.5) / 10000 AS depth_ratio, floor(round(least(a.m, b.m) / greatest(a.m, b.m), 9) * 10000 + 0.5) / 10000 AS node_ratio FROM (SELECT p_partkey AS id, p_size + 1 AS n, p_retailprice AS m FROM part) a JOIN (SELECT p_partkey AS id, p_size + 1 AS n, p_retailprice AS m FROM part) b ON b.id = a.id + 1",
)(
    lambda d: insights.depth_node_ratio(
        d.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1).alias("depth_a"), F.col("p_retailprice").alias("nodes_a")).join(d.table("part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_partkey").alias("other"), (F.col("p_size") + 1).alias("depth_b"), F.col("p_retailprice").alias("nodes_b")), "id")
    )
)
def _featured(d: Domain):
    return d.nodes.select(F.floor(F.col("id") / 1000).alias("repo"), "id", (F.col("id") % 4).alias("type"), (F.col("id") % 1000 * 25).alias("line"), F.col("cost").alias("bundle"), (F.col("id") * 7 % 13 + 1).alias("complexity"))


_fs = [
    "(a.type = b.type)::INT::DOUBLE", "1 - least(1.0::DOUBLE, abs(a.line - b.line) / 1000)", "(e.lo IS NOT NULL)::INT::DOUBLE", "(e.lo IS NOT NULL AND a.degree > 2 AND b.degree > 2)::INT::DOUBLE",
    "1 - abs(a.degree - b.degree) / a.md", "1 - abs(a.line - b.line) / a.ml", "1 - abs(a.bundle - b.bundle) / greatest(a.bundle + b.bundle, 1)", "1 - abs(a.complexity - b.complexity) / a.mc",
]
_r4 = lambda x: f"floor(round({x}, 9) * 10000 + 0.5) / 10000"
_twos = " + ".join(f"f{i} * f{j}" for i in range(8) for j in range(i + 1, 8))
Q(
    "sm_pair_features",
    f"""WITH {PAIRS}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM p UNION ALL SELECT dst FROM p WHERE src <> dst) GROUP BY id), k AS (SELECT id // 1000 AS repo, id, id % 4 AS type, id % 1000 * 25 AS line, cost AS bundle, id * 7 % 13 + 1 AS complexity, row_number() OVER (PARTITION BY id // 1000 ORDER BY id) AS k FROM d_nodes),
    n AS (SELECT k.*, coalesce(degree, 0) AS degree FROM k LEFT JOIN deg USING (id) WHERE k <= 128), m AS (SELECT *, greatest(1, max(degree) OVER w) AS md, greatest(1, max(line) OVER w) AS ml, greatest(1, max(complexity) OVER w) AS mc FROM n WINDOW w AS (PARTITION BY repo)),
    e AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM p), x AS (SELECT a.repo, {', '.join(f'{f} AS f{k}' for k, f in enumerate(_fs))} FROM m a JOIN m b ON a.repo = b.repo LEFT JOIN e ON e.lo = least(a.id, b.id) AND e.hi = greatest(a.id, b.id))
    SELECT CAST(repo AS BIGINT) AS repo, count(*) AS pairs, {_r4('sum(' + ' + '.join(f'f{k}' for k in range(8)) + ') / (count(*) * 8)')} AS mean, {_r4('max(greatest(' + ', '.join(f'f{k}' for k in range(8)) + '))')} AS max,
      {_r4('sum(' + ' + '.join(f'(f{k} < 0.01)::INT' for k in range(8)) + ') / (count(*) * 8)')} AS sparsity, {_r4(f'sum({_twos}) / (count(*) * 28)')} AS co_activation FROM x GROUP BY repo""",
)(lambda d: insights.pair_features_by_repo(_featured(d), d.links, F.floor(F.col("src") / 1000)))


def _registry(d: Domain):
    registry = insights.RuleRegistry()
    registry.register("eval", "injection", lambda lines: lines.filter(F.col("line").rlike(r"^if .*\beval\(")).withColumn("severity", F.lit("critical")))
    registry.register("password", "secrets", lambda lines: lines.filter(F.col("line").contains("password")).withColumn("severity", F.lit("high")))
    registry.register("unbuilt", "injection", lambda lines: lines.select("no_such_column"))
    registry.register("broken", "injection", lambda lines: lines.withColumn("severity", F.raise_error(F.concat(F.lit("at "), "path")).cast("string")))
    return registry.run(_code_lines(d))


def _mask_registry(d: Domain):
    registry = insights.RuleRegistry()
    registry.register_mask("eval", "injection", "critical", lambda lines: pc.match_substring_regex(lines.column("line"), r"^if .*\beval\("))
    registry.register_mask("password", "secrets", "high", lambda lines: pc.match_substring(lines.column("line"), "password"))
    registry.register_mask("unbuilt", "injection", "high", lambda lines: lines.column("no_such_column"))
    registry.register_mask("broken", "injection", "high", lambda lines: [len(x) // (len(x) - len(x)) > 0 for x in lines.column("line").to_pylist()])
    return registry.run(_code_lines(d))


REGISTRY_SQL = f"""WITH {CODE_LINES} SELECT 'eval' AS rule, 'injection' AS category, path, line_no, 'critical' AS severity FROM lines WHERE regexp_matches(line, '^if .*\\beval\\(') UNION ALL SELECT 'password', 'secrets', path, line_no, 'high' FROM lines WHERE contains(line, 'password')
    UNION ALL SELECT unnest(['unbuilt', 'broken']), 'injection', NULL, NULL, 'info'"""
Q("rl_registry", REGISTRY_SQL)(_registry)
Q("udf_rule_registry", REGISTRY_SQL)(_mask_registry)
Q(
    "udaf_shannon",
    "WITH c AS (SELECT agent_name, title, count(*) AS n FROM d_issues GROUP BY ALL), p AS (SELECT agent_name, n / sum(n) OVER (PARTITION BY agent_name) AS p FROM c) SELECT agent_name, floor(round(-sum(p * log2(p)), 9) * 10000 + 0.5) / 10000 AS entropy FROM p GROUP BY agent_name",
)(lambda d: insights.group_entropy(d.issues, "agent_name", "title"))
Q("udtf_literals", f"""WITH {CODE_LINES} SELECT repo_id, path, line_no, unnest(regexp_extract_all(line, '"([^"]+)"', 1)) AS literal FROM lines""")(
    lambda d: _code_lines(d).select("repo_id", "path", "line_no", F.explode(F.regexp_extract_all("line", F.lit('"([^"]+)"'), F.lit(1))).alias("literal"))
)
Q("udtf_cost_breakdown", f"WITH {NODES} SELECT id, unnest(['cost', 'twice']) AS metric, unnest([cost, cost * 2]) AS value FROM nodes")(lambda d: d.nodes.withColumn("twice", F.col("cost") * 2).unpivot("id", ["cost", "twice"], "metric", "value"))
IMPORT_SQL = "imp AS (SELECT DISTINCT repo_id, regexp_extract(content, '\\./(p[0-9]+)\"', 1) AS name FROM d_code)"
Q("jn_unused_components", f"WITH {IMPORT_SQL} SELECT repo_id, path FROM d_code c WHERE regexp_matches(path, '^src/') AND NOT EXISTS (SELECT 1 FROM imp WHERE imp.repo_id = c.repo_id AND imp.name = regexp_extract(path, '([^/]+)\\.ts$', 1))")(
    lambda d: insights.unused_components(d.code, code.imports(d.code), "^src/")
)
Q(
    "jn_undocumented_env",
    """WITH u AS (SELECT DISTINCT repo_id, unnest(regexp_extract_all(content, 'process\\.env\\.([A-Z_0-9]+)', 1)) AS name FROM d_code), m AS (SELECT repo_id, string_agg(name, ',' ORDER BY name) AS missing, count(*) AS n FROM u WHERE NOT (repo_id % 2 = 0 AND name IN ('KEY_0', 'KEY_3')) GROUP BY repo_id)
    SELECT repo_id, missing, n * 5 + CASE WHEN repo_id % 2 = 0 THEN 0 ELSE 30 END AS penalty FROM m""",
)(lambda d: insights.undocumented_env(d.code, d.code.filter("repo_id % 2 = 0").select("repo_id", F.explode(F.array(F.lit("KEY_0"), F.lit("KEY_3"))).alias("name")).distinct()))


def _migrations(d: Domain):
    k = F.col("p_partkey")
    text = F.concat(F.lit("create table t"), (k % 9).cast("string"), F.lit(" (id int);\n"), F.when(k % 4 == 0, F.concat(F.lit("create policy p on t"), (k % 9).cast("string"))).otherwise(""))
    return d.table("part").select((k % 40).alias("repo_id"), text.alias("content"))


Q(
    "jn_missing_policy",
    """WITH m AS (SELECT DISTINCT p_partkey % 40 AS repo_id, 't' || p_partkey % 9 AS name FROM part), h AS (SELECT DISTINCT p_partkey % 40 AS repo_id, 't' || p_partkey % 9 AS name FROM part WHERE p_partkey % 4 = 0)
    SELECT m.repo_id, coalesce(string_agg(CASE WHEN h.name IS NULL THEN m.name END, ',' ORDER BY m.name), '') AS open_tables, CAST(floor(100 * count(h.name) / count(*) + 0.5) AS BIGINT) AS coverage FROM m LEFT JOIN h ON m.repo_id = h.repo_id AND m.name = h.name GROUP BY m.repo_id""",
)(lambda d: insights.missing_policy(_migrations(d)))


def _pairs(d: Domain):
    k = F.col("event_id")
    flags = {"has_auth": k % 3 > 0, "validates": k % 4 > 0, "tainted": k % 5 == 0, "reaches_db": k % 2 == 0, "sanitized": k % 20 == 0, "exact": k % 30 == 0, "get": k % 7 == 0, "has_body": k % 6 == 0, "has_id": k % 9 == 0}
    return d.table("events").select(k.alias("id"), *[v.alias(n) for n, v in flags.items()])


Q(
    "jn_boundary_findings",
    "SELECT event_id AS id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'auth_gap' END, CASE WHEN event_id % 4 = 0 THEN 'missing_validation' END, CASE WHEN event_id % 10 = 0 THEN 'tainted_flow' END) AS findings, CAST(100 - 8 * ((event_id % 3 = 0)::INT + (event_id % 4 = 0)::INT + (event_id % 10 = 0)::INT) AS INT) AS integrity FROM events",
)(lambda d: insights.boundary_findings(_pairs(d)))
Q("jn_boundary_taint", "SELECT event_id AS id, CASE WHEN event_id % 20 = 0 THEN 65 WHEN event_id % 30 = 0 THEN 92 ELSE 78 END AS confidence FROM events WHERE event_id % 10 = 0")(lambda d: insights.boundary_taint(_pairs(d)))
Q(
    "jn_type_mismatch",
    "SELECT event_id AS id, 'id without auth' AS mismatch FROM events WHERE event_id % 9 = 0 UNION ALL SELECT event_id, 'body on GET' FROM events WHERE event_id % 42 = 0 UNION ALL SELECT event_id, 'db without auth' FROM events WHERE event_id % 6 = 0",
)(lambda d: insights.type_mismatch(_pairs(d)))
LEAK_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(concat_ws(' ', title, description)), '{r[1]}') THEN '{r[0]}'" for r in insights.LEAKS) + " END"
Q(
    "fn_revenue_leak",
    f"WITH x AS (SELECT scan_id, k1, k2, k3, {LEAK_SQL} AS leak, CASE WHEN scan_id % 2 = 0 THEN 100 ELSE 1 END AS f FROM d_issues) SELECT scan_id, k1, k2, k3, leak, CAST(floor(CASE leak " + " ".join(f"WHEN '{r[0]}' THEN {r[2]}" for r in insights.LEAKS) + " END / f + 0.5) AS BIGINT) AS least, CAST(floor(CASE leak " + " ".join(f"WHEN '{r[0]}' THEN {r[3]}" for r in insights.LEAKS) + " END / f + 0.5) AS BIGINT) AS most FROM x",
)(lambda d: insights.revenue_leak(d.issues, F.col("scan_id") % 2 == 0).select("scan_id", *ISSUE_ORDER, "leak", "least", "most"))
Q(
    "rl_pack_cost",
    f"""WITH {CODE_LINES}, {NODES} SELECT 'R-EVAL' AS kind, path AS subject FROM lines WHERE regexp_matches(line, '(?i)\\beval\\s*\\(') AND NOT regexp_matches(line, '^\\s*//') UNION ALL SELECT 'R-FETCH', path FROM lines WHERE regexp_matches(line, '(?i)\\bfetch\\s*\\(')
    UNION ALL SELECT 'dead_code', CAST(id AS VARCHAR) FROM nodes WHERE NOT exported AND id NOT IN (SELECT dst FROM d_edges WHERE type IN ('calls', 'imports')) UNION ALL SELECT 'busy_api', file_path FROM d_issues GROUP BY file_path HAVING count(*) > 5""",
)(lambda d: rules.pack_cost(rules.pack_scan(_code_lines(d), ["repo_id", "path"]), graph.dead_code(d.nodes, d.edges), d.issues.select(F.col("file_path").alias("path"))))


def _compliance(d: Domain):
    paths = d.issues.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("scan_id", *ISSUE_ORDER)]).alias("id"), (F.col("scan_id") % 10).alias("repo"), insights.data_class(F.col("description")).alias("class"), (F.col("confidence") / 100).alias("confidence"))
    table = d.spark.createDataFrame([("R1", "pci", ["encrypt", "log"]), ("R2", "pii", ["consent", "erase", "log"])], "rule string, class string, needs array<string>")
    controls = d.issues.select((F.col("scan_id") % 10).alias("repo")).distinct().filter("repo % 2 = 0").select("repo", F.lit("log").alias("control"))
    return insights.compliance(paths, table, controls, 0.6)


Q(
    "rl_compliance",
    """WITH x AS (SELECT concat_ws('-', scan_id, k1, k2, k3) AS id, scan_id % 10 AS repo, CASE WHEN regexp_matches(lower(description), 'card|cvv|iban|payment') THEN 'pci' WHEN regexp_matches(lower(description), 'patient|diagnosis|medical') THEN 'phi' WHEN regexp_matches(lower(description), 'password|secret|token|api[_-]?key') THEN 'credentials' WHEN regexp_matches(lower(description), 'email|phone|address|user') THEN 'pii' END AS class FROM d_issues WHERE confidence >= 60)
    SELECT id, 'R1' AS rule, 0.0::DOUBLE AS covered FROM x WHERE class = 'pci' AND repo % 2 = 1 UNION ALL SELECT id, 'R2', CASE WHEN repo % 2 = 0 THEN 0.3333::DOUBLE ELSE 0 END FROM x WHERE class = 'pii'""",
)(_compliance)


def _udaf(d: Domain):
    fold = fusion.ds_udaf()
    one = fusion.evidence_mass(d.issues).select("scan_id", (F.col("k1") * 10_000_000_000 + F.col("k2") * 100_000 + F.col("k3")).alias("seq"), F.element_at("masses", 1).alias("m"))
    # A number of partitions of its own: small rows would else be put into one task, where Python folds them one group after the other.
    spread = one.repartition(int(d.spark.conf.get("spark.sql.shuffle.partitions")), "scan_id")
    folded = spread.groupBy("scan_id").agg(fold("seq", "m.v", "m.n", "m.u", "m.r").alias("f"))
    return folded.select("scan_id", F.get("f", F.lit(3)).cast("int").alias("reports"), *[fn.half_up(F.round(F.get("f", F.lit(k)), 9), 4).alias(c) for k, c in enumerate("vnu")])


Q("udaf_ds", f"WITH {GROUP_FOLD} SELECT scan_id, CAST(reports AS INT) AS reports, v, n, u FROM folded")(_udaf)
