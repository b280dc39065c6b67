"""Queries of the analysers' scores over the repositories' source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.operators import analysers, rules
from risklake.plans.book import Book
from risklake.plans.domain import Domain
from risklake.sources import code

BOOK = Book()
Q = BOOK.add

LINES = "lines AS (SELECT repo_id, path, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line FROM (SELECT repo_id, path, string_split(content, chr(10)) AS parts FROM d_source))"


#: The same over documents and pages as well.
ALL_LINES = LINES.replace("d_source", "d_all")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def met(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def band(names: tuple[str, ...]) -> str:
    return f"CASE WHEN score >= 80 THEN '{names[0]}' WHEN score >= 60 THEN '{names[1]}' WHEN score >= 40 THEN '{names[2]}' ELSE '{names[3]}' END"


def _lines(d: Domain):
    return code.code_lines(d.source, "repo_id", "path")


def _all_lines(d: Domain):
    return code.code_lines(d.everything, "repo_id", "path")


_crypto = {e: " + ".join(f"count(*) FILTER ({met('line', p)})" for _, p, effect in analysers.CRYPTO if effect == e) for e in ("critical", "high", "medium", "modern")}
Q(
    "ag_crypto_score",
    f"WITH {LINES}, t AS (SELECT repo_id, {', '.join(f'{s} AS {e}' for e, s in _crypto.items())} FROM lines GROUP BY repo_id), s AS (SELECT *, least(100, greatest(0, 100 - 25 * critical - 15 * high - 5 * medium + 3 * modern)) AS score FROM t) SELECT *, {band(('strong', 'adequate', 'weak', 'critical'))} AS band FROM s",
)(lambda d: analysers.crypto_score(_lines(d)))
_algorithms = " UNION ALL ".join(f"SELECT repo_id, '{n}' AS algorithm, '{e}' AS effect, path, line_no FROM lines WHERE {met('line', p)}" for n, p, e in analysers.ALGORITHMS)
Q(
    "ag_pq_inventory",
    f"""WITH {LINES}, h AS ({_algorithms}), i AS (SELECT repo_id, algorithm, effect, string_agg(path || ':' || line_no, ',' ORDER BY path, line_no) AS locations, count(*) AS n FROM h GROUP BY ALL),
    s AS (SELECT *, greatest(0, 100 - 30 * count(*) FILTER (effect = 'shor') OVER (PARTITION BY repo_id) - 15 * count(*) FILTER (effect = 'grover') OVER (PARTITION BY repo_id)) AS score FROM i) SELECT *, {band(('low', 'medium', 'high', 'critical'))} AS risk FROM s""",
)(lambda d: analysers.pq_inventory(_lines(d)))
_hacks = " + ".join(f"{met('content', p)}::INT" for p, _ in analysers.SCORE_HACKS)
_fraud = " + ".join(f"len(list_filter(string_split(content, chr(10)), lambda x: {met('x', p)})) * {r}" for p, r in analysers.SCORE_HACKS)
_broken = " + ".join(f"({'NOT ' if must else ''}{met('content', p)})::INT" for _, p, must in analysers.INVARIANTS)
Q(
    "ag_reward_score",
    f"""WITH f AS (SELECT repo_id, {_broken} AS v, {_hacks} AS h, {_fraud} AS r FROM d_source), t AS (SELECT repo_id, CAST(sum(v) AS BIGINT) AS violations, CAST(sum(h) AS BIGINT) AS hacks, CAST(sum(r) AS BIGINT) AS fraud FROM f GROUP BY repo_id),
    s AS (SELECT *, CAST(least(100, greatest(0, floor(100 - 15 * violations - 8 * hacks - 0.5 * fraud + 0.5))) AS BIGINT) AS score FROM t) SELECT *, CASE WHEN score >= 80 AND violations = 0 AND hacks = 0 THEN 'safe' WHEN score >= 50 AND hacks <= 2 THEN 'at-risk' ELSE 'critical' END AS risk FROM s""",
)(lambda d: analysers.reward_score(d.source))
_times = lambda p: f"len(regexp_extract_all(line, {quoted(p)}))"
Q(
    "ag_memory_ops",
    f"""WITH {LINES}, t AS (SELECT repo_id, CAST(sum({' + '.join(_times(p) for p, _ in analysers.ALLOCATIONS)}) AS BIGINT) AS allocations, CAST(sum({' + '.join(f'{_times(p)} * {b}' for p, b in analysers.ALLOCATIONS)}) AS BIGINT) AS bytes,
      CAST(sum({' + '.join(map(_times, analysers.MUTATIONS))}) AS BIGINT) AS mutations, CAST(sum({' + '.join(map(_times, analysers.DEALLOCATIONS))}) AS BIGINT) AS deallocations, count(*) FILTER (regexp_matches(line, '\\b(for|while)\\s*\\(') AND regexp_matches(line, 'new\\s+')) AS loop_points FROM lines GROUP BY repo_id)
    SELECT *, CASE WHEN allocations > 0 THEN least(100, CAST(floor(allocations / greatest(1, allocations + deallocations) * 100 + 0.5) AS BIGINT)) ELSE 0 END AS pressure FROM t""",
)(lambda d: analysers.memory_ops(_lines(d)))
Q(
    "ag_resilience_patterns",
    f"""WITH f AS (SELECT repo_id, {', '.join(f'bool_or({met("content", p)}) AS {n}' for n, p, _ in analysers.RESILIENCE)} FROM d_all GROUP BY repo_id),
    s AS (SELECT repo_id, concat_ws(',', {', '.join(f"CASE WHEN {n} THEN '{n}' END" for n, _, _ in analysers.RESILIENCE)}) AS patterns, CAST(least(100, {' + '.join(f'{n}::INT * {w}' for n, _, w in analysers.RESILIENCE)}) AS BIGINT) AS score FROM f) SELECT *, {band(('resilient', 'moderate', 'fragile', 'brittle'))} AS band FROM s""",
)(lambda d: analysers.resilience_patterns(d.everything))
KINDS = ("n_plus_one", "sync_blocking", "heavy_import", "memory_leak", "dead_code")
KIND_SQL = "CASE k3 % 40 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(KINDS)) + " ELSE 'other' END"


def _perf(d: Domain):
    findings = d.issues.select(F.col("scan_id").alias("repo"), F.expr(KIND_SQL).alias("category"), "severity")
    functions = d.table("lineitem").select(F.col("l_orderkey").alias("repo"), F.col("l_quantity").cast("int").alias("complexity"))
    return analysers.perf_scores(findings, functions, d.table("orders").select(F.col("o_orderkey").alias("repo"), F.floor(F.col("o_totalprice") / 500).alias("kb")))


Q(
    "ag_perf_scores",
    f"""WITH f AS (SELECT scan_id, {', '.join(f"count(*) FILTER ({KIND_SQL} = '{c}') AS {c}" for c in KINDS)}, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM d_issues GROUP BY scan_id),
    w AS (SELECT l_orderkey, avg(CAST(l_quantity AS INT)) AS mean, count(*) FILTER (CAST(l_quantity AS INT) > 15) AS complex FROM lineitem GROUP BY l_orderkey),
    j AS (SELECT o_orderkey AS repo, floor(o_totalprice / 500) AS kb, coalesce(mean, 1) AS mean, coalesce(complex, 0) AS complex, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*KINDS, 'critical', 'high'))} FROM orders LEFT JOIN f ON o_orderkey = scan_id LEFT JOIN w ON o_orderkey = l_orderkey)
    SELECT repo, greatest(0, 100 - least(n_plus_one * 15, 40) - least(sync_blocking * 20, 40) - critical * 10 - high * 5) AS performance, greatest(0, 100 - CASE WHEN kb > 500 THEN 20 WHEN kb > 200 THEN 10 ELSE 0 END - heavy_import * 5) AS bundle,
      floor(round(greatest(0, 100 - complex * 8 - greatest(0, mean - 5) * 5), 9) * 10000 + 0.5) / 10000 AS complexity, greatest(0, 100 - memory_leak * 15 - dead_code * 3) AS reliability FROM j""",
)(_perf)
Q(
    "ag_llm_guard",
    """WITH e AS (SELECT scan_id AS repo, CAST(floor(count(*) FILTER (status_code = 200) / count(*) * 100 + 0.5) AS BIGINT) AS coverage FROM d_traffic GROUP BY scan_id),
    f AS (SELECT scan_id AS repo, sum(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END) AS lost FROM d_issues WHERE agent_name = 'Auth Agent' GROUP BY scan_id)
    SELECT coalesce(e.repo, f.repo) AS repo, coalesce(coverage, 100) AS coverage, CAST(greatest(0, 100 - coalesce(lost, 0)) AS BIGINT) AS score FROM e FULL JOIN f ON e.repo = f.repo""",
)(lambda d: analysers.llm_guard(d.traffic.select(F.col("scan_id").alias("repo"), (F.col("status_code") == 200).alias("sanitized")), d.issues.filter("agent_name = 'Auth Agent'").select(F.col("scan_id").alias("repo"), "severity")))
PENALTY_SQL = "CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 15 WHEN 'medium' THEN 10 ELSE 5 END"
PLACE_SQL = "CASE k1 % 3 WHEN 0 THEN 'docker' WHEN 1 THEN 'ci' ELSE 'env_vars' END"
Q(
    "ag_deploy_score",
    f"""WITH r AS (SELECT scan_id AS repo, {', '.join(f"100 - coalesce(sum(CASE WHEN {PLACE_SQL} = '{c}' THEN {PENALTY_SQL} END), 0) AS {c}" for c in ('docker', 'ci', 'env_vars'))} FROM d_issues GROUP BY scan_id)
    SELECT repo, CAST(greatest(0, docker) AS BIGINT) AS docker, CAST(greatest(0, ci) AS BIGINT) AS ci, CAST(greatest(0, env_vars) AS BIGINT) AS env_vars, CAST(greatest(0, floor(round(docker * 0.4 + ci * 0.4 + env_vars * 0.2, 6) + 0.5)) AS BIGINT) AS score FROM r""",
)(lambda d: analysers.deploy_score(d.issues.select(F.col("scan_id").alias("repo"), F.expr(PLACE_SQL).alias("category"), F.expr(PENALTY_SQL).alias("penalty"))))
_kinds = {"content": lambda p: met("content", p), "path": lambda p: met("path", p), "build": lambda p: met("path", analysers.BUILD_FILES) + " AND " + met("content", p), "health": lambda p: met("content", p) + " AND " + met("content", analysers.SERVED)}
_passed = [" AND ".join(f"bool_or({_kinds[k](p)})" for k, p in needs) for _, _, needs in analysers.DEPLOYMENT]
Q(
    "ag_deploy_checks",
    f"""WITH f AS (SELECT repo_id, {', '.join(f'{p} AS c{k}' for k, p in enumerate(_passed))} FROM d_source GROUP BY repo_id)
    {' UNION ALL '.join(f'SELECT repo_id, {quoted(name)} AS "check", {quoted(severity)} AS severity, c{k} AS passed, CAST(NOT c0 AS BIGINT) AS failed_critical FROM f' for k, (name, severity, _) in enumerate(analysers.DEPLOYMENT))}""",
)(lambda d: analysers.deploy_checks(d.source))
NODE_SQL = "CASE WHEN regexp_matches({0}, 'db[.]query') THEN 'dbquery' WHEN regexp_matches({0}, 'sanitize') THEN 'sanitizer' WHEN regexp_matches({0}, 'try [{{]') THEN 'try_catch' ELSE 'other' END"


def _ready(d: Domain):
    kind = F.when(F.col("line").rlike("db[.]query"), "dbquery").when(F.col("line").rlike("sanitize"), "sanitizer").when(F.col("line").rlike("try [{]"), "try_catch").otherwise("other")
    r = F.col("repo_id")
    scores = d.source.select("repo_id").distinct().select("repo_id", (40 + r * 13 % 61).alias("score"), (r % 3).alias("critical"), (r % 4).alias("blockers"))
    return analysers.readiness(d.source, _lines(d).select("repo_id", kind.alias("type")), scores)


a = analysers
Q(
    "ag_readiness",
    f"""WITH {LINES}, n AS (SELECT DISTINCT repo_id, {NODE_SQL.format('line')} AS type FROM lines), f AS (SELECT repo_id, bool_or({met('path', a.MIGRATION_PATH)}) AS m, bool_or({met('path', a.MODEL_PATH[0])} AND {met('path', a.MODEL_PATH[1])}) AS o, bool_or({met('content', a.VALIDATION)}) AS v, bool_or({met('content', a.ACCESS)}) AS c,
      bool_or({met('content', a.ERRORS)}) AS e, bool_or({met('path', a.TEST_PATH)} OR {met('content', a.TESTS)}) AS t, bool_or({met('path', a.CI_PATH)}) AS ci, repo_id IN (SELECT repo_id FROM n WHERE type = 'dbquery') AS q, repo_id IN (SELECT repo_id FROM n WHERE type = 'sanitizer') AS s, repo_id IN (SELECT repo_id FROM n WHERE type = 'try_catch') AS y FROM d_source GROUP BY repo_id),
    g AS (SELECT repo_id, (m AND q AND o)::BIGINT + (v OR s)::BIGINT + c::BIGINT + (e OR y)::BIGINT + t::BIGINT + ci::BIGINT AS passed, 40 + repo_id * 13 % 61 AS score, repo_id % 3 AS critical, repo_id % 4 AS blockers FROM f)
    SELECT repo_id, passed, CAST(floor(passed / 6 * 100 + 0.5) AS BIGINT) AS progress, CASE WHEN passed = 6 AND score >= 85 AND blockers = 0 AND critical = 0 THEN 'enterprise' WHEN passed >= 5 AND score >= 70 AND blockers <= 1 AND critical = 0 THEN 'market' WHEN passed >= 3 AND score >= 55 AND critical <= 1 THEN 'mvp' ELSE 'demo' END AS stage FROM g""",
)(_ready)
STATES = {"loading": "isLoading|Skeleton", "error": "isError|ErrorBoundary", "empty": "isEmpty|No results", "success": "onSuccess|toast"}
Q(
    "ag_state_coverage",
    f"""WITH c AS (SELECT repo_id, {', '.join(f'{met("content", p)} AS {s}' for s, p in STATES.items())}, contains(content, 'fetch(') AND NOT {met('content', STATES['loading'])} AS lacks FROM d_source WHERE path LIKE '%.tsx')
    SELECT repo_id, count(*) AS components, count(*) FILTER (loading OR error OR lacks) AS fetching, {', '.join(f'count(*) FILTER ({s}) AS with_{s}' for s in STATES)}, CAST(floor(avg(25 * ({' + '.join(f'{s}::INT' for s in STATES)})) + 0.5) AS BIGINT) AS coverage FROM c GROUP BY repo_id""",
)(
    lambda d: analysers.state_coverage(
        d.source.filter("path LIKE '%.tsx'").select("repo_id", *[F.col("content").rlike(p).alias(s) for s, p in STATES.items()], (F.col("content").contains("fetch(") & ~F.col("content").rlike(STATES["loading"])).alias("lacks_loading"))
    )
)
Q(
    "ag_feature_truth",
    """WITH r AS (SELECT repo_id, bool_or((contains(path, 'route') OR contains(path, 'api') OR contains(path, 'server')) AND regexp_matches(content, '(?i)(fetch|axios|prisma|drizzle|supabase|knex|mongodb)')) AS live FROM d_source GROUP BY repo_id),
    x AS (SELECT s.repo_id, path, live, regexp_matches(content, 'fetch\\s*\\(|axios|useQuery|useSWR|useAxios') AS f, regexp_matches(content, 'useState|useReducer|Context|localStorage') AS l, regexp_matches(content, 'form|submit|handleSubmit') AS m FROM d_source s JOIN r ON s.repo_id = r.repo_id WHERE regexp_matches(path, '\\.(tsx|jsx)$') AND NOT contains(path, 'node_modules'))
    SELECT repo_id, path, CASE WHEN f AND live THEN 'verified_live' WHEN f THEN 'partially_connected' ELSE 'mocked' END AS status, CASE WHEN f AND live THEN 90 WHEN f THEN 70 WHEN m THEN 88 ELSE 75 END AS confidence FROM x WHERE f OR m OR l""",
)(lambda d: analysers.feature_truth(d.source))

# Rules over the same files; SQL without lookahead says what must not follow in a second condition.
WITHOUT = {r"(?![\w-])": r"(?:[^\w-]|$)", r"(?![\"'`])": r"(?:[^\"'`]|$)"}
ALSO = {
    "No Input Validation on Route": (r"req\.body\.\w+\s*[;,]", r"req\.body\..*(\.parse|schema|validate|sanitize)"),
    "Stripe/Payment Webhook Without Signature Verification": (r"(?i)(?:stripe|webhook).*(?:on|listen|post|router).*body", r"(?i)body.*(stripe\.webhooks\.constructEvent|verifyWebhookSignature|stripe-signature|x-hub-signature)"),
}


def condition(name: str, pattern: str) -> str:
    if name in ALSO:
        yes, no = ALSO[name]
        return f"{met('line', yes)} AND NOT {met('line', no)}"
    for old, new in WITHOUT.items():
        pattern = pattern.replace(old, new)
    return met("line", pattern)


_secrets = " UNION ALL ".join(f"SELECT repo_id, path, {quoted(n)} AS rule, '{s}' AS severity, min(line_no) AS line_no FROM safe WHERE {condition(n, p)} GROUP BY repo_id, path" for n, p, s in rules.SECRETS)
Q("rl_secret_scan", f"WITH {ALL_LINES}, safe AS (SELECT * FROM lines WHERE NOT {met('line', rules.REFERENCE)} AND NOT {met('line', rules.PLACEHOLDER)}) {_secrets}")(
    lambda d: rules.secret_scan(_all_lines(d), ["repo_id", "path"]).select("repo_id", "path", "rule", "severity", "line_no")
)
_patterns = " UNION ALL ".join(f"SELECT repo_id, path, {quoted(n)} AS rule, min(line_no) AS line_no, '{s}' AS severity, '{c}' AS category, {k} AS confidence FROM lines WHERE {condition(n, p)} GROUP BY repo_id, path" for n, p, s, c, k in rules.LINES)
Q("rl_line_patterns", f"WITH {ALL_LINES} {_patterns}")(lambda d: rules.line_patterns(_all_lines(d), ["repo_id", "path"]))


def _rule_sql(rule: rules.Rule) -> str:
    """A pack rule over the lines; the window says whether a context pattern stands near."""
    no = "".join(f" AND NOT {met('line', '(?i)' + x)}" for x in rule.exclude)
    near = f" AND bool_or({met('line', '(?i)' + '|'.join(rule.context))}) OVER (PARTITION BY repo_id, path ORDER BY line_no RANGE BETWEEN 30 PRECEDING AND 29 FOLLOWING)" if rule.context else ""
    long = f"CASE WHEN length(regexp_extract(line, {quoted(rule.regex)})) > 30 THEN 0.05 ELSE 0 END"
    confidence = f"floor(round(least(1.0::DOUBLE, 0.95{' + 0.05' if rule.severity == 'critical' else ''} - {long}), 6) * 100 + 0.5) / 100"
    return f"SELECT repo_id, path, line_no, '{rule.id}' AS rule, '{rule.category}' AS category, '{rule.severity}' AS severity, {confidence} AS confidence, ({met('line', rule.regex)}{no}{near}) AS hit FROM lines"


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def _family_sql(f: rules.Family) -> str:
    """A family's rules as the product of its two lists; a line meets those whose words it holds."""
    escaped = lambda c: f"replace(replace({c}, '.', '\\.'), '-', '\\-')"
    pattern = quoted("(?i)(?:" + f.pattern.replace("{0}", "<a>").replace("{1}", "<b>") + ")")
    exclude = "".join(f" AND NOT {met('line', '(?i)' + x)}" for x in f.exclude)
    return f"""SELECT repo_id, path, line_no, line, '{f.name}-' || a || '-' || b AS rule, '{f.category}' AS category, '{f.severity}' AS severity, replace(replace({pattern}, '<a>', {escaped('a')}), '<b>', {escaped('b')}) AS pattern
    FROM lines JOIN (SELECT unnest({_listed(f.first)}) AS a) ON contains(lower(line), lower(a)) JOIN (SELECT unnest({_listed(f.second)}) AS b) ON contains(lower(line), lower(b)) WHERE true{exclude}"""


def _catalog(d: Domain):
    """The pack, and the families as they are loaded from a table."""
    return rules.PACK + rules.load_rules(rules.family_catalog(d.spark))


Q(
    "rl_pack_scan",
    f"""WITH {ALL_LINES}, h AS ({' UNION ALL '.join(map(_rule_sql, rules.PACK))}), c AS ({' UNION ALL '.join(map(_family_sql, rules.FAMILIES))}),
    m AS (SELECT repo_id, path, line_no, rule, category, severity, CASE WHEN length(regexp_extract(line, pattern)) > 30 THEN 0.9 ELSE 0.95 END AS confidence FROM c WHERE regexp_matches(line, pattern)),
    x AS (SELECT * EXCLUDE (hit) FROM h WHERE hit UNION ALL SELECT * FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, rule ORDER BY line_no) AS k FROM x) SELECT * EXCLUDE (k) FROM n WHERE k <= 20""",
)(lambda d: rules.pack_scan(_all_lines(d), ["repo_id", "path"], _catalog(d)).drop("cwe"))
_domain_rows = []
for _d, _checks in rules.DOMAINS.items():
    _missing = ", ".join(f"CASE WHEN NOT bool_or({met('content', p)}) THEN '{c}' END" for c, p in _checks.items())
    _share = " + ".join(f"bool_or({met('content', p)})::INT" for p in _checks.values())
    _domain_rows.append(f"SELECT repo_id, '{_d}' AS domain, concat_ws(',', {_missing}) AS missing, floor(round(({_share}) / {len(_checks)}, 9) * 10000 + 0.5) / 10000 AS score FROM d_all GROUP BY repo_id")
Q("rl_domain_packs", " UNION ALL ".join(_domain_rows))(lambda d: rules.domain_packs(d.everything))
#: Edges of a repository's graph: type, kind of node led to, pattern with the node's name as its group.
EDGES = (
    ("imports", "dependency", r'from "(pkg[0-9]+)'),
    ("imports", "module", r'from "[.]/(p[0-9]+)"'),
    ("defines", "route", r'router[.]get[(]"([^"]+)"'),
    ("calls", "endpoint", r'fetch[(]"https?://[^/"]+([^"?]+)'),
    ("reads", "env", r"process[.]env[.]([A-Z_0-9]+)"),
    ("contains", "branch", r"\b(if|for|while) [(]"),
)
_file = "'file:' || repo_id || '/' || path"
Q("gr_build", " UNION ".join(f"SELECT {_file} AS src, '{kind}:' || unnest(regexp_extract_all(content, {quoted(p)}, 1)) AS dst, '{label}' AS label FROM d_code" for label, kind, p in EDGES))(
    lambda d: code.graph_edges(d.code.withColumn("file", F.concat(F.lit("file:"), F.col("repo_id").cast("string"), F.lit("/"), "path")), EDGES)
)
