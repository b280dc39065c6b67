"""Queries over the findings warehouse: aggregates, windows, ranking and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklake.operators import aggregates as ag
from risklake.operators import joins, ranking
from risklake.operators import windows as wn
from risklake.plans.book import Book
from risklake.plans.domain import AS_OF, Domain
from risklake.plans.relational import ADV, COUNTS, DONE, ISSUE_ORDER, SEMVER, _values, advisories

BOOK = Book()
Q = BOOK.add

Q(
    "ag_public_stats",
    f"""SELECT (SELECT count(*) FROM d_scans) AS scans, (SELECT count(*) FROM d_scans WHERE {DONE} AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent_scans,
    count(*) AS issues, count(*) FILTER (has_repro) AS with_repro FROM d_issues""",
)(lambda d: ag.public_stats(d.scans, d.issues, AS_OF))
Q(
    "ag_breakdowns",
    """SELECT 'plan' AS dim, plan AS value, count(*) AS n FROM d_users GROUP BY ALL UNION ALL SELECT 'status', coalesce(status, 'unknown'), count(*) FROM d_scans GROUP BY ALL
    UNION ALL SELECT 'verdict', launch_verdict, count(*) FROM d_scans WHERE launch_verdict IS NOT NULL GROUP BY ALL UNION ALL SELECT 'framework', coalesce(framework, 'unknown'), count(*) FROM d_scans GROUP BY ALL
    UNION ALL SELECT 'tool', coalesce(vibe_tool, 'unknown'), count(*) FROM d_scans GROUP BY ALL""",
)(lambda d: ag.breakdowns(d.users, d.scans))
Q(
    "ag_monthly_scans",
    f"""WITH m AS (SELECT unnest(range(6)) AS k), c AS (SELECT date_trunc('month', TIMESTAMP '{AS_OF}') - k * INTERVAL 1 MONTH AS month FROM m)
    SELECT strftime(c.month, '%Y-%m') AS label, CAST(year(c.month) AS INT) AS year, CAST(month(c.month) AS INT) AS month, count(s.id) AS n FROM c LEFT JOIN d_scans s ON date_trunc('month', s.created_at) = c.month GROUP BY c.month""",
)(lambda d: ag.monthly_scans(d.scans, AS_OF))
Q("ag_month_to_date", "SELECT count(*) AS scans, count(DISTINCT user_id) AS users FROM d_scans WHERE created_at >= TIMESTAMP '2001-07-01' AND created_at <= TIMESTAMP '2001-07-20'")(
    lambda d: ag.month_to_date(d.scans, "2001-07-20 00:00:00")
)
Q(
    "ag_saas_metrics",
    """WITH u AS (SELECT count(*) AS users, count(*) FILTER (plan = 'creator') AS c, count(*) FILTER (plan = 'enterprise') AS e FROM d_users)
    SELECT users, c * 299 + e * 9999 AS mrr, 12 * (c * 299 + e * 9999) AS arr, CAST(floor((c * 299 + e * 9999) / users + 0.5) AS BIGINT) AS arpu, CAST(floor((c + e) * 100 / users + 0.5) AS BIGINT) AS conversion FROM u""",
)(lambda d: ag.saas_metrics(d.users))
Q(
    "ag_severity_totals",
    f"""WITH {COUNTS} SELECT CAST(sum(coalesce(critical, 0)) AS BIGINT) AS critical, CAST(sum(coalesce(high, 0)) AS BIGINT) AS high, CAST(sum(coalesce(medium, 0)) AS BIGINT) AS medium, CAST(sum(coalesce(low, 0)) AS BIGINT) AS low,
    CAST(floor(avg(score) + 0.5) AS BIGINT) AS mean_score FROM d_scans LEFT JOIN counts ON id = scan_id""",
)(lambda d: ag.severity_totals(d.scans, ag.issue_counts(d.issues)))
Q(
    "ag_failure_prevalence",
    f"""WITH s AS (SELECT id, coalesce(vibe_tool, 'unknown') AS tool FROM d_scans WHERE {DONE}), z AS (SELECT tool, count(*) AS n FROM s GROUP BY tool), h AS (SELECT DISTINCT title, id, tool FROM d_issues JOIN s ON scan_id = id),
    b AS (SELECT title, tool, count(*) AS hit FROM h GROUP BY ALL)
    SELECT title, b.tool, floor(sum(hit) OVER (PARTITION BY title) * 100 / (SELECT count(*) FROM s) * 10 + 0.5) / 10 AS percent, CAST(floor(hit * 100 / n + 0.5) AS BIGINT) AS tool_percent FROM b JOIN z ON b.tool = z.tool""",
)(lambda d: ag.failure_prevalence(d.scans, d.issues))
Q("ag_issue_counts", f"WITH {COUNTS} SELECT * FROM counts")(lambda d: ag.issue_counts(d.issues))
SCORE = "greatest(0, 100 - least(critical * 12, 55) - least(high * 5, 28) - least(medium * 2, 12) - least(low, 5))"
Q(
    "ag_scan_score",
    f"""WITH {COUNTS}, s AS (SELECT *, {SCORE} AS score FROM counts) SELECT *, CASE WHEN critical > 0 OR score < 70 THEN 'do-not-launch' WHEN high > 0 OR score < 90 THEN 'caution' ELSE 'ready' END AS verdict FROM s""",
)(lambda d: ag.scan_score(d.issues))
Q(
    "ag_agent_score",
    f"""WITH {COUNTS.replace('counts AS (SELECT scan_id,', 'counts AS (SELECT scan_id, agent_name,').replace('GROUP BY scan_id', 'GROUP BY scan_id, agent_name')}, s AS (SELECT *, {SCORE} AS score FROM counts)
    SELECT scan_id, agent_name, score, CASE WHEN score >= 70 THEN 'ready' WHEN score >= 40 THEN 'caution' ELSE 'do-not-launch' END AS verdict FROM s""",
)(lambda d: ag.agent_score(d.issues))
Q(
    "ag_launch_verdict",
    f"""WITH {COUNTS}, j AS (SELECT id, score, coalesce(critical, 0) AS c, coalesce(high, 0) AS h FROM d_scans LEFT JOIN counts ON id = scan_id)
    SELECT id, concat_ws('; ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END, CASE WHEN coalesce(score, 0) < 70 THEN 'score below 70' END) AS blockers, c = 0 AND h = 0 AND coalesce(score, 0) >= 70 AS pass FROM j""",
)(lambda d: ag.launch_verdict(d.scans, d.issues))
QUOTA = "q AS (SELECT u.id, u.plan, coalesce(n, 0) AS used, coalesce(scan_limit, CASE plan WHEN 'free' THEN 2 WHEN 'creator' THEN 12 END) AS \"limit\" FROM d_users u LEFT JOIN (SELECT user_id, count(*) AS n FROM d_scans WHERE created_at >= TIMESTAMP '2001-07-01' AND created_at <= TIMESTAMP '2001-07-20' AND status IS DISTINCT FROM 'failed' GROUP BY user_id) s ON u.id = s.user_id)"
Q("ag_quota_usage", f"""WITH {QUOTA} SELECT *, "limit" IS NULL OR used < "limit" AS allowed FROM q""")(lambda d: ag.quota_usage(d.users, d.scans, "2001-07-20 00:00:00"))
Q(
    "ag_quota_with_rescans",
    f"""WITH {QUOTA}, r AS (SELECT s.user_id, count(DISTINCT s.id) AS n FROM d_scans s JOIN d_results r ON r.scan_id = s.id AND r.engine_name = 'view' WHERE s.created_at >= TIMESTAMP '2001-07-01' AND s.created_at <= TIMESTAMP '2001-07-20' GROUP BY s.user_id)
    SELECT id, used + coalesce(n, 0) AS used FROM q LEFT JOIN r ON q.id = r.user_id""",
)(lambda d: ag.quota_with_rescans(d.users, d.scans, d.results, "2001-07-20 00:00:00", "view"))
Q(
    "ag_team_twin",
    """WITH f AS (SELECT k3 AS team, category, count(*) AS n, count(*) FILTER (has_repro) AS fixed FROM d_issues GROUP BY ALL), t AS (SELECT team, sum(n) AS n, sum(fixed) AS fixed, first(category ORDER BY n DESC, category) AS top FROM f GROUP BY team)
    SELECT team, CAST(n AS BIGINT) AS findings, top AS top_category, floor(fixed / n * 10000 + 0.5) / 10000 AS velocity, CAST(floor(65 + 20 * fixed / n + 0.5) AS BIGINT) AS percentile FROM t WHERE n >= 10""",
)(lambda d: ag.team_twin(d.issues.select(F.col("k3").alias("team"), "category", F.col("has_repro").alias("fixed"))))
Q(
    "ag_severity_category",
    """SELECT coalesce(category, 'all') AS category, coalesce(severity, 'all') AS severity, count(*) AS n, CAST(grouping_id(category, severity) AS INT) AS level FROM d_issues GROUP BY ROLLUP (category, severity)""",
)(lambda d: ag.severity_category(d.issues))
Q(
    "ag_by_cwe",
    """SELECT unnest(['CWE-' || k2 % 5, 'CWE-' || k3 % 4]) AS cwe, 1 AS one FROM d_issues""".replace("SELECT unnest", "SELECT cwe, count(*) AS n FROM (SELECT unnest") + ") GROUP BY cwe",
)(
    lambda d: ag.by_cwe(
        d.issues.select(F.array(F.concat(F.lit("CWE-"), (F.col("k2") % 5).cast("string")), F.concat(F.lit("CWE-"), (F.col("k3") % 4).cast("string"))).alias("cwe"))
    )
)
FRAMEWORKS = "CASE k2 % 4 WHEN 0 THEN 'GDPR' WHEN 1 THEN 'PCI' WHEN 2 THEN 'HIPAA' ELSE 'SOC2' END"


def _regulated(d: Domain):
    names = F.array(*map(F.lit, ("GDPR", "PCI", "HIPAA", "SOC2")))
    return d.issues.select(
        F.col("k3").alias("repo"), F.element_at(names, (F.col("k2") % 4 + 1).cast("int")).alias("framework"), F.concat(F.lit("R"), (F.col("k2") % 9).cast("string")).alias("rule"), "severity", (F.col("k2") * F.col("k1")).alias("penalty")
    )


Q(
    "ag_framework_rollup",
    f"""SELECT {FRAMEWORKS} AS framework, count(*) AS n, last(severity ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS worst, max(k2 * k1) AS max_penalty FROM d_issues GROUP BY 1""",
)(lambda d: ag.framework_rollup(_regulated(d)))
Q(
    "ag_penalty_total",
    f"""WITH r AS (SELECT {FRAMEWORKS} AS framework, k2 % 9 AS rule, max(k2 * k1) AS p FROM d_issues GROUP BY ALL) SELECT coalesce(framework, 'all') AS framework, CAST(sum(p) AS BIGINT) AS penalty FROM r GROUP BY ROLLUP (framework)""",
)(lambda d: ag.penalty_total(_regulated(d)))
WEIGHTS = "CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.5 WHEN 'medium' THEN 0.25 ELSE 0.1 END"
Q(
    "ag_compliance_scores",
    f"""WITH x AS (SELECT k3 AS repo, {FRAMEWORKS} AS f, {WEIGHTS} AS w FROM d_issues), s AS (SELECT repo, coalesce(sum(w) FILTER (f = 'GDPR'), 0) * 25 AS g, coalesce(sum(w) FILTER (f = 'PCI'), 0) * 20 AS p, coalesce(sum(w) FILTER (f = 'HIPAA'), 0) * 20 AS h FROM x GROUP BY repo),
    r AS (SELECT repo, floor(greatest(0, 100 - round(g, 6)) * 100 + 0.5) / 100 AS gdpr, floor(greatest(0, 100 - round(p, 6)) * 100 + 0.5) / 100 AS pci, floor(greatest(0, 100 - round(h, 6)) * 100 + 0.5) / 100 AS hipaa FROM s)
    SELECT *, floor(round((gdpr + pci + hipaa) / 3, 6) * 100 + 0.5) / 100 AS overall FROM r""",
)(lambda d: ag.compliance_scores(_regulated(d)))
Q(
    "ag_package_rollup",
    f"""WITH {ADV}, p AS (SELECT *, {SEMVER.format('version_spec')} AS v FROM d_deps), m AS (SELECT repo_id, name, cve, cvss, fixed FROM p JOIN adv ON lower(name) = lower(package) WHERE CASE cve
      WHEN 'ADV-1' THEN v < [1, 2, 3] WHEN 'ADV-2' THEN v <= [3, 5, 2] WHEN 'ADV-3' THEN v >= [1, 0, 0] AND v < [2, 0, 0] WHEN 'ADV-4' THEN v < [4, 0, 0] ELSE v < [0, 5, 0] END)
    SELECT repo_id, name, string_agg(DISTINCT cve, ',' ORDER BY cve) AS cves, max(cvss) AS max_cvss, CASE WHEN max(cvss) >= 9 THEN 'critical' WHEN max(cvss) >= 7 THEN 'high' WHEN max(cvss) >= 4 THEN 'medium' ELSE 'low' END AS worst,
      last(fixed ORDER BY {SEMVER.format('fixed')}) AS fix_version FROM m GROUP BY ALL""".replace("SELECT repo_id, name, string_agg", ", w AS (SELECT repo_id, name, string_agg")
    + """), n AS (SELECT repo_id, count(DISTINCT name) AS packages FROM d_deps GROUP BY repo_id), t AS (SELECT repo_id, first(cve ORDER BY cvss DESC, cve) AS top_cve FROM m GROUP BY repo_id),
    r AS (SELECT repo_id, count(*) AS vulnerable, count(*) FILTER (worst = 'critical') AS critical, count(*) FILTER (worst = 'high') AS high, count(*) FILTER (worst = 'medium') AS medium FROM w GROUP BY repo_id) SELECT * FROM w JOIN n USING (repo_id) JOIN t USING (repo_id) JOIN r USING (repo_id)""",
)(lambda d: d.per_repo(ag.package_rollup(joins.cve_match(d.stock, advisories(d)), d.stock)))
PACKAGES = """packages AS (SELECT repo_id, name, seq, CAST(seq * 7 % 1000 AS INT) AS age_days, seq % 17 = 0 AS deprecated, CAST(seq % 6 AS INT) AS maintainers, seq % 9 = 0 AS vulnerable, CASE WHEN seq % 8 > 0 THEN 'MIT' END AS license FROM d_deps)"""


def _packages(deps: DataFrame):
    return deps.select(
        "repo_id",
        "name",
        "seq",
        (F.col("seq") * 7 % 1000).cast("int").alias("age_days"),
        (F.col("seq") % 17 == 0).alias("deprecated"),
        (F.col("seq") % 6).cast("int").alias("maintainers"),
        (F.col("seq") % 9 == 0).alias("vulnerable"),
        F.when(F.col("seq") % 8 > 0, "MIT").alias("license"),
    )


Q(
    "ag_dep_health",
    f"""WITH {PACKAGES}, x AS (SELECT *, CASE WHEN deprecated THEN 1.0::DOUBLE WHEN age_days > 730 THEN 0.9 WHEN age_days > 365 THEN 0.7 WHEN age_days > 180 THEN 0.4 WHEN age_days > 90 THEN 0.2 ELSE 0 END AS decay, CASE WHEN vulnerable THEN 1 + seq % 4 ELSE 0 END AS v FROM packages),
    y AS (SELECT *, CASE WHEN v >= 3 AND decay > 0.7 AND seq % 2 = 0 THEN 'critical' WHEN v >= 2 AND decay > 0.5 THEN 'high' WHEN v >= 1 OR decay > 0.6 THEN 'medium' WHEN decay > 0.3 THEN 'low' END AS severity FROM x),
    n AS (SELECT repo_id, count(*) AS packages, floor(round(avg(decay), 9) * 10000 + 0.5) / 10000 AS mean_decay, CAST(floor(round(avg(age_days), 9) + 0.5) AS BIGINT) AS mean_age, floor(round(avg(maintainers), 9) * 10 + 0.5) / 10 AS mean_maintainers, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
      count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (deprecated) AS dead, count(*) FILTER (age_days > 365) AS stale, count(*) FILTER (v > 0) AS hit, count(*) FILTER (maintainers <= 1) AS few FROM y GROUP BY repo_id),
    m AS (SELECT *, CAST(greatest(0, 100 - floor(round(50 * stale / packages, 9) + 0.5) - 15 * dead) AS BIGINT) AS freshness, CAST(floor(round(30 * few / packages, 9) + 0.5) AS BIGINT) AS maintainer_risk FROM n)
    SELECT repo_id, packages, mean_decay, mean_age, mean_maintainers, critical, high, medium, low, freshness, maintainer_risk, CASE WHEN critical >= 2 OR high >= 4 THEN 'high' WHEN critical >= 1 OR high >= 2 THEN 'medium' ELSE 'low' END AS supply_chain_risk,
      CAST(greatest(0, least(100, floor(round(greatest(0, 100 - (15 * critical + 8 * high + 3 * stale + 5 * dead + 4 * hit)) - 0.3::DOUBLE * maintainer_risk, 9) + 0.5))) AS BIGINT) AS score FROM m""",
)(lambda d: ag.dep_health(_packages(d.deps).withColumn("vulnerabilities", F.when(F.col("vulnerable"), 1 + F.col("seq") % 4).otherwise(0)).withColumn("reachable", F.col("seq") % 2 == 0)))
Q(
    "ag_dep_decay_score",
    f"""WITH {PACKAGES} SELECT repo_id, CAST(floor(round(least(greatest(100 - 40 * avg(deprecated::INT) - 25 * avg((age_days > 365)::INT) - 20 * avg(vulnerable::INT) + least(2 * avg(maintainers), 15), 0), 100), 6) + 0.5) AS BIGINT) AS score FROM packages GROUP BY repo_id""",
)(lambda d: ag.dep_decay_score(_packages(d.deps)))
Q(
    "ag_maintenance",
    f"""WITH {PACKAGES} SELECT repo_id, name, seq, floor(round(least(greatest(1.0::DOUBLE - CASE WHEN age_days > 730 THEN 0.4 WHEN age_days > 365 THEN 0.2 ELSE 0 END + CASE WHEN maintainers = 0 THEN -0.3 WHEN maintainers = 1 THEN -0.1 WHEN maintainers >= 5 THEN 0.1 ELSE 0 END
      - CASE WHEN license IS NULL THEN 0.1 ELSE 0 END, 0), 1), 6) * 100 + 0.5) / 100 AS maintenance FROM packages""",
)(lambda d: d.per_repo(ag.maintenance(_packages(d.stock))))
STAGES = (("landing", 0.1), ("signup", 0.25), ("checkout", 0.5), ("retention", 0.15), ("referral", 0.05))
ROUTES = "ir AS (SELECT '/r' || k2 % 30 AS route, CASE k2 % 30 % 5 WHEN 0 THEN 'landing' WHEN 1 THEN 'signup' WHEN 2 THEN 'checkout' ELSE 'retention' END AS stage, severity FROM d_issues)"


def _stages(d: Domain):
    return d.spark.createDataFrame(list(STAGES), "stage string, weight double")


def _issue_routes(d: Domain):
    place = F.col("k2") % 30
    stage = F.when(place % 5 == 0, "landing").when(place % 5 == 1, "signup").when(place % 5 == 2, "checkout").otherwise("retention")
    return d.issues.select(F.concat(F.lit("/r"), place.cast("string")).alias("route"), stage.alias("stage"), "severity")


STAGE_SQL = f"stages AS (SELECT stage, weight::DOUBLE AS weight FROM (VALUES {_values(STAGES)}) v(stage, weight))"
_LOST = "weight * CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.5 WHEN 'medium' THEN 0.15 ELSE 0.03 END"
IMPACTS = f"im AS (SELECT *, dropped > 0 AND impact > 100 AS finding FROM (SELECT route, ir.stage, severity, CAST(floor(round({_LOST} * 100, 6) + 0.5) AS BIGINT) AS dropped, CAST(floor(round(10000 * {_LOST} * 50, 6) + 0.5) AS BIGINT) AS impact FROM ir JOIN stages ON ir.stage = stages.stage))"
Q(
    "ag_funnel",
    f"""WITH {ROUTES}, {STAGE_SQL}, {IMPACTS}, m AS (SELECT stage, count(DISTINCT route) AS routes, count(*) AS issues, sum(dropped) FILTER (finding) AS d, sum(impact) FILTER (finding) AS i FROM im GROUP BY stage), j AS (SELECT s.stage, weight, coalesce(routes, 0) AS routes, coalesce(issues, 0) AS issues, coalesce(d, 0) AS d, coalesce(i, 0) AS i FROM stages s LEFT JOIN m ON s.stage = m.stage),
    f AS (SELECT CAST(greatest(0, floor(round(100 - sum(least(15 * issues * weight, 40)), 6) + 0.5)) AS BIGINT) AS funnel_health, CAST(100 - least(20 * coalesce(sum(issues) FILTER (stage = 'checkout'), 0), 60) AS BIGINT) AS checkout_score, CAST(100 - least(10 * coalesce(sum(issues) FILTER (stage = 'retention'), 0), 40) AS BIGINT) AS retention_score FROM j)
    SELECT stage, routes, issues, CAST(least(100, d) AS BIGINT) AS drop_percent, CAST(i AS BIGINT) AS revenue_at_risk, f.*, CAST(floor(round(0.5::DOUBLE * checkout_score + 0.3::DOUBLE * funnel_health + 0.2::DOUBLE * retention_score, 6) + 0.5) AS BIGINT) AS business_score FROM j, f""",
)(lambda d: ag.funnel(_issue_routes(d), _stages(d)))
Q("ag_revenue_at_risk", f"WITH {ROUTES}, {STAGE_SQL}, {IMPACTS} SELECT route, stage, severity, impact FROM im WHERE finding")(lambda d: ag.revenue_at_risk(_issue_routes(d), _stages(d)))


def _ops(d: Domain):
    k = F.col("k2") + F.col("k3")
    return d.issues.select(F.col("agent_name").alias("service"), (k % 2 == 0).alias("logged"), (k % 3 == 0).alias("measured"), (k % 5 == 0).alias("traced"), (k % 7 > 1).alias("protected"), (k % 11 == 0).alias("swallowed"))


OPS = "ops AS (SELECT agent_name AS service, (k2 + k3) % 2 = 0 AS logged, (k2 + k3) % 3 = 0 AS measured, (k2 + k3) % 5 = 0 AS traced, (k2 + k3) % 7 > 1 AS protected, (k2 + k3) % 11 = 0 AS swallowed FROM d_issues)"
Q(
    "ag_obs_coverage",
    f"""WITH {OPS} SELECT service, count(*) AS ops, CAST(floor(round(60 * avg(logged::INT) + 25 * avg(measured::INT) + 15 * avg(traced::INT), 6) + 0.5) AS BIGINT) AS score FROM ops GROUP BY service""",
)(lambda d: ag.obs_coverage(_ops(d)))
Q(
    "ag_reliability",
    f"""WITH {OPS} SELECT service, floor(round(0.6::DOUBLE * (100 - 60 * avg((NOT protected)::INT)) + 0.4::DOUBLE * (100 - 25 * avg(swallowed::INT)), 6) * 10 + 0.5) / 10 AS score FROM ops GROUP BY service""",
)(lambda d: ag.reliability(_ops(d)))
Q(
    "ag_debt_score",
    """WITH f AS (SELECT scan_id AS repo, count(*) FILTER (severity IN ('critical', 'high')) AS e, count(*) FILTER (severity = 'medium') AS w, count(*) FILTER (severity = 'low') AS i, count(*) AS findings FROM d_issues GROUP BY scan_id)
    , c AS (SELECT repo, string_agg(category || ':' || n, ',' ORDER BY category) AS categories FROM (SELECT scan_id AS repo, category, count(*) AS n FROM d_issues GROUP BY ALL) GROUP BY repo),
    p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, file_path) AS k FROM (SELECT scan_id AS repo, file_path, count(*) AS n FROM d_issues GROUP BY ALL)), t AS (SELECT repo, string_agg(file_path || ':' || n, ',' ORDER BY k) AS top_files FROM p WHERE k <= 5 GROUP BY repo)
    SELECT repo, findings, greatest(0, 100 - least(e * 15, 40) - least(w * 6, 35) - least(i * 2, 15)) AS score, e * 20 + w * 10 + i * 5 AS minutes, categories, top_files FROM f JOIN c USING (repo) JOIN t USING (repo)""",
)(lambda d: ag.debt(d.issues.select(F.col("scan_id").alias("repo"), F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warn").otherwise("info").alias("level"), "category", F.col("file_path").alias("path"))))
Q(
    "ag_type_confidence",
    """SELECT id AS repo, floor(round(least(greatest((0.5 + 0.5 * (id % 90) / 100) * (1 / (1 + 0.05::DOUBLE * (id % 7))) * (1 / (1 + 0.02::DOUBLE * (id % 31))) * (1 / (1 + 0.01::DOUBLE * (id % 53))), 0.10), 0.99), 9) * 10000 + 0.5) / 10000 AS confidence FROM d_scans""",
)(
    lambda d: ag.type_confidence(
        d.scans.select(F.col("id").alias("repo"), (F.col("id") % 90).alias("typed"), F.lit(100).alias("total"), (F.col("id") % 7).alias("depth"), (F.col("id") % 31).alias("externals"), (F.col("id") % 53).alias("complexity"))
    )
)
Q("ag_clone_hash_groups", "SELECT md5(content) AS structural_hash, count(*) AS n, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id) AS members FROM d_files GROUP BY 1 HAVING count(*) > 1")(
    lambda d: ag.clone_hash_groups(d.files.select(F.col("file_id").alias("id"), F.md5("content").alias("structural_hash")))
)
Q("ag_json_entropy_leaks", "SELECT id, scan_id, CAST(json_extract_string(result, '$.avgEntropy') AS DOUBLE) AS avg_entropy, json_array_length(result, '$.entropyLeaks') AS leaks FROM d_reports WHERE engine_name = 'entropy' AND json_array_length(result, '$.entropyLeaks') > 0 ORDER BY avg_entropy DESC, id LIMIT 20")(
    lambda d: ag.json_entropy(d.reports)
)
REALITY = {"score": "score", "mock_data": "mockDataCount", "fake_endpoints": "fakeEndpointCount", "dummy_auth": "dummyAuthCount"}
Q("ag_json_reality", f"SELECT id, scan_id, {', '.join(f"CAST(json_extract_string(result, '$.{path}') AS DOUBLE) AS {name}" for name, path in REALITY.items())} FROM d_reports WHERE engine_name = 'reality' ORDER BY score, id LIMIT 20")(
    lambda d: ag.json_reality(d.reports)
)
LEAKS = "leaks AS (SELECT id, scan_id, unnest(json_extract(result, '$.entropyLeaks[*]')) AS x FROM d_reports WHERE engine_name = 'entropy')"
BYPASSES = "bypasses AS (SELECT id, scan_id, unnest(json_extract(result, '$.constraintBypasses[*]')) AS x FROM d_reports WHERE engine_name = 'bypass')"
Q("ag_json_leak_rows", f"WITH {LEAKS} SELECT id, scan_id, x->>'file' AS file, CAST(x->>'entropy' AS DOUBLE) AS entropy, x->>'patternType' AS type FROM leaks ORDER BY entropy DESC, id, file LIMIT 50")(lambda d: ag.json_leaks(d.reports))
Q("ag_json_bypass_rows", f"""WITH {BYPASSES} SELECT id, scan_id, x->>'file' AS file, x->>'constraint' AS "constraint", x->>'conditionType' AS condition, x->>'bypassType' AS bypass FROM bypasses ORDER BY id DESC, file LIMIT 50""")(
    lambda d: ag.json_newest_bypasses(d.reports)
)
Q("ag_json_bypass_summary", f"WITH {BYPASSES} SELECT x->>'conditionType' AS condition, x->>'bypassType' AS bypass, count(*) AS n, count(DISTINCT scan_id) AS scans FROM bypasses GROUP BY 1, 2")(lambda d: ag.json_bypass_summary(d.reports))
Q(
    "ag_json_leaks_and_bypasses",
    """SELECT scan_id, CAST(sum(json_array_length(result, '$.entropyLeaks')) FILTER (engine_name = 'entropy') AS BIGINT) AS leaks, CAST(sum(CAST(json_extract_string(result, '$.totalBypasses') AS BIGINT)) FILTER (engine_name = 'bypass') AS BIGINT) AS bypasses
    FROM d_reports GROUP BY scan_id HAVING leaks > 0 AND bypasses > 0 ORDER BY bypasses DESC, scan_id LIMIT 20""",
)(lambda d: ag.json_leaks_and_bypasses(d.reports))

# Windows
Q(
    "wn_latest_per_app",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM d_scans WHERE {DONE}), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, source_input ORDER BY n) AS k FROM o WHERE n <= 200)
    SELECT user_id, source_input, id, score, CASE WHEN coalesce(score, 0) < 55 THEN 'critical' WHEN coalesce(score, 0) < 70 THEN 'high' WHEN coalesce(score, 0) < 85 THEN 'medium' ELSE 'low' END AS risk FROM l WHERE k = 1""",
)(lambda d: wn.portfolio(d.scans))
Q(
    "wn_app_overview",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM d_scans), x AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS b, count(*) OVER (PARTITION BY user_id, source_input) AS c FROM o WHERE n <= 50 WINDOW w AS (PARTITION BY user_id, source_input ORDER BY n))
    SELECT user_id, source_input, max(CASE WHEN k = 1 THEN score END) AS score, max(CASE WHEN k = 1 THEN score - b END) AS trend, max(c) AS scan_count, string_agg(CASE WHEN k <= 10 THEN coalesce(score, -1) END, ',' ORDER BY k DESC) AS history FROM x GROUP BY ALL""",
)(lambda d: wn.app_overview(d.scans))
Q(
    "wn_pulse",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM d_scans WHERE {DONE}), p AS (SELECT user_id, max(id) FILTER (n = 1) AS i, max(score) FILTER (n = 1) AS a, max(score) FILTER (n = 2) AS b FROM o WHERE n <= 2 GROUP BY user_id),
    c AS (SELECT scan_id, CAST(sum(m) AS BIGINT) AS n, coalesce(string_agg(title, ',' ORDER BY title) FILTER (k <= 3), '') AS packages FROM (SELECT scan_id, title, count(*) AS m, row_number() OVER (PARTITION BY scan_id ORDER BY title) AS k FROM d_issues WHERE severity = 'critical' GROUP BY scan_id, title) GROUP BY scan_id), x AS (SELECT user_id, i, greatest(0, coalesce(b - a, 0)) AS d, coalesce(n, 0) AS n, packages FROM p LEFT JOIN c ON i = scan_id)
    SELECT user_id, i AS scan_id, d AS "drop", d >= 5 OR n > 0 AS alert, concat_ws('; ', CASE WHEN d >= 5 THEN 'score dropped by ' || d END, CASE WHEN n > 0 THEN n || ' critical packages' END) AS reason, packages FROM x""",
)(lambda d: wn.pulse(d.scans, wn.critical_packages(d.issues.filter("severity = 'critical'").select("scan_id", F.col("title").alias("name")))))
Q(
    "wn_score_percentile",
    """WITH s AS (SELECT id, score FROM d_scans WHERE status = 'completed' AND score IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY score) - 1 AS b, count(*) OVER () - 1 AS o FROM s)
    SELECT id, score, CAST(CASE WHEN o > 0 THEN floor(b * 100 / o + 0.5) ELSE 50 END AS BIGINT) AS percentile FROM r""",
)(lambda d: wn.score_percentile(d.scans))
AREAS = {"security": ["Security", "IDOR", "Auth"], "performance": ["Performance"], "ux": ["UX", "Experience"], "reliability": ["Reliab", "Error"]}
Q(
    "wn_issue_percentiles",
    "WITH c AS (SELECT scan_id, "
    + ", ".join(f"count(*) FILTER (regexp_matches(agent_name, '{'|'.join(p)}')) AS {a}" for a, p in AREAS.items())
    + " FROM d_issues GROUP BY scan_id), s AS (SELECT id, "
    + ", ".join(f"coalesce({a}, 0) AS {a}" for a in AREAS)
    + " FROM d_scans LEFT JOIN c ON id = scan_id WHERE status = 'completed' AND score IS NOT NULL) SELECT id, "
    + ", ".join(f"CAST(100 - floor((rank() OVER (ORDER BY {a}) - 1) * 100 / (count(*) OVER () - 1) + 0.5) AS BIGINT) AS {a}_percentile" for a in AREAS)
    + " FROM s",
)(lambda d: wn.issue_percentiles(d.scans, d.issues, AREAS))
for _peer in ("vibe_tool", "business_type"):
    Q(
        "wn_peer_rank" if _peer == "vibe_tool" else "wn_peer_rank_industry",
        f"""WITH s AS (SELECT id, {_peer}, rank() OVER (PARTITION BY {_peer} ORDER BY score) - 1 AS b, count(*) OVER (PARTITION BY {_peer}) - 1 AS o FROM d_scans WHERE status = 'completed' AND score IS NOT NULL AND {_peer} IS NOT NULL)
        SELECT id, {_peer}, CAST(greatest(1, 100 - floor(b * 100 / o + 0.5)) AS INT) AS top_percent FROM s WHERE o >= 3""",
    )(lambda d, peer=_peer: wn.peer_rank(d.scans, peer))
Q(
    "wn_score_history",
    "SELECT id, user_id, source_input, score, CAST(row_number() OVER w AS INT) AS n, lag(score) OVER w AS previous FROM d_scans WHERE score IS NOT NULL WINDOW w AS (PARTITION BY user_id, source_input ORDER BY id)",
)(lambda d: wn.score_history(d.scans))


def _snapshots(d: Domain):
    return d.scans.select(F.col("user_id").alias("repo"), "id", F.col("created_at").alias("at"), (F.col("id") % 60 + 1).alias("complexity"), F.col("vibe_tool").alias("tool"))


SNAP = "snap AS (SELECT user_id AS repo, id, created_at AS t, id % 60 + 1 AS complexity, vibe_tool AS tool FROM d_scans)"
Q(
    "wn_drift",
    f"""WITH {SNAP}, x AS (SELECT *, lag(complexity) OVER w AS b, (epoch(t) - epoch(lag(t) OVER w)) / 86400 AS days, first_value(tool) OVER (PARTITION BY repo ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM snap WINDOW w AS (PARTITION BY repo ORDER BY t, id)),
    y AS (SELECT *, CASE WHEN b IS NULL THEN 0.35::DOUBLE ELSE least(1.0, abs(complexity - b) / greatest(1, b) * CASE WHEN days < 2 THEN 3 ELSE 1 END) END AS r FROM x)
    SELECT repo, id, floor(round(r, 9) * 100 + 0.5) / 100 AS drift, tool IS DISTINCT FROM f AS shifted, CAST(floor(365 / exp(r * 3)) AS BIGINT) AS days_left, floor(365 / exp(r * 3)) < 14 AS rewrite FROM y""",
)(lambda d: wn.drift(_snapshots(d)))
Q(
    "wn_complexity_trend",
    f"""WITH {SNAP}, e AS (SELECT repo, first(complexity ORDER BY t, id) AS a, last(complexity ORDER BY t, id) AS b, (epoch(max(t)) - epoch(min(t))) / 86400 AS days FROM snap GROUP BY repo), g AS (SELECT *, CASE WHEN days > 0 THEN (b - a) / days ELSE 0 END AS raw FROM e)
    SELECT repo, floor(round(raw, 9) * 10000 + 0.5) / 10000 AS growth, round(raw, 9) > 1 AS regressed, CAST(CASE WHEN round(raw, 9) > 0 AND b < 100 THEN ceil(round((100 - b) / raw, 6)) END AS BIGINT) AS days_to_goal FROM g""",
)(lambda d: wn.complexity_trend(_snapshots(d)))
Q(
    "wn_last_n_traffic",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY route) AS c FROM d_traffic)
    SELECT route, floor(round(avg((status_code >= 500)::INT), 9) * 10000 + 0.5) / 10000 AS error_rate, floor(round(avg(response_time_ms), 6) * 100 + 0.5) / 100 AS mean_ms, avg((status_code >= 500)::INT) > 0.05 OR avg(response_time_ms) > 1500 AS bottleneck FROM x WHERE c >= 50 AND n <= 100 GROUP BY route""",
)(lambda d: wn.traffic_health(d.traffic))
Q(
    "wn_last_n_latency",
    "SELECT event_id, route, floor(round(avg(response_time_ms) OVER (PARTITION BY route ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 6) * 1000 + 0.5) / 1000 AS mean_ms FROM d_traffic",
)(lambda d: wn.latency_ring(d.traffic))
Q(
    "wn_temporal_rules",
    """WITH s AS (SELECT scan_id AS repo, event_id AS pos, route AS kind FROM d_traffic), r AS (SELECT * FROM (VALUES ('error-then-view', 'error', 'view'), ('signup-then-purchase', 'signup', 'purchase')) v(rule, a, b))
    SELECT repo, rule, pos FROM s JOIN r ON kind = a WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.repo = s.repo AND t.pos > s.pos AND t.kind = b)""",
)(
    lambda d: wn.temporal_rules(
        d.traffic.select(F.col("scan_id").alias("repo"), F.col("event_id").alias("pos"), F.col("route").alias("kind")),
        d.spark.createDataFrame([("error-then-view", "error", "view"), ("signup-then-purchase", "signup", "purchase")], "rule string, first string, then string"),
    )
)
Q(
    "wn_ngram_type_seq",
    """WITH q AS (SELECT scan_id AS file_id, string_agg(route, '::' ORDER BY event_id, route) AS s FROM d_traffic GROUP BY scan_id) SELECT file_id, sha256(s)[:16] AS hash16, contains(s, 'view::click::error') AS found, 69 AS confidence FROM q""",
)(lambda d: wn.type_sequence(d.traffic.select(F.col("scan_id").alias("file_id"), F.col("event_id").alias("pos"), F.col("route").alias("kind")), ["view", "click", "error"]))

# Ranking and sets
Q("tk_next_run", "SELECT id, 'claimed' AS status, priority FROM d_runs WHERE status = 'queued' ORDER BY priority DESC, created_at, id LIMIT 1")(lambda d: ranking.next_run(d.runs).select("id", "status", "priority"))
Q("tk_recent_runs", "SELECT id, status, created_at FROM d_runs WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 25")(lambda d: ranking.recent_runs(d.runs, "failed").select("id", "status", "created_at"))
Q("tk_artifacts", "SELECT id, priority, row_number() OVER (ORDER BY priority, created_at, id) AS place FROM d_runs ORDER BY priority, created_at, id LIMIT 100")(
    lambda d: d.runs.orderBy("priority", "created_at", "id").limit(100).select("id", "priority").withColumn("place", F.row_number().over(ranking.Window.partitionBy(F.lit(1)).orderBy("priority", "id")).cast("long"))
)
Q("tk_top_files", "SELECT file_path, count(*) AS n FROM d_issues GROUP BY 1 ORDER BY n DESC, file_path LIMIT 5")(lambda d: ranking.top_by_count(d.issues, "file_path"))
Q("tk_top_cost_nodes", "SELECT id FROM (SELECT event_id AS id, response_time_ms AS c, event_id % 100 AS io FROM d_traffic) ORDER BY c + io DESC, id LIMIT 20")(
    lambda d: ranking.top_cost(d.traffic.select(F.col("event_id").alias("id"), F.col("response_time_ms").alias("cpu"), (F.col("event_id") % 100).alias("io"))).select("id")
)
Q(
    "tk_top_coupled",
    """WITH g AS (SELECT scan_id % 100 AS repo, k3 AS id, count(*) AS degree FROM d_issues GROUP BY ALL HAVING count(*) > 5), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY degree DESC, id) AS n FROM g) SELECT repo, id, degree, round(least(0.99, degree * 0.05 * 0.4::DOUBLE), 4) AS probability FROM r WHERE n <= 3""",
)(lambda d: ranking.top_coupled(d.issues.groupBy((F.col("scan_id") % 100).alias("repo"), F.col("k3").alias("id")).agg(F.count("*").alias("degree")), 0.4))
AGENT_WORDS = (("security", "src3"), ("security", "src"), ("ux", "web"), ("ux", "html"), ("data", "src7"), ("data", "ts"))
Q(
    "tk_relevant_files",
    f"""WITH w AS (SELECT DISTINCT path, unnest(string_split_regex(lower(path), '[^a-z0-9]+')) AS word FROM d_files), k AS (SELECT * FROM (VALUES {_values(AGENT_WORDS)}) v(agent, word)), h AS (SELECT agent, path, count(*) AS hits FROM (SELECT DISTINCT agent, path, w.word FROM w JOIN k ON w.word = k.word) GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY agent ORDER BY hits DESC, path) AS INT) AS rank FROM h) SELECT agent, path, hits, rank FROM r WHERE rank <= 4""",
)(lambda d: ranking.relevant_files(d.files, d.spark.createDataFrame(list(AGENT_WORDS), "agent string, word string")))
Q("tk_findings_cap", "SELECT scan_id, k1, k2, k3 FROM (SELECT *, row_number() OVER (PARTITION BY title, file_path ORDER BY scan_id, k1, k2, k3) AS n FROM d_issues) WHERE n <= 20")(
    lambda d: ranking.cap_per(d.issues, ["title", "file_path"], ["scan_id", *ISSUE_ORDER]).select("scan_id", *ISSUE_ORDER)
)
Q("st_union_issues", "SELECT source_evidence, count(*) AS n, count(k9) AS extra FROM (SELECT source_evidence, NULL AS k9 FROM d_issues WHERE source_evidence = 'static' UNION ALL SELECT source_evidence, k1 FROM d_issues WHERE source_evidence <> 'static') GROUP BY 1")(
    lambda d: ranking.union_issues(d.issues.filter("source_evidence = 'static'"), d.issues.filter("source_evidence <> 'static'").withColumn("k9", F.col("k1"))).groupBy("source_evidence").agg(F.count("*").alias("n"), F.count("k9").alias("extra"))
)
Q(
    "st_dedup_best",
    """SELECT scan_id, k1, k2, k3 FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, severity, trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'))[:40] ORDER BY coalesce(confidence, 75) DESC, k1, k2, k3) AS n FROM d_issues) WHERE n = 1""",
)(lambda d: ranking.dedup_best(d.issues, ["scan_id"], ISSUE_ORDER).select("scan_id", *ISSUE_ORDER))
Q("st_dedup_first", "SELECT scan_id, k1, k2, k3 FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_number, category ORDER BY scan_id, k1, k2, k3) AS n FROM d_issues) WHERE n = 1")(
    lambda d: ranking.dedup_first(d.issues, ["file_path", "line_number", "category"], ["scan_id", *ISSUE_ORDER]).select("scan_id", *ISSUE_ORDER)
)
Q(
    "st_dedup_critical_wins",
    """SELECT scan_id, k1, k2, k3 FROM (SELECT *, row_number() OVER (PARTITION BY title, file_path, line_number ORDER BY CASE WHEN severity = 'critical' THEN 0 ELSE 1 END, CASE WHEN severity = 'critical' THEN -scan_id ELSE scan_id END, CASE WHEN severity = 'critical' THEN -k1 ELSE k1 END,
      CASE WHEN severity = 'critical' THEN -k2 ELSE k2 END, CASE WHEN severity = 'critical' THEN -k3 ELSE k3 END) AS n FROM d_issues) WHERE n = 1""",
)(lambda d: ranking.dedup_critical(d.issues, ["title", "file_path", "line_number"], ["scan_id", *ISSUE_ORDER]).select("scan_id", *ISSUE_ORDER))
Q("st_distinct_integrity", "SELECT scan_id, k1, k2, k3 FROM (SELECT *, row_number() OVER (PARTITION BY category, title[:60] ORDER BY scan_id, k1, k2, k3) AS n FROM d_issues) WHERE n = 1")(
    lambda d: ranking.dedup_first(d.issues.withColumn("_cut", F.substring("title", 1, 60)), ["category", "_cut"], ["scan_id", *ISSUE_ORDER]).select("scan_id", *ISSUE_ORDER)
)
Q("st_intersect_titles", "SELECT title, severity FROM d_issues WHERE k1 < 4 INTERSECT SELECT title, severity FROM d_issues WHERE k1 >= 4")(lambda d: ranking.persistent(d.issues.filter("k1 >= 4"), d.issues.filter("k1 < 4"), ["title", "severity"]))
Q("st_except_titles", "SELECT DISTINCT scan_id, title FROM d_issues WHERE k1 >= 4 AND (scan_id, title) NOT IN (SELECT scan_id, title FROM d_issues WHERE k1 < 4)")(
    lambda d: ranking.new_keys(d.issues.filter("k1 < 4"), d.issues.filter("k1 >= 4"), ["scan_id", "title"])
)
