"""Queries over scans, issues, users and teams: filters, projections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.functions.scalars import effective_status, evidence_level, redact
from risklake.operators import aggregates, joins, predicates
from risklake.plans.book import Book
from risklake.plans.domain import AS_OF_EVENTS, Domain

BOOK = Book()
ISSUE_ORDER = ["k1", "k2", "k3"]

#: Advisories to match against the star schema's brands; plain rows.
ADVISORIES = (
    ("Brand#1", "ADV-1", "< 1.2.3", "1.2.3", 9.8),
    ("brand#2", "ADV-2", "<= 3.5.2", "3.5.3", 7.5),
    ("Brand#3", "ADV-3", ">= 1.0.0 < 2.0.0", "2.0.0", 5.3),
    ("Brand#3", "ADV-4", "< 4.0.0", "4.0.0", 8.1),
    ("Brand#7", "ADV-5", "< 0.5.0", "0.5.0", 4.0),
)
LICENSES = {"Brand#1": "GPL-3.0", "Brand#2": "MIT", "Brand#3": "AGPL-3.0", "Brand#4": "LGPL-3.0", "Brand#5": "BUSL-1.1", "Brand#6": "Apache-2.0"}
RESTRICTIVE = {"AGPL-3.0": "critical", "BUSL-1.1": "high"}
COPYLEFT = {"GPL-3.0", "LGPL-3.0"}


def advisories(d: Domain):
    return d.spark.createDataFrame([(p, c, a, f, s) for p, c, a, f, s in ADVISORIES], "package string, cve string, affected string, fixed string, cvss double")


def licenses(d: Domain):
    return d.spark.createDataFrame(sorted(LICENSES.items()), "package string, license string")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


SEMVER = "list_transform(string_split(regexp_replace({0}, '^[\\^~>=<\\s]+', ''), '.'), lambda p: CAST(p AS INT))"
ADV = f"""adv AS (SELECT * FROM (VALUES {_values(ADVISORIES)}) v(package, cve, affected, fixed, cvss))"""

BOOK.add("prj_effective_status", "SELECT id, coalesce(status, CASE WHEN score IS NOT NULL THEN 'completed' ELSE 'pending' END) AS effective_status FROM d_scans")(
    lambda d: d.scans.select("id", effective_status(F.col("status"), F.col("score")).alias("effective_status"))
)
DONE = "(status = 'completed' OR (status IS NULL AND score IS NOT NULL))"
BOOK.add("flt_completed", f"SELECT id, score FROM d_scans WHERE {DONE}")(lambda d: predicates.completed(d.scans).select("id", "score"))
BOOK.add(
    "flt_gallery_page",
    f"""SELECT id, score, framework, vibe_tool, created_at, count(*) OVER () AS total FROM d_scans
    WHERE {DONE} AND framework = '1-URGENT' AND vibe_tool = 'cursor' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10""",
)(lambda d: predicates.gallery(d.scans, "1-URGENT", "cursor", 20, 10))

COUNTS = """counts AS (SELECT scan_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM d_issues GROUP BY scan_id)"""
BOOK.add(
    "flt_certificate",
    f"""WITH {COUNTS}, hits AS (SELECT *, CASE WHEN cert_id = '120' THEN 0 WHEN CAST(id AS VARCHAR) = '120' THEN 1 END AS way FROM d_scans WHERE {DONE})
    SELECT h.id, cert_id, score, coalesce(critical, 0) AS critical_issues, coalesce(critical + high + medium + low, 0) AS total_issues
    FROM hits h LEFT JOIN counts c ON h.id = c.scan_id WHERE way IS NOT NULL ORDER BY way, created_at DESC, h.id LIMIT 1""",
)(lambda d: predicates.certificate(d.scans, aggregates.issue_counts(d.issues), "120"))
BOOK.add(
    "flt_badge",
    f"""WITH {COUNTS} SELECT id, coalesce(score, 0) >= 70 AND coalesce(critical, 0) = 0 AS valid,
    CASE WHEN coalesce(score, 0) >= 70 AND coalesce(critical, 0) = 0 THEN 'certified' ELSE 'not certified' END AS label,
    CASE WHEN coalesce(score, 0) >= 70 THEN 'green' WHEN coalesce(score, 0) >= 40 THEN 'yellow' ELSE 'red' END AS colour
    FROM d_scans LEFT JOIN counts ON id = scan_id WHERE {DONE}""",
)(lambda d: predicates.badge(d.scans, aggregates.issue_counts(d.issues)))
BOOK.add(
    "flt_pr_status",
    """SELECT id, score, launch_verdict, coalesce(launch_verdict = 'do-not-launch', false) AS blocked,
    CASE launch_verdict WHEN 'do-not-launch' THEN 'blocked' WHEN 'caution' THEN 'review' WHEN 'ready' THEN 'ready' ELSE 'pending' END AS message
    FROM d_scans WHERE description LIKE '%PR #13 %' ORDER BY created_at DESC, id DESC LIMIT 1""",
)(lambda d: predicates.pr_status(d.scans, 13))
BOOK.add(
    "flt_ci_gate",
    """SELECT user_id, source_input, id, score, coalesce(score, 0) >= 70 AND coalesce(launch_verdict <> 'do-not-launch', true) AS pass
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source_input ORDER BY created_at DESC, id DESC) AS place FROM d_scans) WHERE place = 1""",
)(lambda d: predicates.ci_gate(d.scans))
BOOK.add(
    "flt_evidence_level",
    """SELECT scan_id, k1, k2, k3, CASE WHEN confidence >= 95 THEN 'Verified Exploit' WHEN confidence >= 85 THEN 'Verified Code Risk' WHEN confidence >= 70 THEN 'Likely Risk' ELSE 'Advisory' END AS level FROM d_issues""",
)(lambda d: d.issues.select("scan_id", *ISSUE_ORDER, evidence_level(F.col("confidence")).alias("level")))
BOOK.add(
    "flt_contradictions",
    r"""SELECT scan_id, k1, k2, k3 FROM d_issues WHERE NOT (regexp_matches(lower(title), '\bno\s+(secrets?|credentials?|api[_\s-]?keys?|passwords?|tokens?)\b')
    OR regexp_matches(lower(coalesce(description, '')), '\bno\s+(secrets?|credentials?|api[_\s-]?keys?|passwords?|tokens?)\b')
    OR regexp_matches(lower(title) || ' ' || lower(coalesce(description, '')), 'secrets are safe|credentials are safe|no hardcoded secrets|no exposure of secrets|no credentials exposed')
    OR contains(lower(title), 'environment variables correctly used'))""",
)(lambda d: predicates.drop_contradictions(d.issues).select("scan_id", *ISSUE_ORDER))
BOOK.add(
    "flt_secret_ownership",
    r"""SELECT scan_id, k1, k2, k3 FROM d_issues WHERE agent_name IN ('Secret Scanner V2', 'Secret Scanner', 'Secrets Scanner', 'Secret & Credential Scanner') OR NOT coalesce(
    (regexp_matches(lower(description), '\b(api[_\s-]?key|secret|password|credential|token|access[_\s-]?key|private[_\s-]?key|connection[_\s-]?string|service[_\s-]?account)\b')
      AND regexp_matches(lower(description), '\b(detected|exposed|found|leaked|hardcoded|hard-coded|committed|embedded|visible|plain.?text|in\s+(code|source|env|client|bundle|repo))\b'))
    OR regexp_matches(lower(description), '\b(supabase|firebase|postgres|mysql|mongo|redis|stripe|razorpay|openai|twilio|sendgrid|aws|gcp|azure)\s+(password|key|url|credential|secret|token)\b'), false)""",
)(lambda d: predicates.secret_ownership(d.issues, "description").select("scan_id", *ISSUE_ORDER))
BOOK.add(
    "flt_consensus",
    """WITH v AS (SELECT scan_id, k1, k2, k3,
      CASE WHEN contains(lower(category), 'injection') OR contains(lower(category), 'auth') THEN 0.92 WHEN contains(lower(category), 'config') THEN 0.65 ELSE 0.5 END AS s,
      CASE WHEN regexp_matches(lower(coalesce(description, '')), 'gdpr|pci|hipaa|pii') THEN 0.88 WHEN regexp_matches(lower(coalesce(description, '')), 'data|privacy|consent') THEN 0.75
        WHEN regexp_matches(lower(coalesce(description, '')), 'log|audit') THEN 0.70 ELSE 0.5 END AS c,
      CASE WHEN regexp_matches(lower(title), 'payment|checkout|revenue|stripe') THEN 0.95 WHEN regexp_matches(lower(title), 'signup|onboard|auth') THEN 0.80 WHEN severity = 'critical' THEN 0.75 ELSE 0.5 END AS r FROM d_issues)
    SELECT scan_id, k1, k2, k3, CAST(floor(s * 100 + 0.5) AS INT) AS security_score, CAST(floor(c * 100 + 0.5) AS INT) AS compliance_score, CAST(floor(r * 100 + 0.5) AS INT) AS revenue_score,
      round((s + c + r) / 3, 9) >= 0.6 AS passed FROM v""",
)(lambda d: predicates.consensus(d.issues).select("scan_id", *ISSUE_ORDER, "security_score", "compliance_score", "revenue_score", "passed"))


def _carts(d: Domain):
    code = F.when(F.col("id") % 3 == 0, " launch20 ").when(F.col("id") % 3 == 1, "OLD50")
    carts = d.users.select("id", (F.col("id") % 7 * 1000 + 299).alias("base"), code.alias("code"))
    rows = [("LAUNCH20", 0.2, True, None), ("OLD50", 0.5, True, "2020-01-01"), ("OFF", 0.9, False, None)]
    coupons = d.spark.createDataFrame(rows, "code string, discount double, enabled boolean, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    return predicates.price_orders(carts, coupons, AS_OF_EVENTS)


BOOK.add(
    "flt_coupon_valid",
    """SELECT id, id % 7 * 1000 + 299 AS base, id % 3 = 0 AS valid, CAST(CASE WHEN id % 3 = 0 THEN floor((id % 7 * 1000 + 299) * (1 - 0.2::DOUBLE) + 0.5) ELSE id % 7 * 1000 + 299 END AS BIGINT) AS final FROM d_users""",
)(_carts)
BOOK.add(
    "flt_stuck_runs",
    """SELECT id, coalesce(worker_heartbeat_at, created_at) AS last_seen FROM d_runs WHERE status = 'running' AND coalesce(worker_heartbeat_at, created_at) < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE""",
)(lambda d: predicates.stuck_runs(d.runs, "2024-01-15 00:00:00"))
BOOK.add(
    "prj_tier_mask",
    """WITH p AS (SELECT s.id AS scan_id, u.plan FROM d_scans s JOIN d_users u ON s.user_id = u.id),
    x AS (SELECT i.*, plan, row_number() OVER (PARTITION BY i.scan_id ORDER BY k1, k2, k3) AS place, count(*) OVER (PARTITION BY i.scan_id) AS n,
      regexp_extract(file_path, '([^/]*)\\.ts$', 1) AS stem FROM d_issues i JOIN p ON i.scan_id = p.scan_id)
    SELECT scan_id, CAST(place AS INT) AS place, title,
      CASE WHEN plan <> 'free' OR place <= 3 THEN description WHEN description IS NULL THEN 'Upgrade to view full details'
        WHEN place <= 5 THEN description[:100] || '… (upgrade for full details)' ELSE description[:80] || '…' END AS description,
      CASE WHEN plan = 'free' AND place > 3 THEN 'Found in: /src/' || CASE WHEN length(stem) > 4 THEN stem[:3] || repeat('_', least(5, length(stem) - 3)) ELSE stem END || '.ts' END AS evidence,
      plan = 'free' AND place > 3 AS locked, plan <> 'free' OR place <= 5 AS prompt_unlocked, CASE WHEN plan = 'free' THEN greatest(0, n - 5) ELSE 0 END AS locked_issue_count FROM x""",
)(lambda d: predicates.tier_mask(d.issues, d.scans, d.users, ISSUE_ORDER))


def _masked_results(d: Domain):
    users = d.users.select(F.col("id").alias("scan_id"), "plan")
    rows = d.results.groupBy("scan_id", "engine_name").agg(F.array_sort(F.collect_list("id")).alias("items")).join(users, "scan_id")
    masked = predicates.tier_mask_results(rows, {"view": 2, "click": 1, "error": 1})
    return masked.select("scan_id", "engine_name", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"), "locked")


BOOK.add(
    "prj_tier_mask_results",
    """WITH r AS (SELECT scan_id, engine_name, list(id ORDER BY id) AS items, plan, CASE engine_name WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 1 ELSE 2147483647 END AS most
      FROM (SELECT r.*, u.plan FROM d_results r JOIN d_users u ON r.scan_id = u.id) GROUP BY scan_id, engine_name, plan)
    SELECT scan_id, engine_name, array_to_string(CASE WHEN plan = 'free' THEN items[1:most] ELSE items END, ',') AS items, CAST(CASE WHEN plan = 'free' THEN greatest(len(items) - most, 0) ELSE 0 END AS INT) AS locked FROM r""",
)(_masked_results)
BOOK.add(
    "prj_secret_redact",
    """SELECT file_id, regexp_replace(content, '([=:\\s"''`])([a-zA-Z0-9_\\-+/]{6})[a-zA-Z0-9_\\-+/]{6,}([a-zA-Z0-9_\\-+/]{4})', '\\1\\2●●●●●●\\3', 'g') AS redacted FROM d_files""",
)(lambda d: d.files.select("file_id", redact(F.col("content")).alias("redacted")))
BOOK.add(
    "prj_category_agent",
    """SELECT id, CASE kind WHEN 'secrets' THEN 'IDOR & Access Control Agent' WHEN 'auth' THEN 'Auth & Session Agent' WHEN 'injection' THEN 'Input & Validation Agent' WHEN 'config' THEN 'Reliability & Observability Agent'
      WHEN 'quality' THEN 'AI Smell Agent' ELSE 'Cleanup & Architecture Agent' END AS agent FROM (SELECT id, CASE id % 7 WHEN 0 THEN 'secrets' WHEN 1 THEN 'auth' WHEN 2 THEN 'injection' WHEN 3 THEN 'config' WHEN 4 THEN 'exposure' WHEN 5 THEN 'quality' ELSE 'other' END AS kind FROM d_scans)""",
)(
    lambda d: d.scans.select(
        "id",
        predicates.category_agent(F.element_at(F.array(*map(F.lit, ("secrets", "auth", "injection", "config", "exposure", "quality", "other"))), (F.col("id") % 7 + 1).cast("int"))).alias("agent"),
    )
)

# Joins
BOOK.add(
    "jn_recent_scans_users",
    """SELECT s.id, s.user_id, u.name, u.plan, s.score, s.created_at FROM (SELECT * FROM d_scans ORDER BY created_at DESC, id DESC LIMIT 50) s LEFT JOIN d_users u ON s.user_id = u.id""",
)(lambda d: joins.recent_scans(d.scans, d.users))
BOOK.add("jn_user_teams", "SELECT user_id, team_id, t.name AS team, role FROM d_members m JOIN d_teams t ON m.team_id = t.id")(lambda d: joins.user_teams(d.members, d.teams))
BOOK.add("jn_team_members", "SELECT team_id, user_id, u.name, u.plan, role FROM d_members m JOIN d_users u ON m.user_id = u.id")(lambda d: joins.team_roster(d.members, d.users))
BOOK.add(
    "jn_scan_detail",
    f"""WITH own AS (SELECT scan_id, string_agg(title, '|' ORDER BY k1, k2, k3) AS titles FROM d_issues GROUP BY scan_id),
    h AS (SELECT id, score, array_to_string(list(score) OVER (PARTITION BY user_id, source_input ORDER BY id), ',') AS history FROM d_scans WHERE {DONE} AND score IS NOT NULL)
    SELECT id, score, coalesce(titles, '') AS titles, history FROM h LEFT JOIN own ON id = scan_id""",
)(lambda d: joins.scan_detail(d.scans, d.issues, ISSUE_ORDER))
BOOK.add(
    "jn_conversation_context",
    """WITH m AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id),
    t AS (SELECT scan_id, string_agg(title, '|' ORDER BY n) AS titles FROM (SELECT scan_id, title, row_number() OVER (PARTITION BY scan_id ORDER BY k1, k2, k3) AS n FROM d_issues) WHERE n <= 5 GROUP BY scan_id)
    SELECT conv_id, roles, coalesce(titles, '') AS issues FROM m LEFT JOIN t ON conv_id = scan_id""",
)(lambda d: joins.conversation_context(d.table("conversations"), d.issues, ISSUE_ORDER))
BOOK.add(
    "jn_fix_history",
    """SELECT user_id, scan_id, fix_id, status, CAST(rank AS INT) AS rank FROM (SELECT s.user_id, f.*, row_number() OVER (PARTITION BY s.user_id ORDER BY f.created_at DESC, scan_id, fix_id) AS rank FROM d_fixes f JOIN d_scans s ON f.scan_id = s.id) WHERE rank <= 100""",
)(lambda d: joins.fix_history(d.fixes, d.scans))
BOOK.add(
    "jn_batch_status",
    """SELECT scan_id, count(*) AS total, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'failed') AS failed, last(status ORDER BY created_at, fix_id) AS latest FROM d_fixes GROUP BY scan_id""",
)(lambda d: joins.batch_status(d.fixes))
BOOK.add(
    "jn_cve_range",
    f"""WITH {ADV}, p AS (SELECT *, {SEMVER.format('version_spec')} AS v FROM d_deps)
    SELECT repo_id, name, version_spec, seq, cve, cvss, fixed FROM p JOIN adv ON lower(name) = lower(package) WHERE CASE cve
      WHEN 'ADV-1' THEN v < [1, 2, 3] WHEN 'ADV-2' THEN v <= [3, 5, 2] WHEN 'ADV-3' THEN v >= [1, 0, 0] AND v < [2, 0, 0] WHEN 'ADV-4' THEN v < [4, 0, 0] ELSE v < [0, 5, 0] END""",
)(lambda d: d.per_repo(joins.cve_match(d.stock, advisories(d))))
BOOK.add(
    "jn_cve_overlay",
    f"""WITH {ADV} SELECT repo_id, name, seq, cve, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' ELSE 'medium' END AS severity
    FROM d_deps JOIN adv ON lower(name) = lower(package) WHERE {SEMVER.format('version_spec')} < {SEMVER.format('fixed')}""",
)(lambda d: d.per_repo(joins.cve_overlay(d.stock, advisories(d))))
BOOK.add(
    "jn_license_risk",
    f"""WITH l AS (SELECT * FROM (VALUES {_values(sorted(LICENSES.items()))}) v(package, license))
    SELECT repo_id, name, seq, license, CASE license WHEN 'AGPL-3.0' THEN 'critical' WHEN 'BUSL-1.1' THEN 'high' ELSE 'medium' END AS severity FROM d_deps JOIN l ON name = package WHERE license IN ('AGPL-3.0', 'BUSL-1.1', 'GPL-3.0', 'LGPL-3.0')""",
)(lambda d: d.per_repo(joins.license_findings(d.stock, licenses(d), RESTRICTIVE, COPYLEFT)))
BOOK.add(
    "jn_suspicious_packages",
    """SELECT repo_id, name, seq, 'hallucinated' AS kind FROM d_deps WHERE name IN ('Brand#11', 'Brand#12') UNION ALL SELECT repo_id, name, seq, 'typosquat' FROM d_deps WHERE regexp_matches(name, '#2[0-4]$')""",
)(lambda d: joins.supply_chain(d.deps, d.spark.createDataFrame([("Brand#11",), ("Brand#12",)], "package string"), "#2[0-4]$"))
BOOK.add(
    "jn_regression_diff",
    f"""WITH done AS (SELECT * FROM d_scans WHERE status = 'completed'),
    b AS (SELECT * FROM (SELECT n.id AS scan_id, n.score, p.id AS previous_id, p.score AS previous_score, row_number() OVER (PARTITION BY n.id ORDER BY p.created_at DESC, p.id DESC) AS place
      FROM done n LEFT JOIN done p ON n.user_id = p.user_id AND n.source_input = p.source_input AND p.id < n.id) WHERE place = 1),
    k AS (SELECT scan_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS key, severity FROM d_issues), t AS (SELECT DISTINCT scan_id, key FROM k),
    c AS (SELECT b.scan_id, count(*) FILTER (t.key IS NULL) AS n, count(*) FILTER (t.key IS NULL AND severity IN ('critical', 'high')) AS g, count(*) FILTER (t.key IS NOT NULL) AS u
      FROM b JOIN k ON k.scan_id = b.scan_id LEFT JOIN t ON t.scan_id = b.previous_id AND t.key = k.key WHERE previous_id IS NOT NULL GROUP BY b.scan_id),
    f AS (SELECT b.scan_id, count(*) AS f FROM b JOIN k ON k.scan_id = b.previous_id WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.scan_id = b.scan_id AND t.key = k.key) GROUP BY b.scan_id)
    SELECT b.scan_id, previous_id, coalesce(n, 0) AS new_issues, coalesce(g, 0) AS new_grave, coalesce(f, 0) AS fixed_issues, coalesce(u, 0) AS unchanged, score - previous_score AS score_delta,
      CASE WHEN previous_id IS NULL THEN 'first' WHEN coalesce(g, 0) > 0 THEN 'regressed' WHEN coalesce(f, 0) > 0 THEN 'fixed' ELSE 'same' END AS summary
    FROM b LEFT JOIN c ON b.scan_id = c.scan_id LEFT JOIN f ON b.scan_id = f.scan_id""",
)(lambda d: joins.regression_diff(d.scans, d.issues))


def _rescans(d: Domain):
    """Lines with number 1 to 4 against those with 3 to 6 of the same order, matched without the line number."""
    base = d.issues.select(F.col("scan_id").alias("scan_key"), "k1", "agent_name", "title", "file_path", F.lit(0).alias("line_number"), "severity", "confidence", F.struct("k1", "k2", "k3").alias("seq"))
    return joins.rescan_diff(base.filter("k1 <= 4"), base.filter("k1 >= 3"))


BOOK.add(
    "jn_rescan_diff",
    """WITH x AS (SELECT scan_id AS scan_key, k1, k2, k3, concat_ws(':', agent_name, title, file_path, '0') AS key, severity, confidence FROM d_issues),
    p AS (SELECT scan_key, key, last(severity ORDER BY k1, k2, k3) AS s, last(confidence ORDER BY k1, k2, k3) AS c FROM x WHERE k1 <= 4 GROUP BY ALL),
    n AS (SELECT x.scan_key, count(*) FILTER (NOT coalesce(severity = s AND confidence = c, false)) AS new_issues, count(*) FILTER (coalesce(severity = s AND confidence = c, false)) AS unchanged,
      count(*) FILTER (severity = 'critical') AS critical_now FROM x LEFT JOIN p ON x.scan_key = p.scan_key AND x.key = p.key WHERE k1 >= 3 GROUP BY x.scan_key),
    f AS (SELECT scan_key, count(*) AS fixed_issues FROM x WHERE k1 <= 4 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.k1 >= 3 AND y.scan_key = x.scan_key AND y.key = x.key) GROUP BY scan_key)
    SELECT coalesce(n.scan_key, f.scan_key) AS scan_key, coalesce(new_issues, 0) AS new_issues, coalesce(unchanged, 0) AS unchanged, coalesce(critical_now, 0) AS critical_now, coalesce(fixed_issues, 0) AS fixed_issues
    FROM n FULL JOIN f ON n.scan_key = f.scan_key""",
)(_rescans)
BOOK.add(
    "jn_taint_range",
    """WITH n AS (SELECT DISTINCT file_path AS file, CAST(k2 % 900 AS INT) AS line, CASE k3 % 11 WHEN 0 THEN 'source' WHEN 1 THEN 'sink' WHEN 2 THEN 'sanitizer' END AS kind FROM d_issues WHERE k3 % 11 < 3)
    SELECT DISTINCT s.file, s.line AS source_line, t.line AS sink_line FROM n s JOIN n t ON s.file = t.file AND s.kind = 'source' AND t.kind = 'sink' AND t.line BETWEEN s.line AND s.line + 100
    WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.kind = 'sanitizer' AND c.file = s.file AND c.line > s.line AND c.line < t.line)""",
)(
    lambda d: joins.taint_range(
        d.issues.filter("k3 % 11 < 3")
        .select(F.col("file_path").alias("file"), (F.col("k2") % 900).cast("int").alias("line"), F.element_at(F.array(*map(F.lit, ("source", "sink", "sanitizer"))), (F.col("k3") % 11 + 1).cast("int")).alias("kind"))
        .distinct()
    )
)
