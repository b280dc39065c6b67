"""Queries over streams (replayed from files), sinks and migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.plans.book import Book
from risklake.plans.domain import Domain
from risklake.plans.relational import DONE
from risklake.sources import sinks
from risklake.streaming import operators as st

BOOK = Book()
Q = BOOK.add


def _traffic(d: Domain):
    """d_traffic as a stream."""
    e = st.event_stream(d.spark, d.sf_dir)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("scan_id"), F.col("event_type").alias("route"), (F.col("value") * 20).alias("response_time_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))


def _zoneless(out):
    """Times without a zone as in the source table."""
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else c for c, kind in out.dtypes])


def _replayed(stream, mode: str):
    """What the stream wrote."""
    return _zoneless(st.replay(stream, mode))


def _newest(rows, key: str, by: str):
    """What update mode has written last of each key: the row that counts the most."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), by).alias("x")).select(key, "x.*").select(*rows.columns)


Q("st_progress_latest", "SELECT scan_id, last(route ORDER BY ts, event_id) AS phase, max(ts) AS seen, count(*) AS events FROM d_traffic GROUP BY scan_id")(
    lambda d: _newest(_replayed(st.progress_latest(_traffic(d)), "update"), "scan_id", "events")
)
Q("st_owner_feed", "SELECT event_id, ts, scan_id, name AS subscriber, route FROM d_traffic JOIN d_users ON scan_id = id")(
    lambda d: _replayed(st.owner_feed(_traffic(d), d.users.select(F.col("id").alias("scan_id"), F.col("name").alias("subscriber"))), "append")
)
#: The four limits at the pace of the events table: name, route (none: every one), minutes, most.
LIMITS = (("global", None, 720, 3), ("auth", "click", 1440, 2), ("scans", "view", 2880, 2), ("otp", "error", 600, 1))
_limits = ", ".join(f"('{n}', {'NULL' if r is None else repr(r)}, {m}, {k})" for n, r, m, k in LIMITS)
Q(
    "st_rate_windows",
    f"""WITH RECURSIVE l(name, route, minutes, most) AS (VALUES {_limits}), done AS (SELECT max(ts) - INTERVAL 10 MINUTE AS until FROM d_traffic),
    e AS (SELECT name, minutes, most, scan_id, ts, count(*) AS n FROM d_traffic t JOIN l ON l.route IS NULL OR l.route = t.route GROUP BY ALL),
    w AS (SELECT a.name, a.most, a.scan_id, a.ts AS start, a.ts + to_minutes(CAST(a.minutes AS BIGINT)) AS upto, min(b.ts) AS next FROM e a LEFT JOIN e b ON b.name = a.name AND b.scan_id = a.scan_id AND b.ts >= a.ts + to_minutes(CAST(a.minutes AS BIGINT)) GROUP BY ALL),
    f AS (SELECT name, scan_id, min(ts) AS start FROM e GROUP BY ALL), r AS (SELECT w.* FROM f JOIN w USING (name, scan_id, start) UNION ALL SELECT w.* FROM r JOIN w ON w.name = r.name AND w.scan_id = r.scan_id AND w.start = r.next)
    SELECT r.name AS "limit", r.scan_id, r.start, CAST(sum(e.n) AS BIGINT) AS n FROM r JOIN e ON e.name = r.name AND e.scan_id = r.scan_id AND e.ts >= r.start AND e.ts < r.upto, done WHERE r.upto <= until GROUP BY r.name, r.scan_id, r.start, r.most HAVING sum(e.n) > r.most""",
)(lambda d: _replayed(st.rate_violations(_traffic(d), d.spark.createDataFrame(list(LIMITS), "limit string, route string, minutes int, most int")), "append"))
Q("st_lifecycle_counts", "SELECT route, count(*) AS n FROM d_traffic GROUP BY route")(lambda d: _newest(_replayed(st.lifecycle(_traffic(d)), "update"), "route", "n"))
Q(
    "st_session_gap",
    """WITH x AS (SELECT scan_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY scan_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM d_traffic), y AS (SELECT *, sum(new) OVER (PARTITION BY scan_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
    SELECT scan_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM y GROUP BY scan_id, k""",
)(lambda d: _zoneless(st.replay_sessions(_traffic(d))))
Q(
    "st_sliding_errors",
    """WITH b AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOUR AS start, status_code FROM d_traffic, (SELECT unnest(range(3)) AS k)) SELECT start, count(*) AS n, floor(avg((status_code >= 500)::INT) * 10000 + 0.5) / 10000 AS error_rate FROM b GROUP BY start HAVING start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM d_traffic)""",
)(lambda d: _replayed(st.sliding_errors(_traffic(d)), "append"))
Q(
    "st_traffic_health",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY route) AS seen FROM d_traffic)
    SELECT route, max(seen) AS seen, round(avg((status_code >= 500)::INT), 4) AS error_rate, round(avg(response_time_ms), 3) AS mean_ms, avg((status_code >= 500)::INT) > 0.05 OR avg(response_time_ms) > 1500 AS bottleneck FROM x WHERE n <= 100 GROUP BY route""",
)(lambda d: _replayed(st.traffic_alarm(_traffic(d)), "update"))
Q(
    "st_latency_ring",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY route) AS seen FROM d_traffic) SELECT route, max(seen) AS seen, round(avg(response_time_ms), 3) AS mean_ms FROM x WHERE n <= 1000 GROUP BY route""",
)(lambda d: _replayed(st.traffic_alarm(_traffic(d), 1000, 1), "update").select("route", "seen", "mean_ms"))
Q(
    "st_heartbeat_timeout",
    "SELECT scan_id, epoch_us(max(ts)) // 1000 AS last_seen FROM d_traffic GROUP BY scan_id HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM d_traffic) - INTERVAL 1 MINUTE",
)(lambda d: _replayed(st.stuck(_traffic(d)), "append"))

# Sinks and migrations
Q(
    "sink_engine_upsert",
    """WITH n AS (SELECT scan_id, engine_name, max(id) AS id FROM d_results WHERE id % 2 = 0 GROUP BY ALL) SELECT id, scan_id, engine_name, result FROM d_results o WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM n WHERE n.scan_id = o.scan_id AND n.engine_name = o.engine_name)
    UNION ALL SELECT o.id, o.scan_id, o.engine_name, result FROM d_results o JOIN n ON o.id = n.id""",
)(lambda d: sinks.upsert(d.results.filter("id % 2 = 1").select("id", "scan_id", "engine_name", "result"), sinks.normalize_results(d.results.filter("id % 2 = 0")).select("id", "scan_id", "engine_name", "result"), ["scan_id", "engine_name"]))
Q(
    "sink_proofs_replace",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'unknown' ELSE engine_name END AS type, CASE WHEN id % 5 = 0 THEN 'info' ELSE 'high' END AS severity, engine_name AS title, 'unknown' AS engine_name, CASE WHEN duration_ms % 4 > 0 THEN CAST(duration_ms % 4 AS DOUBLE) END AS confidence FROM d_results""",
)(
    lambda d: sinks.proofs_with_defaults(
        d.results.select("id", F.when(F.col("id") % 3 > 0, F.col("engine_name")).alias("type"), F.when(F.col("id") % 5 > 0, "high").otherwise("").alias("severity"), F.col("engine_name").alias("title"), F.lit(None).cast("string").alias("engine_name"), (F.col("duration_ms") % 4).cast("double").alias("confidence"))
    )
)


def _findings(d: Domain):
    return d.issues.select((F.col("scan_id") % 20).alias("repo"), F.col("title").alias("rule"), "severity", "confidence", F.col("file_path").alias("file"), F.col("line_number").alias("line"), F.struct("scan_id", "k1", "k2", "k3").alias("seq"))


Q(
    "sink_sarif",
    """WITH f AS (SELECT *, scan_id % 20 AS repo FROM d_issues), i AS (SELECT repo, title, row_number() OVER (PARTITION BY repo ORDER BY min((scan_id, k1, k2, k3))) - 1 AS rule_index FROM f GROUP BY repo, title)
    SELECT f.repo, scan_id, k1, k2, k3, f.title AS rule, CAST(rule_index AS INT) AS rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
      CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END AS precision, concat_ws(':', file_path, line_number, f.title) AS fingerprint FROM f JOIN i ON f.repo = i.repo AND f.title = i.title""",
)(lambda d: sinks.sarif_results(_findings(d)).select("repo", "seq.*", "rule", "rule_index", "level", "precision", "fingerprint"))
Q(
    "sink_report_json",
    """WITH i AS (SELECT scan_id, count(*) AS n, string_agg('{"k1":' || k1 || ',"k2":' || k2 || ',"k3":' || k3 || ',"title":' || to_json(title) || ',"severity":"' || severity || '"}', ',' ORDER BY k1, k2, k3, title) AS said,
      string_agg('{"title":' || to_json(title) || ',"severity":"' || severity || '"}', ',' ORDER BY k1, k2, k3, title) FILTER (has_repro) AS proofs FROM d_issues GROUP BY scan_id),
    r AS (SELECT scan_id, engine_name, max_by(result, id) AS result FROM d_results GROUP BY ALL), e AS (SELECT scan_id, string_agg(to_json(engine_name) || ':' || to_json(result), ',' ORDER BY engine_name) AS engines FROM r GROUP BY scan_id)
    SELECT s.id AS scan_id, coalesce(n, 0) AS n_issues, md5('{"scan_id":' || s.id || coalesce(',"score":' || score, '') || coalesce(',"status":"' || status || '"', '') || coalesce(',"issues":[' || said || ']', '') || coalesce(',"proofs":[' || proofs || ']', '') || coalesce(',"engines":{' || engines || '}', '') || '}') AS document_md5
    FROM d_scans s LEFT JOIN i ON i.scan_id = s.id LEFT JOIN e ON e.scan_id = s.id""",
)(lambda d: sinks.export_scan(d.scans, d.issues, d.results, d.issues.filter("has_repro")).select("scan_id", "n_issues", F.md5("document").alias("document_md5")))
Q(
    "sink_metrics_text",
    """SELECT 'http_requests_total{method="' || method || '",status="' || status_code || '"} ' || count(*) AS line FROM d_traffic GROUP BY method, status_code UNION ALL SELECT 'http_request_duration_ms_avg ' || printf('%.2f', round(avg(response_time_ms), 4)) FROM d_traffic""",
)(lambda d: sinks.metrics_text(d.traffic))


def _wide(d: Domain):
    return d.scans.select(F.col("id").alias("scan_id"), F.when(F.col("id") % 3 == 0, F.lit('{"a":1}')).alias("sbom_result"), F.when(F.col("id") % 4 == 0, F.lit('{"b":2}')).alias("taint_result"))


Q(
    "etl_wide_to_long",
    """SELECT id AS scan_id, 'sbom' AS engine_name, '{"a":1}' AS result FROM d_scans WHERE id % 3 = 0 AND id % 7 <> 0 UNION ALL SELECT id, 'taint', '{"b":2}' FROM d_scans WHERE id % 4 = 0""",
)(lambda d: sinks.unpivot_results(_wide(d), {"sbom_result": "sbom", "taint_result": "taint"}, d.scans.filter("id % 7 = 0").select(F.col("id").alias("scan_id"), F.lit("sbom").alias("engine_name"))))


def _proof_rows(d: Domain):
    text = F.when(F.col("id") % 5 == 0, "not json").when(F.col("id") % 5 == 1, '[{"title":"A"},{"title":"A","severity":"low"},{"type":"idor","confidence":0.5}]')
    return d.scans.select(F.col("id").alias("scan_id"), text.alias("proof_evidence"))


Q(
    "etl_explode_proofs",
    """SELECT id AS scan_id, 'shadow-api' AS type, 'A' AS title, 'medium' AS severity, 1.0::DOUBLE AS confidence FROM d_scans WHERE id % 5 = 1 UNION ALL SELECT id, 'idor', 'Proof Evidence', 'medium', 0.5 FROM d_scans WHERE id % 5 = 1 AND id % 2 = 0""",
)(lambda d: sinks.explode_proofs(_proof_rows(d), d.scans.filter("id % 2 = 1").select(F.col("id").alias("scan_id"), F.lit("idor").alias("type"), F.lit("Proof Evidence").alias("title"))))
Q("etl_backfill_status", f"SELECT id, CASE WHEN {DONE} AND status IS NULL THEN 'completed' ELSE status END AS status FROM d_scans")(lambda d: sinks.backfill_status(d.scans).select("id", "status"))
Q("etl_drop_wide", "SELECT id AS scan_id FROM d_scans")(
    lambda d: sinks.drop_wide(_wide(d), ["sbom_result", "taint_result"], sinks.unpivot_results(_wide(d), {"sbom_result": "sbom", "taint_result": "taint"}, d.results.select("scan_id", "engine_name").limit(0)))
)
