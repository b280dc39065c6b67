"""Window operators: latest per group, trends, percentiles, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklake.functions.scalars import half_up, is_completed


def _done(scans: DataFrame) -> DataFrame:
    return scans.filter(is_completed(F.col("status"), F.col("score")))


def risk_band(score: Column) -> Column:
    return F.when(score < 55, "critical").when(score < 70, "high").when(score < 85, "medium").otherwise("low")


def portfolio(scans: DataFrame, newest: int = 200) -> DataFrame:
    """Each user's applications by their latest completed scan among the user's newest ones, with a risk band."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    own = _done(scans).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= newest)
    latest = F.row_number().over(Window.partitionBy("user_id", "source_input").orderBy("_n"))
    return own.withColumn("_latest", latest).filter("_latest = 1").select("user_id", "source_input", "id", "score", risk_band(F.coalesce("score", F.lit(0))).alias("risk"))


def app_overview(scans: DataFrame, newest: int = 50, history: int = 10) -> DataFrame:
    """Per application within the user's newest scans: latest score, change, number of scans and the last scores, oldest first."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    own = scans.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= newest)
    app = Window.partitionBy("user_id", "source_input")
    seen = own.withColumn("_k", F.row_number().over(app.orderBy("_n"))).withColumn("_before", F.lead("score").over(app.orderBy("_n"))).withColumn("scan_count", F.count("*").over(app))
    recent = F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= history, F.struct((-F.col("_k")).alias("k"), F.coalesce("score", F.lit(-1)).alias("s"))))), lambda x: x["s"].cast("string"))
    return seen.groupBy("user_id", "source_input").agg(
        F.max(F.when(F.col("_k") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("_k") == 1, F.col("score") - F.col("_before"))).alias("trend"),
        F.max("scan_count").alias("scan_count"),
        F.concat_ws(",", recent).alias("history"),
    )


def critical_packages(packages: DataFrame, most: int = 3) -> DataFrame:
    """packages(scan_id, name) of critical severity -> scan_id, n, packages: how many, and the first names, comma-joined."""
    named = packages.groupBy("scan_id", "name").agg(F.count("*").alias("_n"))
    first = F.row_number().over(Window.partitionBy("scan_id").orderBy("name"))
    placed = named.withColumn("_place", first)
    return placed.groupBy("scan_id").agg(F.sum("_n").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("_place") <= most, F.col("name"))))).alias("packages"))


def pulse(scans: DataFrame, critical: DataFrame, drop_at: int = 5) -> DataFrame:
    """critical(scan_id, n, packages): each user's last two completed scans; an alert if the score dropped or the latest has critical packages, of
    which `packages` names the first three."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    two = _done(scans).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2)
    pair = two.groupBy("user_id").agg(*[F.max(F.when(F.col("_n") == n, F.col(c))).alias(f"_{c}{n}") for n in (1, 2) for c in ("id", "score")])
    joined = pair.join(critical, pair["_id1"] == critical["scan_id"], "left")
    drop = F.greatest(F.lit(0), F.coalesce(F.col("_score2") - F.col("_score1"), F.lit(0)))
    n = F.coalesce("n", F.lit(0))
    reason = F.concat_ws("; ", F.when(drop >= drop_at, F.concat(F.lit("score dropped by "), drop.cast("string"))), F.when(n > 0, F.concat(n.cast("string"), F.lit(" critical packages"))))
    return joined.select("user_id", F.col("_id1").alias("scan_id"), drop.alias("drop"), ((drop >= drop_at) | (n > 0)).alias("alert"), reason.alias("reason"), "packages")


def _percentile(below: Column, others: Column) -> Column:
    return F.when(others > 0, half_up(below * 100 / others)).otherwise(F.lit(50))


def value_percentile(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Share of the other rows of the group strictly below, in percent; 50 without others. Ranks come from a histogram over the
    distinct values, so no task sorts a whole group's rows."""
    keys = by or []
    bins = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(value)
    bins = bins.withColumn("_below", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bins = bins.withColumn("_all", F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(1)]))))
    return rows.join(bins, [*keys, value]).withColumn("percentile", _percentile(F.col("_below"), F.col("_all") - 1)).withColumn("others", F.col("_all") - 1).drop("_n", "_below", "_all")


def score_percentile(scans: DataFrame) -> DataFrame:
    scored = scans.filter((F.col("status") == "completed") & F.col("score").isNotNull()).select("id", "score")
    return value_percentile(scored, "score").select("id", "score", "percentile")


def issue_percentiles(scans: DataFrame, issues: DataFrame, areas: dict[str, list[str]]) -> DataFrame:
    """100 minus the percentile of each area's number of issues; areas by parts of the agent's name."""
    met = {a: F.count_if(F.col("agent_name").rlike("|".join(parts))).alias(a) for a, parts in areas.items()}
    counted = issues.groupBy("scan_id").agg(*met.values())
    base = scans.filter((F.col("status") == "completed") & F.col("score").isNotNull()).select("id")
    rows = base.join(counted, base["id"] == counted["scan_id"], "left").na.fill(0, list(areas)).select("id", *areas)
    for area in areas:
        rows = value_percentile(rows, area).withColumn(f"{area}_percentile", 100 - F.col("percentile")).drop("percentile", "others")
    return rows.select("id", *(f"{a}_percentile" for a in areas))


def peer_rank(scans: DataFrame, peer: str, least: int = 3) -> DataFrame:
    scored = scans.filter((F.col("status") == "completed") & F.col("score").isNotNull() & F.col(peer).isNotNull()).select("id", "score", peer)
    ranked = value_percentile(scored, "score", [peer]).filter(F.col("others") >= least)
    return ranked.select("id", peer, F.greatest(F.lit(1), 100 - F.col("percentile")).cast("int").alias("top_percent"))


def score_history(scans: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id", "source_input").orderBy("id")
    return scans.filter(F.col("score").isNotNull()).select("id", "user_id", "source_input", "score", F.row_number().over(w).alias("n"), F.lag("score").over(w).alias("previous"))


def drift(snapshots: DataFrame) -> DataFrame:
    """snapshots(repo, id, at, complexity, tool): change against the snapshot before, tripled within two days, and the days left."""
    w = Window.partitionBy("repo").orderBy("at", "id")
    before = F.lag("complexity").over(w)
    days = (F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w))) / 86_400
    change = F.abs(F.col("complexity") - before) / F.greatest(F.lit(1), before)
    raw = F.when(before.isNull(), 0.35).otherwise(F.least(F.lit(1.0), change * F.when(days < 2, 3).otherwise(1)))
    first = F.first("tool").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = snapshots.withColumn("_raw", raw).withColumn("_first", first)
    left = F.floor(365 / F.exp(F.col("_raw") * 3))
    return out.select("repo", "id", half_up(F.round("_raw", 9), 2).alias("drift"), (~F.col("tool").eqNullSafe(F.col("_first"))).alias("shifted"), left.alias("days_left"), (left < 14).alias("rewrite"))


def complexity_trend(history: DataFrame, goal: float = 100.0) -> DataFrame:
    """history(repo, id, at, complexity): growth per day from the first to the last snapshot and days until the goal."""
    order = F.struct("at", "id")
    ends = history.groupBy("repo").agg(F.min_by("complexity", order).alias("_a"), F.max_by("complexity", order).alias("_b"), ((F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))) / 86_400).alias("_days"))
    growth = F.when(F.col("_days") > 0, (F.col("_b") - F.col("_a")) / F.col("_days")).otherwise(F.lit(0.0))
    rate = F.round(growth, 9)
    return ends.select("repo", half_up(rate, 4).alias("growth"), (rate > 1).alias("regressed"), F.when((rate > 0) & (F.col("_b") < goal), F.ceil(F.round((goal - F.col("_b")) / growth, 6))).alias("days_to_goal"))


def traffic_health(events: DataFrame, least: int = 50, newest: int = 100) -> DataFrame:
    """Per route with enough events: errors and mean latency of the newest ones, and whether they are too many or too slow."""
    w = Window.partitionBy("route")
    last = events.withColumn("_n", F.row_number().over(w.orderBy(F.col("ts").desc(), F.col("event_id").desc()))).withColumn("_all", F.count("*").over(w))
    kept = last.filter((F.col("_all") >= least) & (F.col("_n") <= newest))
    errors, mean = F.count_if(F.col("status_code") >= 500) / F.count("*"), F.avg("response_time_ms")
    return kept.groupBy("route").agg(half_up(F.round(errors, 9), 4).alias("error_rate"), half_up(F.round(mean, 6), 2).alias("mean_ms"), ((errors > 0.05) | (mean > 1500)).alias("bottleneck"))


def latency_ring(events: DataFrame, keep: int = 1000) -> DataFrame:
    """Mean of the last `keep` durations at each event of a route."""
    w = Window.partitionBy("route").orderBy("ts", "event_id").rowsBetween(1 - keep, 0)
    return events.select("event_id", "route", half_up(F.round(F.avg("response_time_ms").over(w), 6), 3).alias("mean_ms"))


def temporal_rules(sequence: DataFrame, rules: DataFrame) -> DataFrame:
    """sequence(repo, pos, kind), rules(rule, first, then): elements of kind `first` without a later one of kind `then`."""
    joined = sequence.join(F.broadcast(rules), F.col("kind").isin(F.col("first"), F.col("then")))
    later = F.max(F.when(F.col("kind") == F.col("then"), F.col("pos"))).over(Window.partitionBy("repo", "rule").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    return joined.withColumn("_later", later).filter((F.col("kind") == F.col("first")) & F.col("_later").isNull()).select("repo", "rule", "pos")


def rule_context(lines: DataFrame, match: Column, context: Column, before: int = 30, after: int = 29) -> DataFrame:
    """Lines that match and have a context line near: RANGE frame over line numbers."""
    w = Window.partitionBy("file_id").orderBy("line_no").rangeBetween(-before, after)
    return lines.withColumn("_match", match).withColumn("_near", F.max(context).over(w)).filter("_match AND _near").drop("_match", "_near")


def near_lines(lines: DataFrame, subject: Column, guard: Column, reach: int = 5) -> DataFrame:
    """Lines of the subject without the guard on the same or the next lines."""
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(0, reach)
    return lines.withColumn("_subject", subject).withColumn("_guarded", F.max(guard).over(w)).filter("_subject AND NOT _guarded").drop("_subject", "_guarded")


def type_sequence(nodes: DataFrame, pattern: list[str]) -> DataFrame:
    """nodes(file_id, pos, kind): each file's kinds in order, whether they hold the pattern, and a confidence by its length."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), "::")
    out = nodes.groupBy("file_id").agg(said.alias("sequence"))
    return out.select("file_id", F.substring(F.sha2("sequence", 256), 1, 16).alias("hash16"), F.col("sequence").contains("::".join(pattern)).alias("found"), F.lit(min(95, 60 + 3 * len(pattern))).alias("confidence"))
