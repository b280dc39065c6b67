"""Counts, scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklake.functions.scalars import clamp, half_up, is_completed, semver, severity_rank

SEVERITIES = ("critical", "high", "medium", "low")
PLAN_PRICE = {"creator": 299, "enterprise": 9999}
PLAN_LIMIT = {"free": 2, "creator": 12}
#: Traffic model: monthly visits and value of a visitor.
VISITS = 10_000
VISITOR_VALUE = 50


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("scan_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def public_stats(scans: DataFrame, issues: DataFrame, as_of: str) -> DataFrame:
    recent = is_completed(F.col("status"), F.col("score")) & (F.col("created_at") >= _ts(as_of) - F.expr("INTERVAL 30 DAYS"))
    a = scans.agg(F.count("*").alias("scans"), F.count_if(recent).alias("recent_scans"))
    b = issues.agg(F.count("*").alias("issues"), F.count_if("has_repro").alias("with_repro"))
    return a.crossJoin(b)


def breakdowns(users: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts by plan, status, verdict (if any), framework and tool: one pass over the scans with grouping sets."""
    long = scans.select(
        F.explode(
            F.array(
                F.struct(F.lit("status").alias("dim"), F.coalesce("status", F.lit("unknown")).alias("value")),
                F.struct(F.lit("verdict").alias("dim"), F.col("launch_verdict").alias("value")),
                F.struct(F.lit("framework").alias("dim"), F.coalesce("framework", F.lit("unknown")).alias("value")),
                F.struct(F.lit("tool").alias("dim"), F.coalesce("vibe_tool", F.lit("unknown")).alias("value")),
            )
        ).alias("x")
    ).select("x.*")
    plans = users.select(F.lit("plan").alias("dim"), F.col("plan").alias("value"))
    return long.filter(F.col("value").isNotNull()).unionByName(plans).groupBy("dim", "value").agg(F.count("*").alias("n"))


def monthly_scans(scans: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """The last calendar months, those without scans included."""
    start = F.date_trunc("month", _ts(as_of))
    calendar = scans.sparkSession.range(1).select(F.explode(F.sequence(F.add_months(start, 1 - months).cast("timestamp"), start, F.expr("INTERVAL 1 MONTH"))).alias("month"))
    counted = scans.groupBy(F.date_trunc("month", "created_at").alias("month")).agg(F.count("*").alias("n"))
    joined = calendar.join(counted, "month", "left")
    return joined.select(F.date_format("month", "yyyy-MM").alias("label"), F.year("month").alias("year"), F.month("month").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def month_to_date(scans: DataFrame, as_of: str) -> DataFrame:
    now = _ts(as_of)
    return scans.filter((F.col("created_at") >= F.date_trunc("month", now)) & (F.col("created_at") <= now)).agg(F.count("*").alias("scans"), F.count_distinct("user_id").alias("users"))


def saas_metrics(users: DataFrame) -> DataFrame:
    paid = {p: F.count_if(F.col("plan") == p) for p in PLAN_PRICE}
    one = users.agg(F.count("*").alias("users"), *[n.alias(p) for p, n in paid.items()])
    mrr = sum((F.col(p) * price for p, price in PLAN_PRICE.items()), F.lit(0))
    some = F.col("users") > 0
    return one.select(
        "users",
        mrr.alias("mrr"),
        (mrr * 12).alias("arr"),
        F.when(some, half_up(mrr / F.col("users"))).otherwise(F.lit(0)).alias("arpu"),
        F.when(some, half_up((F.col("creator") + F.col("enterprise")) * 100 / F.col("users"))).otherwise(F.lit(0)).alias("conversion"),
    )


def severity_totals(scans: DataFrame, counts: DataFrame) -> DataFrame:
    joined = scans.join(counts, scans["id"] == counts["scan_id"], "left")
    return joined.agg(*[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(s) for s in SEVERITIES], half_up(F.avg("score")).alias("mean_score"))


def failure_prevalence(scans: DataFrame, issues: DataFrame) -> DataFrame:
    """For every issue title: percent of completed scans that have it, in all and by tool. One row per scan and title is shuffled."""
    done = scans.filter(is_completed(F.col("status"), F.col("score"))).select("id", F.coalesce("vibe_tool", F.lit("unknown")).alias("tool"))
    sizes = done.groupBy("tool").agg(F.count("*").alias("tool_scans"))
    total = sizes.agg(F.sum("tool_scans").alias("scans"))
    held = issues.select("scan_id", "title").distinct().join(done, F.col("scan_id") == F.col("id"))
    by_tool = held.groupBy("title", "tool").agg(F.count("*").alias("hit")).join(F.broadcast(sizes), "tool")
    whole = Window.partitionBy("title")
    return by_tool.crossJoin(F.broadcast(total)).select(
        "title",
        "tool",
        half_up(F.sum("hit").over(whole) * 100 / F.col("scans"), 1).alias("percent"),
        half_up(F.col("hit") * 100 / F.col("tool_scans")).alias("tool_percent"),
    )


def penalty() -> Column:
    caps = {"critical": (12, 55), "high": (5, 28), "medium": (2, 12), "low": (1, 5)}
    return sum((F.least(F.col(s) * each, F.lit(most)) for s, (each, most) in caps.items()), F.lit(0))


def scan_score(issues: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(0), 100 - penalty())
    counted = issue_counts(issues).withColumn("score", score)
    verdict = F.when((F.col("critical") > 0) | (F.col("score") < 70), "do-not-launch").when((F.col("high") > 0) | (F.col("score") < 90), "caution").otherwise("ready")
    return counted.select("scan_id", *SEVERITIES, "score", verdict.alias("verdict"))


def agent_score(issues: DataFrame) -> DataFrame:
    """The same penalty per agent; the verdict by score alone."""
    counted = issues.groupBy("scan_id", "agent_name").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    scored = counted.withColumn("score", F.greatest(F.lit(0), 100 - penalty()))
    verdict = F.when(F.col("score") >= 70, "ready").when(F.col("score") >= 40, "caution").otherwise("do-not-launch")
    return scored.select("scan_id", "agent_name", "score", verdict.alias("verdict"))


def launch_verdict(scans: DataFrame, issues: DataFrame) -> DataFrame:
    joined = scans.select("id", "score").join(issue_counts(issues), scans["id"] == F.col("scan_id"), "left").na.fill(0, list(SEVERITIES))
    blockers = F.array_compact(
        F.array(
            F.when(F.col("critical") > 0, F.concat(F.col("critical").cast("string"), F.lit(" critical"))),
            F.when(F.col("high") > 0, F.concat(F.col("high").cast("string"), F.lit(" high"))),
            F.when(F.coalesce("score", F.lit(0)) < 70, F.lit("score below 70")),
        )
    )
    return joined.select("id", F.concat_ws("; ", blockers).alias("blockers"), (F.size(blockers) == 0).alias("pass"))


def _month(scans: DataFrame, as_of: str) -> DataFrame:
    now = _ts(as_of)
    return scans.filter((F.col("created_at") >= F.date_trunc("month", now)) & (F.col("created_at") <= now))


def _limit() -> Column:
    return F.coalesce("scan_limit", F.create_map(*[F.lit(x) for pair in PLAN_LIMIT.items() for x in pair])[F.col("plan")])


def quota_usage(users: DataFrame, scans: DataFrame, as_of: str) -> DataFrame:
    used = _month(scans, as_of).filter(~F.col("status").eqNullSafe("failed")).groupBy("user_id").agg(F.count("*").alias("used"))
    joined = users.join(used, users["id"] == used["user_id"], "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("limit", _limit())
    return joined.select("id", "plan", "used", "limit", (F.col("limit").isNull() | (F.col("used") < F.col("limit"))).alias("allowed"))


def quota_with_rescans(users: DataFrame, scans: DataFrame, results: DataFrame, as_of: str, engine: str = "rescanDiff") -> DataFrame:
    """Adds the month's scans that were scanned again, each once."""
    again = results.filter(F.col("engine_name") == engine).join(_month(scans, as_of).select(F.col("id").alias("scan_id"), "user_id"), "scan_id")
    again = again.groupBy("user_id").agg(F.count_distinct("scan_id").alias("rescans"))
    base = quota_usage(users, scans, as_of)
    return base.join(again, base["id"] == again["user_id"], "left").select("id", (F.col("used") + F.coalesce("rescans", F.lit(0))).alias("used"))


def team_twin(findings: DataFrame, least: int = 10) -> DataFrame:
    """findings(team, category, fixed): teams with enough findings, their most frequent category (the first by name on ties) and how much of it all is fixed."""
    by_kind = findings.groupBy("team", "category").agg(F.count("*").alias("n"), F.count_if("fixed").alias("fixed"))
    team = by_kind.groupBy("team").agg(F.sum("n").alias("findings"), F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("top_category"), F.sum("fixed").alias("_fixed"))
    velocity = F.col("_fixed") / F.col("findings")
    return team.filter(F.col("findings") >= least).select("team", "findings", "top_category", half_up(velocity, 4).alias("velocity"), half_up(65 + 20 * velocity).alias("percentile"))


def severity_category(findings: DataFrame) -> DataFrame:
    """Counts by category and severity with all totals."""
    out = findings.rollup("category", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return out.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("severity", F.lit("all")).alias("severity"), "n", F.col("level").cast("int").alias("level"))


def by_cwe(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("cwe").alias("cwe")).groupBy("cwe").agg(F.count("*").alias("n"))


def framework_rollup(findings: DataFrame) -> DataFrame:
    return findings.groupBy("framework").agg(F.count("*").alias("n"), F.max_by("severity", severity_rank(F.col("severity"))).alias("worst"), F.max("penalty").alias("max_penalty"))


def penalty_total(findings: DataFrame) -> DataFrame:
    """Sum of each rule's largest penalty, per framework and overall."""
    rules = findings.groupBy("framework", "rule").agg(F.max("penalty").alias("penalty"))
    return rules.rollup("framework").agg(F.sum("penalty").alias("penalty")).select(F.coalesce("framework", F.lit("all")).alias("framework"), "penalty")


WEIGHT = {"critical": 1.0, "high": 0.5, "medium": 0.25, "low": 0.1}
FACTOR = {"GDPR": 25, "PCI": 20, "HIPAA": 20}


def compliance_scores(findings: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for pair in WEIGHT.items() for x in pair])[F.col("severity")]
    summed = findings.groupBy("repo").agg(*[F.coalesce(F.sum(F.when(F.col("framework") == f, weight)), F.lit(0.0)).alias(f) for f in FACTOR])
    scored = summed.select("repo", *[half_up(F.greatest(F.lit(0.0), 100 - F.round(F.col(f) * k, 6)), 2).alias(f.lower()) for f, k in FACTOR.items()])
    return scored.withColumn("overall", half_up(F.round(sum((F.col(f.lower()) for f in FACTOR), F.lit(0.0)) / len(FACTOR), 6), 2))


def package_rollup(matches: DataFrame, deps: DataFrame) -> DataFrame:
    """Per repository and package: advisories, worst score, highest fixed version (as versions order); and of the repository: packages, vulnerable
    ones by severity, and the advisory with the highest score (the smallest name on ties)."""
    worst = F.max("cvss")
    severity = lambda x: F.when(x >= 9, "critical").when(x >= 7, "high").when(x >= 4, "medium").otherwise("low")
    rows = matches.groupBy("repo_id", "name").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("cve"))).alias("cves"),
        worst.alias("max_cvss"),
        severity(worst).alias("worst"),
        F.max_by("fixed", semver(F.col("fixed"))).alias("fix_version"),
        F.min(F.struct((-F.col("cvss")).alias("less"), "cve")).alias("_top"),
    )
    total = deps.groupBy("repo_id").agg(F.count_distinct("name").alias("packages"))
    repo = rows.groupBy("repo_id").agg(F.count("*").alias("vulnerable"), *[F.count_if(F.col("worst") == k).alias(k) for k in ("critical", "high", "medium")], F.min("_top").alias("_top"))
    repo = repo.join(total, "repo_id").select("repo_id", "packages", "vulnerable", "critical", "high", "medium", F.col("_top.cve").alias("top_cve"))
    return rows.drop("_top").join(repo, "repo_id")


def decay(age_days: Column, deprecated: Column) -> Column:
    return F.when(deprecated, 1.0).when(age_days > 730, 0.9).when(age_days > 365, 0.7).when(age_days > 180, 0.4).when(age_days > 90, 0.2).otherwise(0.0)


def dep_health(packages: DataFrame) -> DataFrame:
    """packages(repo_id, age_days, deprecated, maintainers, vulnerabilities, reachable): by repository mean decay, age and maintainers, packages by
    severity, freshness, maintainer and supply chain risk, and the overall score."""
    d, v = F.col("decay"), F.col("vulnerabilities")
    level = F.when((v >= 3) & (d > 0.7) & F.col("reachable"), "critical").when((v >= 2) & (d > 0.5), "high").when((v >= 1) | (d > 0.6), "medium").when(d > 0.3, "low").otherwise("none")
    scored = packages.withColumn("decay", decay(F.col("age_days"), F.col("deprecated"))).withColumn("severity", level)
    counts = {"_deprecated": F.col("deprecated"), "_stale": F.col("age_days") > 365, "_vulnerable": v > 0, "_few": F.col("maintainers") <= 1} | {k: F.col("severity") == k for k in ("critical", "high", "medium", "low")}
    n = scored.groupBy("repo_id").agg(F.count("*").alias("packages"), F.avg("decay").alias("_decay"), F.avg("age_days").alias("_age"), F.avg("maintainers").alias("_hands"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    whole = lambda x: half_up(F.round(x, 9))
    freshness = F.greatest(F.lit(0), 100 - whole(50 * F.col("_stale") / F.col("packages")) - 15 * F.col("_deprecated"))
    n = n.withColumn("freshness", freshness.cast("long")).withColumn("maintainer_risk", whole(30 * F.col("_few") / F.col("packages")).cast("long"))
    lost = 15 * F.col("critical") + 8 * F.col("high") + 3 * F.col("_stale") + 5 * F.col("_deprecated") + 4 * F.col("_vulnerable")
    score = F.greatest(F.lit(0), F.least(F.lit(100), whole(F.greatest(F.lit(0), 100 - lost) - 0.3 * F.col("maintainer_risk"))))
    risk = F.when((F.col("critical") >= 2) | (F.col("high") >= 4), "high").when((F.col("critical") >= 1) | (F.col("high") >= 2), "medium").otherwise("low")
    means = [half_up(F.round("_decay", 9), 4).alias("mean_decay"), whole(F.col("_age")).cast("long").alias("mean_age"), half_up(F.round("_hands", 9), 1).alias("mean_maintainers")]
    return n.select("repo_id", "packages", *means, "critical", "high", "medium", "low", "freshness", "maintainer_risk", risk.alias("supply_chain_risk"), score.cast("long").alias("score"))


def dep_decay_score(packages: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    raw = 100 - 40 * share(F.col("deprecated")) - 25 * share(F.col("age_days") > 365) - 20 * share(F.col("vulnerable")) + F.least(2 * F.avg("maintainers"), F.lit(15.0))
    return packages.groupBy("repo_id").agg(half_up(F.round(clamp(raw, 0.0, 100.0), 6)).alias("score"))


def maintenance(packages: DataFrame) -> DataFrame:
    age = F.when(F.col("age_days") > 730, 0.4).when(F.col("age_days") > 365, 0.2).otherwise(0.0)
    hands = F.when(F.col("maintainers") == 0, -0.3).when(F.col("maintainers") == 1, -0.1).when(F.col("maintainers") >= 5, 0.1).otherwise(0.0)
    score = 1.0 - age + hands - F.when(F.col("license").isNull(), 0.1).otherwise(0.0)
    return packages.select("repo_id", "name", "seq", half_up(F.round(clamp(score, 0.0, 1.0), 6), 2).alias("maintenance"))


#: Share of conversions that an issue of a route costs, by severity; fixed.
DROP = {"critical": 1.0, "high": 0.5, "medium": 0.15, "low": 0.03}


def route_impact(issue_routes: DataFrame) -> DataFrame:
    """issue_routes(severity, weight, ...) -> with drop (percent of conversions), impact (revenue a month) and finding, whether they are worth one."""
    lost = F.col("weight") * F.create_map(*[F.lit(x) for pair in DROP.items() for x in pair])[F.col("severity")]
    made = issue_routes.withColumn("drop", half_up(F.round(lost * 100, 6)).cast("long")).withColumn("impact", half_up(F.round(VISITS * lost * VISITOR_VALUE, 6)).cast("long"))
    return made.withColumn("finding", (F.col("drop") > 0) & (F.col("impact") > 100))


def funnel(issue_routes: DataFrame, stages: DataFrame, checkout: str = "checkout", retention: str = "retention") -> DataFrame:
    """stages(stage, weight): routes, issues, drop and revenue at risk of every stage, those without issues too; and beside each the scores of the
    whole funnel, of checkout and retention, and their mix of .3, .5 and .2."""
    met = route_impact(issue_routes.join(F.broadcast(stages), "stage"))
    met = met.groupBy("stage").agg(F.count_distinct("route").alias("routes"), F.count("*").alias("issues"), F.sum(F.when(F.col("finding"), F.col("drop"))).alias("_drop"), F.sum(F.when(F.col("finding"), F.col("impact"))).alias("_impact"))
    joined = stages.join(met, "stage", "left").na.fill(0, ["routes", "issues", "_drop", "_impact"])
    issues = lambda stage: F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("issues"))), F.lit(0))
    scores = joined.agg(
        F.greatest(F.lit(0), half_up(F.round(100 - F.sum(F.least(15 * F.col("issues") * F.col("weight"), F.lit(40.0))), 6))).cast("long").alias("funnel_health"),
        (100 - F.least(20 * issues(checkout), F.lit(60))).cast("long").alias("checkout_score"),
        (100 - F.least(10 * issues(retention), F.lit(40))).cast("long").alias("retention_score"),
    )
    scores = scores.withColumn("business_score", half_up(F.round(0.5 * F.col("checkout_score") + 0.3 * F.col("funnel_health") + 0.2 * F.col("retention_score"), 6)).cast("long"))
    return joined.select("stage", "routes", "issues", F.least("_drop", F.lit(100)).cast("long").alias("drop_percent"), F.col("_impact").alias("revenue_at_risk")).crossJoin(F.broadcast(scores))


def revenue_at_risk(issue_routes: DataFrame, stages: DataFrame) -> DataFrame:
    """A row per issue of a route that is worth a finding."""
    return route_impact(issue_routes.join(F.broadcast(stages), "stage")).filter("finding").select("route", "stage", "severity", "impact")


def obs_coverage(ops: DataFrame) -> DataFrame:
    """ops(service, logged, measured, traced): shares in percent and the weighted score."""
    share = lambda c: F.count_if(F.col(c)) / F.count("*")
    raw = 60 * share("logged") + 25 * share("measured") + 15 * share("traced")
    return ops.groupBy("service").agg(F.count("*").alias("ops"), half_up(F.round(raw, 6)).alias("score"))


def reliability(ops: DataFrame) -> DataFrame:
    n = F.count("*")
    guarded = 100 - 60 * F.count_if(~F.col("protected")) / n
    heard = 100 - 25 * F.count_if(F.col("swallowed")) / n
    return ops.groupBy("service").agg(half_up(F.round(0.6 * guarded + 0.4 * heard, 6), 1).alias("score"))


def debt(findings: DataFrame, top: int = 5) -> DataFrame:
    """findings(repo, level error / warn / info, category, path): capped penalties, minutes to fix, findings by category and the files that have most."""
    n = {k: F.count_if(F.col("level") == k) for k in ("error", "warn", "info")}
    lost = F.least(n["error"] * 15, F.lit(40)) + F.least(n["warn"] * 6, F.lit(35)) + F.least(n["info"] * 2, F.lit(15))
    minutes = n["error"] * 20 + n["warn"] * 10 + n["info"] * 5
    total = findings.groupBy("repo").agg(F.count("*").alias("findings"), F.greatest(F.lit(0), 100 - lost).alias("score"), minutes.alias("minutes"))
    said = lambda order: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))))
    kinds = findings.groupBy("repo", F.col("category").alias("name")).agg(F.count("*").alias("n")).groupBy("repo").agg(said(F.struct("name", "n")).alias("categories"))
    files = findings.filter(F.col("path").isNotNull()).groupBy("repo", F.col("path").alias("name")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "name"))
    files = files.withColumn("place", place).filter(F.col("place") <= top).groupBy("repo").agg(said(F.struct("place", "name", "n")).alias("top_files"))
    return total.join(kinds, "repo", "left").join(files, "repo", "left")


def type_confidence(metrics: DataFrame) -> DataFrame:
    """metrics(repo, typed, total, depth, externals, complexity): product of factors within 0.10 to 0.99."""
    density = 0.5 + 0.5 * F.col("typed") / F.col("total")
    product = density * (1 / (1 + 0.05 * F.col("depth"))) * (1 / (1 + 0.02 * F.col("externals"))) * (1 / (1 + 0.01 * F.col("complexity")))
    return metrics.select("repo", half_up(F.round(clamp(product, 0.10, 0.99), 9), 4).alias("confidence"))


def clone_hash_groups(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.groupBy("structural_hash").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string"))).alias("members")).filter(F.col("n") > 1)


def json_numbers(results: DataFrame, engine: str, paths: dict[str, str]) -> DataFrame:
    """An engine's results with a double per path (name -> path); null where the path is missing or no number."""
    own = results.filter(F.col("engine_name") == engine)
    return own.withColumns({name: F.get_json_object("result", path).try_cast("double") for name, path in paths.items()})


def json_rows(results: DataFrame, engine: str, field: str, schema: str) -> DataFrame:
    """One row per element of an engine's JSON array of structs; a missing or empty array gives none."""
    listed = F.explode(F.from_json(F.get_json_object("result", f"$.{field}"), f"array<{schema}>")).alias("x")
    return results.filter(F.col("engine_name") == engine).select("id", "scan_id", "created_at", listed).select("id", "scan_id", "created_at", "x.*")


def json_length(path: str) -> Column:
    """Elements of the JSON array at path; 0 where there is none."""
    return F.coalesce(F.json_array_length(F.get_json_object("result", path)), F.lit(0))


def json_entropy(results: DataFrame, limit: int = 20) -> DataFrame:
    """Entropy results with leaks, by average entropy (ties by id)."""
    rows = json_numbers(results, "entropy", {"avg_entropy": "$.avgEntropy"}).withColumn("leaks", json_length("$.entropyLeaks")).filter("leaks > 0")
    return rows.orderBy(F.col("avg_entropy").desc(), "id").limit(limit).select("id", "scan_id", "avg_entropy", "leaks")


def json_leaks(results: DataFrame, limit: int = 50) -> DataFrame:
    """The leaks of highest entropy (ties by id and file)."""
    leaks = json_rows(results, "entropy", "entropyLeaks", "struct<file:string,entropy:double,patternType:string>")
    return leaks.orderBy(F.col("entropy").desc(), "id", "file").limit(limit).select("id", "scan_id", "file", "entropy", F.col("patternType").alias("type"))


def json_bypasses(results: DataFrame) -> DataFrame:
    return json_rows(results, "bypass", "constraintBypasses", "struct<file:string,constraint:string,conditionType:string,bypassType:string>")


def json_newest_bypasses(results: DataFrame, limit: int = 50) -> DataFrame:
    return json_bypasses(results).orderBy(F.col("id").desc(), "file").limit(limit).select("id", "scan_id", "file", "constraint", F.col("conditionType").alias("condition"), F.col("bypassType").alias("bypass"))


def json_bypass_summary(results: DataFrame) -> DataFrame:
    """Bypasses and their scans by condition and kind."""
    return json_bypasses(results).groupBy(F.col("conditionType").alias("condition"), F.col("bypassType").alias("bypass")).agg(F.count("*").alias("n"), F.count_distinct("scan_id").alias("scans"))


def json_leaks_and_bypasses(results: DataFrame, limit: int = 20) -> DataFrame:
    """Scans with leaks and bypasses both, most bypasses first (ties by scan). One aggregate by scan, without a join."""
    leaks = F.sum(F.when(F.col("engine_name") == "entropy", json_length("$.entropyLeaks")))
    bypasses = F.sum(F.when(F.col("engine_name") == "bypass", F.get_json_object("result", "$.totalBypasses").try_cast("long")))
    told = results.filter(F.col("engine_name").isin("entropy", "bypass")).groupBy("scan_id").agg(leaks.alias("leaks"), bypasses.alias("bypasses"))
    return told.filter("leaks > 0 AND bypasses > 0").orderBy(F.col("bypasses").desc(), "scan_id").limit(limit)


def json_reality(results: DataFrame, limit: int = 20) -> DataFrame:
    """Reality results by score, the lowest first (ties by id)."""
    rows = json_numbers(results, "reality", {"score": "$.score", "mock_data": "$.mockDataCount", "fake_endpoints": "$.fakeEndpointCount", "dummy_auth": "$.dummyAuthCount"})
    return rows.filter("score IS NOT NULL").orderBy("score", "id").limit(limit).select("id", "scan_id", "score", "mock_data", "fake_endpoints", "dummy_auth")


def json_fusion(results: DataFrame, limit: int = 20) -> DataFrame:
    """The newest fused results: confidence, belief, plausibility, conflict and verdict from a nested object."""
    newest = results.filter(F.col("engine_name") == "fusion").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    at = lambda name, kind="double": F.expr(f"try_variant_get(parse_json(result), '$.aggregate.{name}', '{kind}')")
    return newest.select("id", "scan_id", at("overallConfidence").alias("confidence"), at("overallBelief").alias("belief"), at("overallPlausibility").alias("plausibility"), at("overallConflict").alias("conflict"), at("verdict", "string").alias("verdict"))
