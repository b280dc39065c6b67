"""Projections and filters over scans and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklake.functions.scalars import file_hint, half_up, is_completed

#: Claims that contradict the secret scanner; fixed.
NO_SECRETS = r"\bno\s+(secrets?|credentials?|api[_\s-]?keys?|passwords?|tokens?)\b"
SAFE_PHRASES = ("secrets are safe", "credentials are safe", "no hardcoded secrets", "no exposure of secrets", "no credentials exposed")
SAFE_TITLE = "environment variables correctly used"

#: Credential findings by title; fixed.
CREDENTIAL = r"\b(api[_\s-]?key|secret|password|credential|token|access[_\s-]?key|private[_\s-]?key|connection[_\s-]?string|service[_\s-]?account)\b"
DETECTED = r"\b(detected|exposed|found|leaked|hardcoded|hard-coded|committed|embedded|visible|plain.?text|in\s+(code|source|env|client|bundle|repo))\b"
SERVICE = r"\b(supabase|firebase|postgres|mysql|mongo|redis|stripe|razorpay|openai|twilio|sendgrid|aws|gcp|azure)\s+(password|key|url|credential|secret|token)\b"
SECRET_SCANNERS = ("Secret Scanner V2", "Secret Scanner", "Secrets Scanner", "Secret & Credential Scanner")

CATEGORY_AGENT = {
    "secrets": "IDOR & Access Control Agent",
    "auth": "Auth & Session Agent",
    "injection": "Input & Validation Agent",
    "config": "Reliability & Observability Agent",
    "exposure": "Cleanup & Architecture Agent",
    "quality": "AI Smell Agent",
}
OTHER_AGENT = "Cleanup & Architecture Agent"

FULL_TITLE = 3
PROMPT_ONLY = 5


def completed(scans: DataFrame) -> DataFrame:
    return scans.filter(is_completed(F.col("status"), F.col("score")))


def gallery(scans: DataFrame, framework: str | None = None, tool: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of completed scans, newest first, with the total number of matches."""
    found = completed(scans)
    if framework is not None:
        found = found.filter(F.col("framework") == framework)
    if tool is not None:
        found = found.filter(F.col("vibe_tool") == tool)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(min(limit, 50))
    return page.select("id", "score", "framework", "vibe_tool", "created_at").crossJoin(F.broadcast(total))


def certificate(scans: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """The completed scan with this certificate, or else with this number as id; with its critical and total issues."""
    hits = completed(scans).withColumn("_by", F.when(F.col("cert_id") == key, 0).when(F.col("id").cast("string") == key, 1)).filter(F.col("_by").isNotNull())
    best = hits.orderBy("_by", F.col("created_at").desc(), "id").limit(1)
    four = ("critical", "high", "medium", "low")
    joined = best.join(counts.withColumnRenamed("scan_id", "id"), "id", "left").na.fill(0, list(four))
    return joined.select("id", "cert_id", "score", F.col("critical").alias("critical_issues"), sum((F.col(c) for c in four[1:]), F.col("critical")).alias("total_issues"))


def badge(scans: DataFrame, counts: DataFrame) -> DataFrame:
    joined = completed(scans).join(counts.withColumnRenamed("scan_id", "id"), "id", "left")
    score = F.coalesce("score", F.lit(0))
    valid = (score >= 70) & (F.coalesce("critical", F.lit(0)) == 0)
    return joined.select(
        "id",
        valid.alias("valid"),
        F.when(valid, "certified").otherwise("not certified").alias("label"),
        F.when(score >= 70, "green").when(score >= 40, "yellow").otherwise("red").alias("colour"),
    )


def pr_status(scans: DataFrame, number: int) -> DataFrame:
    """The newest scan of a pull request and whether it blocks the merge."""
    newest = scans.filter(F.col("description").like(f"%PR #{number} %")).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)
    verdict = F.col("launch_verdict")
    message = F.when(verdict == "do-not-launch", "blocked").when(verdict == "caution", "review").when(verdict == "ready", "ready").otherwise("pending")
    return newest.select("id", "score", "launch_verdict", F.coalesce(verdict == "do-not-launch", F.lit(False)).alias("blocked"), message.alias("message"))


def newest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def ci_gate(scans: DataFrame, threshold: int = 70) -> DataFrame:
    newest = newest_per(scans, ["user_id", "source_input"], F.col("created_at").desc(), F.col("id").desc())
    ok = (F.coalesce("score", F.lit(0)) >= threshold) & F.coalesce(F.col("launch_verdict") != "do-not-launch", F.lit(True))
    return newest.select("user_id", "source_input", "id", "score", ok.alias("pass"))


def drop_contradictions(issues: DataFrame) -> DataFrame:
    title, about = F.lower("title"), F.lower(F.coalesce("description", F.lit("")))
    claims = title.rlike(NO_SECRETS) | about.rlike(NO_SECRETS) | title.contains(SAFE_TITLE)
    for phrase in SAFE_PHRASES:
        claims |= title.contains(phrase) | about.contains(phrase)
    return issues.filter(~claims)


def is_credential_finding(title: Column) -> Column:
    t = F.lower(title)
    return (t.rlike(CREDENTIAL) & t.rlike(DETECTED)) | t.rlike(SERVICE)


def secret_ownership(issues: DataFrame, title: str = "title") -> DataFrame:
    """Credential findings count only if a secret scanner made them."""
    return issues.filter(F.col("agent_name").isin(*SECRET_SCANNERS) | ~F.coalesce(is_credential_finding(F.col(title)), F.lit(False)))


def _any(text: Column, *parts: str) -> Column:
    met = text.contains(parts[0])
    for part in parts[1:]:
        met |= text.contains(part)
    return met


def consensus(issues: DataFrame) -> DataFrame:
    """Security, compliance and revenue votes in percent; passed if their mean is 0.6 or more."""
    kind, about, title, sev = (F.lower(F.coalesce(c, F.lit(""))) for c in ("category", "description", "title", "severity"))
    exposed = _any(kind, "injection", "auth", "xss", "sqli")
    security = (
        F.when(exposed, 0.92 + F.when(_any(about, "user", "input", "req."), 0.05).otherwise(0.0)).when(_any(kind, "secret", "exposure"), 0.95).when(_any(kind, "config"), 0.65).otherwise(0.5)
    ) - F.when(_any(about, "prisma", "parameterized", "zod"), 0.15).otherwise(0.0)
    compliance = F.when(_any(about, "gdpr", "pci", "hipaa", "pii"), 0.88).when(_any(about, "data", "privacy", "consent"), 0.75).when(_any(about, "log", "audit"), 0.70).otherwise(0.5)
    revenue = F.when(_any(title, "payment", "checkout", "revenue", "stripe"), 0.95).when(_any(title, "signup", "onboard", "auth"), 0.80).when(sev == "critical", 0.75).otherwise(0.5)
    votes = issues.withColumn("_s", security).withColumn("_c", compliance).withColumn("_r", revenue)
    mean = (F.col("_s") + F.col("_c") + F.col("_r")) / 3
    percent = lambda c: half_up(F.round(F.col(c) * 100, 6)).cast("int")
    return votes.select(*issues.columns, percent("_s").alias("security_score"), percent("_c").alias("compliance_score"), percent("_r").alias("revenue_score"), (F.round(mean, 9) >= 0.6).alias("passed"))


def price_orders(carts: DataFrame, coupons: DataFrame, as_of: str) -> DataFrame:
    """carts(id, base, code): the price after a valid coupon, in whole units."""
    valid = coupons.filter(F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(as_of).cast("timestamp"))))
    priced = carts.join(valid.select(F.col("code").alias("_code"), "discount"), F.upper(F.trim("code")) == F.col("_code"), "left")
    off = F.coalesce(F.col("discount").cast("double"), F.lit(0.0))
    return priced.select("id", "base", F.col("discount").isNotNull().alias("valid"), half_up(F.col("base") * (1 - off)).cast("long").alias("final"))


def stuck_runs(runs: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    seen = F.coalesce("worker_heartbeat_at", "created_at")
    return runs.filter((F.col("status") == "running") & (seen < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))).select("id", seen.alias("last_seen"))


def tier_mask(issues: DataFrame, scans: DataFrame, users: DataFrame, order: list[str]) -> DataFrame:
    """Issues as a free plan sees them: the first 3 whole, the next 2 with the prompt, the others cut; other plans see all."""
    plans = scans.select(F.col("id").alias("scan_id"), "user_id").join(users.select(F.col("id").alias("user_id"), "plan"), "user_id").select("scan_id", "plan")
    w = Window.partitionBy("scan_id")
    seen = issues.join(plans, "scan_id").withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("n_issues", F.count("*").over(w))
    free = F.col("plan") == "free"
    locked = free & (F.col("place") > FULL_TITLE)
    about = F.col("description")
    cut = (
        F.when(~locked, about)
        .when(about.isNull(), "Upgrade to view full details")
        .when(F.col("place") <= PROMPT_ONLY, F.concat(F.substring(about, 1, 100), F.lit("… (upgrade for full details)")))
        .otherwise(F.concat(F.substring(about, 1, 80), F.lit("…")))
    )
    hint = file_hint(F.concat(F.col("file_path"), F.lit(":"), F.col("line_number").cast("string")))
    return seen.select(
        "scan_id",
        "place",
        "title",
        cut.alias("description"),
        F.when(locked, F.concat(F.lit("Found in: "), hint)).alias("evidence"),
        locked.alias("locked"),
        (~free | (F.col("place") <= PROMPT_ONLY)).alias("prompt_unlocked"),
        F.when(free, F.greatest(F.lit(0).cast("long"), F.col("n_issues") - PROMPT_ONLY)).otherwise(F.lit(0).cast("long")).alias("locked_issue_count"),
    )


def tier_mask_results(results: DataFrame, keep: dict[str, int]) -> DataFrame:
    """results(scan_id, engine_name, items array, plan): a free plan keeps the first items of each engine; with the number locked."""
    most = F.coalesce(F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])[F.col("engine_name")], F.lit(2**31 - 1))
    free = F.col("plan") == "free"
    return results.select(
        "scan_id",
        "engine_name",
        F.when(free, F.slice("items", F.lit(1), most)).otherwise(F.col("items")).alias("items"),
        F.when(free, F.greatest(F.size("items") - most, F.lit(0))).otherwise(F.lit(0)).alias("locked"),
    )


def category_agent(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in CATEGORY_AGENT.items() for x in pair])[category], F.lit(OTHER_AGENT))
