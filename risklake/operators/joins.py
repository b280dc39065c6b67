"""Joins over scans, issues, users and teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklake.functions.scalars import normalize_title, semver
from risklake.operators.predicates import completed, newest_per


def recent_scans(scans: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    """The newest scans with their users. The top is taken before the join, so the join has `limit` rows."""
    top = scans.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    named = users.select(F.col("id").alias("user_id"), "name", "plan")
    return top.join(named, "user_id", "left").select("id", "user_id", "name", "plan", "score", "created_at")


def user_teams(members: DataFrame, teams: DataFrame) -> DataFrame:
    return members.join(teams.select(F.col("id").alias("team_id"), F.col("name").alias("team")), "team_id").select("user_id", "team_id", "team", "role")


def team_roster(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users.select(F.col("id").alias("user_id"), "name", "plan"), "user_id").select("team_id", "user_id", "name", "plan", "role")


def scan_detail(scans: DataFrame, issues: DataFrame, order: list[str]) -> DataFrame:
    """Each completed scan with its issues in order and the scores of the same source so far."""
    own = issues.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(*order, "title", "severity"))).alias("issues"))
    past = completed(scans).filter(F.col("score").isNotNull())
    w = Window.partitionBy("user_id", "source_input").orderBy("id")
    history = past.withColumn("history", F.collect_list("score").over(w))
    joined = history.join(own, history["id"] == own["scan_id"], "left")
    return joined.select("id", "score", F.concat_ws("|", F.transform("issues", lambda i: i["title"])).alias("titles"), F.concat_ws(",", F.transform("history", lambda s: s.cast("string"))).alias("history"))


def conversation_context(conversations: DataFrame, issues: DataFrame, order: list[str], first: int = 5) -> DataFrame:
    """Each conversation (of the scan with its number) with its messages in order and the scan's first issues."""
    told = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("told"))
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(*order))
    top = issues.withColumn("_rank", rank).filter(F.col("_rank") <= first)
    top = top.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "title"))).alias("top"))
    joined = told.join(top, told["conv_id"] == top["scan_id"], "left")
    return joined.select("conv_id", F.concat_ws(",", F.transform("told", lambda m: m["role"])).alias("roles"), F.concat_ws("|", F.transform("top", lambda i: i["title"])).alias("issues"))


def fix_history(fixes: DataFrame, scans: DataFrame, limit: int = 100) -> DataFrame:
    """Each user's newest fixes."""
    owned = fixes.join(scans.select(F.col("id").alias("scan_id"), "user_id"), "scan_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("scan_id"), F.col("fix_id")))
    return owned.withColumn("rank", rank).filter(F.col("rank") <= limit).select("user_id", "scan_id", "fix_id", "status", "rank")


def batch_status(fixes: DataFrame) -> DataFrame:
    """Each scan's fixes by status and the newest one's status."""
    return fixes.groupBy("scan_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "applied").alias("applied"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max_by("status", F.struct("created_at", "fix_id")).alias("latest"),
    )


def advisories_from(rows: DataFrame) -> DataFrame:
    """rows(package, affected, fixed, cvss) with the range `< a`, `<= a` or `>= a < b` parsed to low, high and closed."""
    rng = F.col("affected")
    low = semver(F.regexp_extract(rng, r">=\s*([^\s<]+)", 1))
    upper = F.regexp_extract(rng, r"<=?\s*([^\s<>=]+)\s*$", 1)
    return rows.withColumn("low", F.when(rng.contains(">="), low)).withColumn("high", semver(upper)).withColumn("closed", rng.rlike(r"<=\s*[^\s]+$"))


def in_range(version: Column) -> Column:
    """Arrays of numbers compare place by place; a version that is no version is in no range."""
    above = F.col("low").isNull() | (version >= F.col("low"))
    below = (version < F.col("high")) | (F.col("closed") & (version == F.col("high")))
    return F.coalesce(above & below, F.lit(False))


def cve_match(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies in an advisory's range: an equi-join on the package, the range a residual condition."""
    parsed = advisories_from(advisories).withColumn("_package", F.lower("package"))
    pinned = deps.filter(~F.col("version_spec").isin("latest", "*")).withColumn("_version", semver(F.col("version_spec")))
    joined = pinned.join(parsed, F.lower("name") == F.col("_package")).filter(in_range(F.col("_version")))
    return joined.select("repo_id", "name", "version_spec", "seq", "cve", "cvss", "fixed")


def cve_overlay(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies below the fixed version, with a severity by CVSS."""
    fixes = advisories.select(F.lower("package").alias("_package"), "cve", "cvss", F.col("fixed"), semver(F.col("fixed")).alias("_fixed"))
    joined = deps.join(fixes, F.lower("name") == F.col("_package")).filter(F.coalesce(semver(F.col("version_spec")) < F.col("_fixed"), F.lit(False)))
    severity = F.when(F.col("cvss") >= 9, "critical").when(F.col("cvss") >= 7, "high").otherwise("medium")
    return joined.select("repo_id", "name", "seq", "cve", severity.alias("severity"))


def license_findings(deps: DataFrame, licenses: DataFrame, restrictive: dict[str, str], copyleft: set[str]) -> DataFrame:
    """Dependencies whose license is restrictive (with its severity) or copyleft (medium)."""
    named = deps.join(licenses, deps["name"] == licenses["package"]).select("repo_id", "name", "seq", "license")
    by_list = F.create_map(*[F.lit(x) for pair in restrictive.items() for x in pair])[F.col("license")]
    severity = F.coalesce(by_list, F.when(F.col("license").isin(*sorted(copyleft)), "medium"))
    return named.withColumn("severity", severity).filter(F.col("severity").isNotNull())


def supply_chain(deps: DataFrame, hallucinated: DataFrame, typos: str) -> DataFrame:
    """Packages that do not exist, look like another's name, have no pinned version, or come from a URL."""
    keyed = deps.select("repo_id", "name", "version_spec", "seq")
    kinds = [
        keyed.join(hallucinated.select(F.col("package").alias("name")), "name", "left_semi").withColumn("kind", F.lit("hallucinated")),
        keyed.filter(F.col("name").rlike(typos)).withColumn("kind", F.lit("typosquat")),
        keyed.filter(F.col("version_spec").isin("*", "latest")).withColumn("kind", F.lit("unpinned")),
        keyed.filter(F.col("version_spec").rlike(r"^(git|http|https|github):")).withColumn("kind", F.lit("url")),
    ]
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out.select("repo_id", "name", "seq", "kind")


def _baseline(scans: DataFrame) -> DataFrame:
    """Each completed scan with the newest earlier completed scan (a smaller id) of the same user and source."""
    done = completed(scans).filter(F.col("status") == "completed")
    now = done.select(F.col("id").alias("scan_id"), "user_id", "source_input", F.col("score").alias("score"))
    then = done.select(F.col("id").alias("previous_id"), "user_id", "source_input", F.col("score").alias("previous_score"), F.col("created_at").alias("_at"))
    pairs = now.join(then, ["user_id", "source_input"], "left").filter(F.col("previous_id").isNull() | (F.col("previous_id") < F.col("scan_id")))
    best = newest_per(pairs, ["scan_id"], F.col("_at").desc(), F.col("previous_id").desc()).select("scan_id", "previous_id", "previous_score")
    return now.join(best, "scan_id", "left").select("scan_id", "score", "previous_id", "previous_score")


def regression_diff(scans: DataFrame, issues: DataFrame) -> DataFrame:
    """Each scan against its baseline, by normalised titles: new, fixed and unchanged issues, score change and summary."""
    base = _baseline(scans)
    keyed = issues.select("scan_id", normalize_title(F.col("title")).alias("_key"), "severity")
    titles = keyed.select(F.col("scan_id").alias("_scan"), "_key").distinct()
    current = base.join(keyed, "scan_id")
    held = titles.withColumn("_held", F.lit(True))
    now = current.join(held, (current["previous_id"] == held["_scan"]) & (current["_key"] == held["_key"]), "left")
    grave = F.col("severity").isin("critical", "high")
    fresh = F.col("_held").isNull()
    new = now.groupBy("scan_id").agg(F.count_if(fresh).alias("new_issues"), F.count_if(fresh & grave).alias("new_grave"), F.count_if(~fresh).alias("unchanged"))
    earlier = base.filter(F.col("previous_id").isNotNull()).join(keyed.withColumnRenamed("scan_id", "_old"), F.col("previous_id") == F.col("_old"))
    gone = earlier.join(held, (earlier["scan_id"] == held["_scan"]) & (earlier["_key"] == held["_key"]), "left_anti").groupBy("scan_id").agg(F.count("*").alias("fixed_issues"))
    out = base.join(new, "scan_id", "left").join(gone, "scan_id", "left").na.fill(0, ["new_issues", "new_grave", "unchanged", "fixed_issues"])
    has = F.col("previous_id").isNotNull()
    number = lambda c: F.when(has, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    out = out.select("scan_id", "previous_id", number("new_issues"), number("new_grave"), number("fixed_issues"), number("unchanged"), (F.col("score") - F.col("previous_score")).alias("score_delta"))
    summary = F.when(~has, "first").when(F.col("new_grave") > 0, "regressed").when(F.col("fixed_issues") > 0, "fixed").otherwise("same")
    return out.withColumn("summary", summary)


def rescan_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Issues by finding key (the last of equal keys stands for its side): unchanged if severity and confidence are, changed ones count as new."""
    key = F.concat_ws(":", "agent_name", "title", "file_path", F.col("line_number").cast("string"))

    def last(df: DataFrame, tag: str) -> DataFrame:
        keyed = df.withColumn("_key", key)
        return newest_per(keyed, ["scan_key", "_key"], F.col("seq").desc()).select("scan_key", "_key", F.struct("severity", "confidence").alias(tag))

    rows = current.withColumn("_key", key).select("scan_key", "_key", F.struct("severity", "confidence").alias("_is")).join(last(previous, "_was"), ["scan_key", "_key"], "left")
    same = F.coalesce(F.col("_is") == F.col("_was"), F.lit(False))
    new = rows.groupBy("scan_key").agg(F.count_if(~same).alias("new_issues"), F.count_if(same).alias("unchanged"), F.count_if(F.col("_is.severity") == "critical").alias("critical_now"))
    old = previous.withColumn("_key", key).join(last(current, "_is"), ["scan_key", "_key"], "left_anti").groupBy("scan_key").agg(F.count("*").alias("fixed_issues"))
    return new.join(old, "scan_key", "full_outer").na.fill(0)


def orphan_routes(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """routes(path) that no call(path) meets: equal, or one a prefix of the other. Equal paths go by an equi-join, and prefixes by
    joining every prefix of the longer path, so nothing is compared all to all."""
    prefixes = lambda df, name: df.select(F.col("path").alias(name), F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("_head"))
    calls = calls.select("path").distinct()
    longer_calls = prefixes(calls, "_call").select(F.col("_head")).distinct()
    missed = routes.join(longer_calls, routes["path"] == longer_calls["_head"], "left_anti")
    shorter = prefixes(missed, "_route").join(calls, F.col("_head") == calls["path"], "left_semi").select("_route").distinct()
    return missed.join(shorter, missed["path"] == shorter["_route"], "left_anti").withColumn("risk", F.when(F.col("path").rlike("(?i)(delete|remove|admin|drop|purge)"), "HIGH").otherwise("MEDIUM"))


#: Routes under these are internal and never orphans.
INTERNAL_ROUTES = ("/health", "/metrics", "/internal", "/admin", "/:id")
GRAM = 3


def _grams(path: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(path) - size + 1), lambda at: F.substring(path, at, size)))


def within(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """parts(path), wholes(path) -> part, whole: each whole that contains the part.

    Wholes are filed under their runs of GRAM characters, as many as they are long; a part is looked up by the one of its own that fewest wholes
    have, and what is found is compared. Parts shorter than that are looked up whole among runs of their length."""
    parts = parts.select(F.col("path").alias("part")).filter(F.length("part") > 0).distinct().withColumn("size", F.least(F.length("part"), F.lit(GRAM)))
    sizes = F.explode(F.filter(F.array(*[F.lit(n) for n in range(1, GRAM + 1)]), lambda n: n <= F.length("whole"))).alias("size")
    filed = wholes.select(F.col("path").alias("whole")).distinct().select("whole", sizes).join(F.broadcast(parts.select("size").distinct()), "size")
    filed = filed.select("size", "whole", F.explode(_grams(F.col("whole"), F.col("size"))).alias("gram"))
    rare = parts.select("part", "size", F.explode(_grams(F.col("part"), F.col("size"))).alias("gram")).join(filed.groupBy("size", "gram").agg(F.count("*").alias("n")), ["size", "gram"], "left")
    # A part with a gram that no whole has is in none.
    rare = rare.groupBy("part", "size").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0).cast("long")), "gram")).alias("gram"))
    return rare.join(filed, ["size", "gram"]).filter(F.col("whole").contains(F.col("part"))).select("part", "whole")


def orphan_routes_links(routes: DataFrame, links: DataFrame) -> DataFrame:
    """routes(path, ...) whose path no link(path) contains and that contains no link itself; internal routes and paths of one
    character are left out, empty and null paths meet nothing."""
    internal = F.lit(False)
    for prefix in INTERNAL_ROUTES:
        internal |= F.col("path").startswith(prefix)
    asked = routes.filter((F.length("path") > 1) & ~internal)
    paths = asked.select("path").distinct()
    met = within(paths, links).select(F.col("part").alias("path")).unionByName(within(links, paths).select(F.col("whole").alias("path")))
    return asked.join(met.distinct(), "path", "left_anti").select(*routes.columns)


def unused_deps(deps: DataFrame, imports: DataFrame, build_tools: str) -> DataFrame:
    used = imports.select("repo_id", F.col("package").alias("name")).distinct()
    return deps.filter(~F.col("name").startswith("@types/") & ~F.col("name").rlike(build_tools)).join(used, ["repo_id", "name"], "left_anti").select("repo_id", "name", "seq")


def taint_range(nodes: DataFrame, reach: int = 100) -> DataFrame:
    """nodes(file, line, kind): source and sink lines of a file at most `reach` apart, with no sanitizer between. Lines are binned by
    `reach`, so a file's sources meet only the sinks of two bins."""
    src = nodes.filter("kind = 'source'").select("file", F.col("line").alias("source_line"))
    sink = nodes.filter("kind = 'sink'").select("file", F.col("line").alias("sink_line")).withColumn("_bin", F.floor(F.col("sink_line") / reach))
    near = src.withColumn("_bin", F.explode(F.array(F.floor(F.col("source_line") / reach), F.floor(F.col("source_line") / reach) + 1)))
    pairs = near.join(sink, ["file", "_bin"]).filter((F.col("sink_line") >= F.col("source_line")) & (F.col("sink_line") - F.col("source_line") <= reach)).drop("_bin").distinct()
    clean = nodes.filter("kind = 'sanitizer'").select(F.col("file").alias("_file"), F.col("line").alias("_line"), F.floor(F.col("line") / reach).alias("_at"))
    binned = pairs.withColumn("_at", F.explode(F.sequence(F.floor(F.col("source_line") / reach), F.floor(F.col("sink_line") / reach))))
    washed = binned.join(clean, (binned["file"] == clean["_file"]) & (binned["_at"] == clean["_at"]) & (F.col("_line") > F.col("source_line")) & (F.col("_line") < F.col("sink_line")), "left_semi")
    return pairs.join(washed.select("file", "source_line", "sink_line").distinct(), ["file", "source_line", "sink_line"], "left_anti")
