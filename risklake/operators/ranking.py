"""Top-k, deduplication and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risklake.functions.scalars import title_key


def next_run(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'queued'").orderBy(F.col("priority").desc(), "created_at", "id").limit(1).withColumn("status", F.lit("claimed"))


def recent_runs(runs: DataFrame, status: str | None = None, limit: int = 25) -> DataFrame:
    found = runs if status is None else runs.filter(F.col("status") == status)
    return found.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(min(limit, 100))


def top_by_count(findings: DataFrame, key: str, k: int = 5) -> DataFrame:
    return findings.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def top_cost(nodes: DataFrame, k: int = 20) -> DataFrame:
    return nodes.orderBy((F.col("cpu") + F.col("io")).desc(), "id").limit(k)


def top_coupled(degree: DataFrame, drift: float, k: int = 3) -> DataFrame:
    """degree(repo, id, degree): the most coupled nodes of each repository and their probability of breaking."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("degree").desc(), "id"))
    top = degree.filter("degree > 5").withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return top.select("repo", "id", "degree", F.round(F.least(F.lit(0.99), F.col("degree") * 0.05 * drift), 4).alias("probability"))


def relevant_files(files: DataFrame, keywords: DataFrame, k: int = 4) -> DataFrame:
    """files(path), keywords(agent, word): each agent's files with most keywords in the path. Paths are cut to words, so agents meet files by an equi-join."""
    words = files.select("path", F.explode(F.array_distinct(F.split(F.lower("path"), "[^a-z0-9]+"))).alias("word"))
    hits = words.join(F.broadcast(keywords), "word").groupBy("agent", "path").agg(F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("agent").orderBy(F.col("hits").desc(), "path"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def cap_per(df: DataFrame, keys: list[str], order: list, most: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def union_issues(first: DataFrame, *more: DataFrame) -> DataFrame:
    out = first
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def dedup_best(issues: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The most confident issue (75 if unknown; the first on ties) of each severity and title key. The aggregate combines before the shuffle."""
    keyed = issues.withColumn("_key", title_key(F.col("title")))
    best = F.min_by(F.struct(*issues.columns), F.struct(-F.coalesce("confidence", F.lit(75)), *order))
    return keyed.groupBy(*scope, F.col("severity").alias("_severity"), "_key").agg(best.alias("x")).select("x.*")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by order of each key."""
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("x")).select("x.*")


def dedup_critical(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last critical row of each key, or else the first row."""
    row, place = F.struct(*df.columns), F.struct(*order)
    critical = F.max_by(F.when(F.col("severity") == "critical", row), F.when(F.col("severity") == "critical", place))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.coalesce(critical, F.min_by(row, place)).alias("x")).select("x.*")


def persistent(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return current.select(*keys).intersect(previous.select(*keys))


def new_keys(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return current.select(*keys).distinct().join(previous.select(*keys), keys, "left_anti")
