"""Sinks and table migrations: idempotent upserts, reports, wide to long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklake.sources.lineage import cut


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows replace old ones of the same key; of equal new keys the last by id counts."""
    last = new.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*new.columns), F.col("id")).alias("x")).select("x.*")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def normalize_results(results: DataFrame) -> DataFrame:
    """Null results go; scalars become {"value": x}."""
    bare = F.trim("result")
    wrapped = F.when(bare.rlike(r"^[\[{]"), bare).otherwise(F.concat(F.lit('{"value":'), bare, F.lit("}")))
    return results.filter(F.col("result").isNotNull() & (bare != "null")).withColumn("result", wrapped)


def write_upsert(new: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Upsert into a Parquet table partitioned by `partition`: only the partitions that new rows touch are written again."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.partitionBy(partition).parquet(path)
        return
    touched = new.select(partition).distinct()
    merged = upsert(old.join(touched, partition, "left_semi").select(*new.columns), new, keys)
    cut(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def missing(col: Column) -> Column:
    """Null, empty or zero, as defaults treat it."""
    return col.isNull() | (col.cast("string") == "") | (col.cast("string") == "0") | (col.cast("string") == "0.0")


def proofs_with_defaults(proofs: DataFrame) -> DataFrame:
    filled = {"type": "unknown", "severity": "info", "title": "Untitled", "engine_name": "unknown"}
    out = proofs
    for name, value in filled.items():
        out = out.withColumn(name, F.when(missing(F.col(name)), F.lit(value)).otherwise(F.col(name)))
    return out.withColumn("confidence", F.when(~missing(F.col("confidence")), F.col("confidence")))


LEVEL = {"critical": "error", "high": "error", "medium": "warning"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """findings(repo, rule, severity, confidence, file, line, seq): a result per row with its rule's index by first appearance, level,
    precision and fingerprint. Rules are indexed over one row per rule and repository."""
    first = findings.groupBy("repo", "rule").agg(F.min("seq").alias("_first"))
    index = first.withColumn("rule_index", F.row_number().over(Window.partitionBy("repo").orderBy("_first")) - 1).drop("_first")
    level = F.coalesce(F.create_map(*[F.lit(x) for pair in LEVEL.items() for x in pair])[F.col("severity")], F.lit("note"))
    precision = F.when(F.col("confidence") >= 80, "high").when(F.col("confidence") >= 50, "medium").otherwise("low")
    joined = findings.join(index, ["repo", "rule"])
    return joined.select("repo", "seq", "rule", "rule_index", level.alias("level"), precision.alias("precision"), F.concat_ws(":", "file", F.col("line").cast("string"), "rule").alias("fingerprint"))


def to_sarif(findings: DataFrame) -> DataFrame:
    """One JSON document per repository."""
    results = sarif_results(findings)
    rules = results.groupBy("repo").agg(F.array_sort(F.collect_set(F.struct("rule_index", F.col("rule").alias("id")))).alias("rules"))
    rows = results.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", "fingerprint"))).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit("risklake").alias("name"), F.transform("rules", lambda r: F.struct(r["id"].alias("id"))).alias("rules")).alias("driver")).alias("tool"), F.col("results"))
    return rules.join(rows, "repo").select("repo", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def export_scan(scans: DataFrame, issues: DataFrame, results: DataFrame, proofs: DataFrame) -> DataFrame:
    """Each scan with its issues, its proofs and its newest result per engine as one JSON document. A scan's own rows make its document."""
    listed = lambda df, *c: df.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("k1", "k2", "k3", "title", "severity"))).alias(c[0]))
    own = listed(issues, "issues")
    shown = listed(proofs, "proofs").withColumn("proofs", F.transform("proofs", lambda x: F.struct(x["title"].alias("title"), x["severity"].alias("severity"))))
    newest = results.groupBy("scan_id", "engine_name").agg(F.max_by("result", "id").alias("result"))
    engines = newest.groupBy("scan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine_name", "result")))).alias("engines"))
    joined = scans.select(F.col("id").alias("scan_id"), "score", "status")
    for part in (own, shown, engines):
        joined = joined.join(part, "scan_id", "left")
    document = F.to_json(F.struct("scan_id", "score", "status", "issues", "proofs", "engines"))
    return joined.select("scan_id", document.alias("document"), F.coalesce(F.when(F.col("issues").isNotNull(), F.size("issues")), F.lit(0)).cast("long").alias("n_issues"), F.coalesce(F.array_join(F.map_keys("engines"), ","), F.lit("")).alias("engines"))


def metrics_text(events: DataFrame) -> DataFrame:
    """Exposition lines: requests by method and status, mean latency."""
    by = events.groupBy("method", "status_code").agg(F.count("*").alias("n"))
    lines = by.select(F.format_string('http_requests_total{method="%s",status="%d"} %d', "method", "status_code", "n").alias("line"))
    mean = events.agg(F.format_string("http_request_duration_ms_avg %.2f", F.round(F.avg("response_time_ms"), 4)).alias("line"))
    return lines.unionByName(mean)


def unpivot_results(wide: DataFrame, names: dict[str, str], existing: DataFrame) -> DataFrame:
    """wide(scan_id, columns...): one row per column with a value, named by `names`, if the key is not there yet."""
    long = wide.unpivot("scan_id", list(names), "column", "result").filter(F.col("result").isNotNull())
    engine = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("column")]
    return long.select("scan_id", engine.alias("engine_name"), "result").join(existing.select("scan_id", "engine_name"), ["scan_id", "engine_name"], "left_anti")


PROOF = "array<struct<type:string,title:string,severity:string,confidence:double>>"


def explode_proofs(wide: DataFrame, existing: DataFrame) -> DataFrame:
    """wide(scan_id, proof_evidence JSON): one row per proof with defaults, the first of equal keys, if the key is not there yet; bad JSON has none."""
    parsed = wide.select("scan_id", F.posexplode(F.from_json("proof_evidence", PROOF)).alias("pos", "p")).filter(F.col("p").isNotNull())
    rows = parsed.select("scan_id", "pos", F.coalesce("p.type", F.lit("shadow-api")).alias("type"), F.coalesce("p.title", F.lit("Proof Evidence")).alias("title"), F.coalesce("p.severity", F.lit("medium")).alias("severity"), F.coalesce("p.confidence", F.lit(1.0)).alias("confidence"))
    first = rows.groupBy("scan_id", "type", "title").agg(F.min_by(F.struct("severity", "confidence"), "pos").alias("x")).select("scan_id", "type", "title", "x.*")
    return first.join(existing.select("scan_id", "type", "title"), ["scan_id", "type", "title"], "left_anti")


def backfill_status(scans: DataFrame) -> DataFrame:
    return scans.withColumn("status", F.when(F.col("status").isNull() & F.col("score").isNotNull(), "completed").otherwise(F.col("status")))


def drop_wide(wide: DataFrame, columns: list[str], long: DataFrame) -> DataFrame:
    """wide without the migrated columns, once the long table holds as many values."""
    values = wide.agg(sum((F.count(c) for c in columns), F.lit(0)).alias("n")).first()["n"]
    held = long.count()
    if held < values:
        raise ValueError(f"{values} values, {held} migrated")
    return wide.drop(*columns)


def table_profile(spark: SparkSession, names: list[str]) -> DataFrame:
    """Columns per table or view of the catalogue, by name."""
    rows = [(name, len(spark.catalog.listColumns(name))) for name in sorted(names)]
    return spark.createDataFrame(rows, "table_name string, n_columns long")
