"""Source code as tables: files, lines, manifests, imports, routes and client calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.functions.scalars import normalize_route

#: Folders and file names that are not read; fixed.
SKIP_DIRS = r"/(node_modules|\.git|dist|build|\.next|coverage|vendor|__pycache__)/"
SKIP_FILES = r"(\.min\.(js|css)|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|\.(png|jpe?g|gif|ico|svg|woff2?|ttf|eot|pdf|zip|gz|mp[34]|exe|dll|so|class|jar))$"
MAX_BYTES = 200_000


def code_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Text files under a path: predicates on path and length come before contents are decoded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = found.filter((F.col("length") <= max_bytes) & ~F.col("path").rlike(SKIP_DIRS) & ~F.lower("path").rlike(SKIP_FILES))
    return kept.select("path", F.decode("content", "UTF-8").alias("content"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.col("length").alias("size"))


def code_lines(files: DataFrame, *keys: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(*keys, F.posexplode(F.split("content", "\n", -1)).alias("_pos", "line")).select(*keys, (F.col("_pos") + 1).alias("line_no"), "line")


def manifest_deps(files: DataFrame) -> DataFrame:
    """files(repo_id, content of a manifest): one row per package; a development dependency wins over one of the same name."""
    block = lambda name: F.coalesce(F.from_json(F.get_json_object("content", f"$.{name}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    parsed = files.select("repo_id", block("dependencies").alias("d"), block("devDependencies").alias("v"))
    plain = F.map_filter("d", lambda k, _: ~F.map_contains_key("v", k))
    rows = parsed.select("repo_id", F.explode(F.concat(F.transform(F.map_entries(plain), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version_spec"), F.lit(False).alias("is_dev"))), F.transform(F.map_entries("v"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version_spec"), F.lit(True).alias("is_dev"))))).alias("x"))
    return rows.select("repo_id", "x.*")


IMPORT = r"(?:from|require\(|import)\s*\(?\s*[\"']([^\"']+)[\"']"


def imports(files: DataFrame) -> DataFrame:
    """Import targets; package is the external package's name, null for relative targets."""
    rows = files.select("repo_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1)))).alias("target"))
    package = F.when(F.col("target").startswith("@"), F.substring_index("target", "/", 2)).otherwise(F.substring_index("target", "/", 1))
    return rows.withColumn("package", F.when(~F.col("target").rlike(r"^[./]"), package))


ROUTE = r"(?:router|app)\.(get|post|put|patch|delete)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"


def routes(files: DataFrame) -> DataFrame:
    """Distinct (method, path) of declared routes without templates and wildcards."""
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(ROUTE), F.lit(1)).alias("m"), F.regexp_extract_all("content", F.lit(ROUTE), F.lit(2)).alias("p"))
    rows = files.select("repo_id", F.explode(pairs).alias("x")).select("repo_id", F.upper("x.m").alias("method"), F.col("x.p").alias("path"))
    return rows.filter(~F.col("path").contains("${") & ~F.col("path").contains("*")).distinct()


CALL = r"(?:fetch|axios\.(?:get|post|put|delete))\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"


def client_calls(files: DataFrame) -> DataFrame:
    """Distinct URLs of client calls under /api/: templates become :id, queries go, and so does the host."""
    rows = files.select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(CALL), F.lit(1))).alias("url")).filter(F.col("url").contains("/api/"))
    bare = F.substring_index(F.regexp_replace("url", r"\$\{[^}]+\}", ":id"), "?", 1)
    return rows.select("repo_id", normalize_route(F.regexp_replace(bare, r"^[a-z]+://[^/]+", "")).alias("path")).distinct()

#: Suffixes under which a relative import is looked up, in order; fixed.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")


def module_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """found(repo_id, path, target) as from imports(): relative targets resolved to the first candidate that is a file."""
    relative = found.filter(F.col("target").startswith("."))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    joined = F.regexp_replace(F.concat(folder, F.regexp_replace("target", r"^\./", "")), r"[^/]+/\.\./", "")
    tries = relative.select("repo_id", F.col("path").alias("src"), joined.alias("base"), F.posexplode(F.array(*map(F.lit, SUFFIXES))).alias("order", "suffix"))
    known = files.select("repo_id", F.col("path").alias("dst")).distinct()
    # The files are as many as the imports: no side is small, though Spark takes made paths for it and would send them through the driver.
    hits = tries.withColumn("dst", F.concat("base", "suffix")).join(known.hint("merge"), ["repo_id", "dst"])
    return hits.groupBy("repo_id", "src", "base").agg(F.min_by("dst", "order").alias("dst")).select("repo_id", "src", "dst").distinct()


def graph_edges(files: DataFrame, edges: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """files(file, content), edges (label, kind, pattern): an edge from each file to each node that a pattern's group names in it."""
    found = [F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), lambda x: F.struct(F.concat(F.lit(f"{kind}:"), x).alias("dst"), F.lit(label).alias("label"))) for label, kind, p in edges]
    return files.select(F.col("file").alias("src"), F.explode(F.concat(*found)).alias("x")).select("src", "x.*").distinct()
