"""Further scores, classifications and joins over findings, code and graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.functions.scalars import bom_ref, clamp, cyclomatic, half_up, normalize_path, purl, route_regex
from risklake.operators.aggregates import route_impact
from risklake.operators.graph import SMALL, by_size, each_graph
from risklake.sources.lineage import stored

#: Ordered keyword rules: OWASP id, keywords, base score; fixed. The first that hits counts.
OWASP = (
    ("A03:2021", "injection|sql|xss|eval", 9.0),
    ("A07:2021", "auth|session|password|login", 8.0),
    ("A01:2021", "idor|access control|privilege", 8.5),
    ("A02:2021", "secret|key|token|crypto", 7.5),
    ("A09:2021", "log|audit|monitor", 5.0),
)
#: Ordered data classes and what shows them; fixed.
DATA_CLASSES = (
    ("pci", "card|cvv|iban|payment"),
    ("phi", "patient|diagnosis|medical"),
    ("credentials", "password|secret|token|api[_-]?key"),
    ("pii", "email|phone|address|user"),
    ("session", "session|cookie"),
    ("consent", "consent|gdpr|privacy"),
)


def first_rule(text: Column, rules: tuple) -> Column:
    """The first rule (name, pattern, ...) whose pattern hits."""
    return F.coalesce(*[F.when(F.lower(text).rlike(r[1]), F.lit(r[0])) for r in rules])


def owasp(issues: DataFrame) -> DataFrame:
    """First OWASP class by title and description, with its base score."""
    base = F.create_map(*[F.lit(x) for r in OWASP for x in (r[0], r[2])])
    found = first_rule(F.concat_ws(" ", "title", "description"), OWASP)
    return issues.withColumn("owasp", found).withColumn("base_score", base[F.col("owasp")])


def data_class(text: Column) -> Column:
    return first_rule(text, DATA_CLASSES)


#: Packages and their framework, the first one present decides.
FRAMEWORKS = (
    ("next", "nextjs"),
    ("remix", "remix"),
    ("@remix-run/react", "remix"),
    ("nuxt", "nuxt"),
    ("nuxt3", "nuxt"),
    ("@sveltejs/kit", "sveltekit"),
    ("svelte", "svelte"),
    ("@angular/core", "angular"),
    ("vue", "vue"),
    ("gatsby", "gatsby"),
    ("astro", "astro"),
    ("express", "node-api"),
    ("fastify", "node-api"),
    ("koa", "node-api"),
    ("hono", "node-api"),
    ("react", "react"),
)
#: Builder tools in the order in which they decide, the mark in the paths, and whether the package's name counts too.
TOOLS = (("cursor", "cursor", False), ("lovable", "lovable", True), ("bolt", "bolt", True), ("v0", "v0", False), ("windsurf", "windsurf", False), ("replit", "replit", False), ("aider", ".aider", False))
#: Kinds of business and the words that tell them, the first hit decides.
BUSINESS = (
    ("ecommerce", "shop|cart|checkout|product|inventory|order|stripe|payment"),
    ("analytics", "dashboard|analytics|metric|chart|report|kpi"),
    ("content", "blog|article|post|cms|content|markdown"),
    ("saas", "auth|login|register|user|account|profile|session"),
    ("api", "api|endpoint|route|rest|graphql"),
    ("landing", "landing|hero|cta|marketing|pricing"),
)


def detect_framework(manifest: Column) -> Column:
    """Framework by the packages of a manifest (a map)."""
    return F.coalesce(*[F.when(F.map_contains_key(manifest, F.lit(p)), F.lit(f)) for p, f in FRAMEWORKS], F.lit("unknown"))


def detect_tool(name: Column, paths: Column) -> Column:
    """Builder tool by the package's name and the paths, as one text; nulls read as empty."""
    name, paths = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, paths))
    said = lambda mark, named: paths.contains(mark) | name.contains(mark) if named else paths.contains(mark)
    return F.coalesce(*[F.when(said(mark, named), F.lit(tool)) for tool, mark, named in TOOLS], F.lit("unknown"))


def detect_business(paths: Column, content: Column) -> Column:
    """Kind of business by the words in the paths and the content; nulls read as empty."""
    return F.coalesce(first_rule(F.concat_ws(" ", paths, content), BUSINESS), F.lit("unknown"))


def side(files: DataFrame) -> DataFrame:
    """Backend or frontend by signals in the content, the extension and the path; ties are backend."""
    signal = lambda patterns: sum((F.col("content").rlike(p).cast("int") for p in patterns), F.lit(0))
    back = signal((r"router\.", r"app\.listen", r"\brequire\(", r"process\.env")) + F.when(F.col("path").rlike("/(api|server|routes)/"), 2).otherwise(0)
    front = signal((r"useState", r"document\.", r"fetch\(", r"<html", r"className=")) + F.when(F.col("path").rlike(r"\.(tsx|jsx|html)$"), 3).otherwise(0) + F.when(F.col("path").rlike("/(components|pages|web)/|^web/"), 2).otherwise(0)
    return files.select("file_id", back.alias("backend"), front.alias("frontend"), F.when(back >= front, "backend").otherwise("frontend").alias("side"))


def file_triage(files: DataFrame) -> DataFrame:
    """files(id, reasons array, alive): what to do with a file."""
    has = lambda word: F.exists("reasons", lambda r: r.contains(word))
    return files.select("id", F.when(has("mock"), "mock").when(has("doc") & ~F.col("alive"), "orphan-doc").when(has("duplicate"), "duplicate").when(F.col("alive"), "keep").otherwise("review").alias("triage"))


def line_diff(pairs: DataFrame) -> DataFrame:
    """pairs(id, before, after): lines by position, removed and added."""
    rows = F.zip_with(F.split("before", "\n"), F.split("after", "\n"), lambda a, b: F.when(~a.eqNullSafe(b), F.concat_ws("\n", F.concat(F.lit("-"), a), F.concat(F.lit("+"), b))))
    return pairs.select("id", F.array_join(F.array_compact(rows), "\n").alias("diff"))


def rewrite(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows(id, lang, line): the first rule (language, pattern, replacement) that matches is applied; null where none does."""
    tries = [F.when((F.col("lang") == lang) & F.col("line").rlike(p), F.regexp_replace("line", p, to)) for lang, p, to in rules]
    return rows.select("id", F.coalesce(*tries).alias("patched"))


def json_counts(rows: DataFrame, group: str, key: str) -> DataFrame:
    counted = rows.groupBy(group, key).agg(F.count("*").alias("n"))
    return counted.groupBy(group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))).alias("counts"))


def cognitive(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Branches weighted by their nesting, from the running balance of braces before each line."""
    branch = F.regexp_count("line", F.lit(r"\b(?:if|for|while|catch|switch)\b"))
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.greatest(F.coalesce(F.sum(F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))).over(before), F.lit(0)), F.lit(0))
    return lines.withColumn("_score", branch * (1 + depth)).groupBy(*keys).agg(F.sum("_score").alias("cognitive"))


def node_complexity(files: DataFrame, lines: DataFrame, imports: DataFrame, keys: list[str]) -> DataFrame:
    """files(keys, content), their lines and imports(keys, target): .4 of branches, .4 of nested branches, .2 of what is imported, times 5, at most 100."""
    measured = files.select(*keys, cyclomatic(F.col("content")).alias("cyclomatic")).join(cognitive(lines, keys), keys, "left")
    measured = measured.join(imports.groupBy(*keys).agg(F.count_distinct("target").alias("dependencies")), keys, "left").na.fill(0)
    total = 0.4 * F.col("cyclomatic") + 0.4 * F.col("cognitive") + 0.2 * F.col("dependencies")
    return measured.withColumn("score", F.least(F.lit(100), half_up(F.round(total * 5, 6))).cast("long"))


def sbom(deps: DataFrame, licenses: DataFrame) -> DataFrame:
    """Component rows with package URL, reference and license."""
    joined = deps.join(licenses, deps["name"] == licenses["package"], "left")
    return joined.select("repo_id", "seq", purl(F.col("name"), F.col("version_spec")).alias("purl"), bom_ref(F.col("name"), F.col("version_spec")).alias("bom_ref"), F.coalesce("license", F.lit("NOASSERTION")).alias("license"))



def traffic_light(scans: DataFrame, counts: DataFrame) -> DataFrame:
    joined = scans.join(counts, scans["id"] == counts["scan_id"], "left").na.fill(0, ["critical", "high"])
    blockers = F.array_compact(F.array(F.when(F.col("critical") > 0, "critical issues"), F.when(F.coalesce("score", F.lit(0)) < 40, "low score")))
    light = F.when(F.size(blockers) > 0, "red").when((F.col("high") > 2) | (F.coalesce("score", F.lit(0)) < 70), "yellow").otherwise("green")
    return joined.select("id", light.alias("light"), F.array_join(blockers, ", ").alias("blockers"))



def weighted_mix(rows: DataFrame, weights: dict[str, float]) -> Column:
    return half_up(F.round(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), 6))


def boundary_match(calls: DataFrame, routes: DataFrame, least: int = 30) -> DataFrame:
    """calls(call_id, repo_id, method, path), routes(route_id, repo_id, method, path): the best route of each call, the first on ties.

    A match has as many segments as the route (exact, template or by ratio) or shares a segment with it, so candidates come from two
    equi-joins, not from all pairs."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: p != "")
    a = calls.select("call_id", "repo_id", F.col("method").alias("_m"), normalize_path(F.col("path")).alias("_p")).withColumn("_a", parts(F.col("_p")))
    b = routes.select("route_id", "repo_id", F.col("method").alias("_rm"), normalize_path(F.col("path")).alias("_rp")).withColumn("_b", parts(F.col("_rp")))
    fixed = F.filter("_b", lambda p: ~p.startswith(":"))
    same_size = a.withColumn("_n", F.size("_a")).join(b.withColumn("_n", F.size("_b")), ["repo_id", "_n"])
    by_part = a.withColumn("_n", F.explode(F.array_distinct("_a"))).join(b.withColumn("_n", F.explode(F.array_distinct(fixed))), ["repo_id", "_n"])
    pairs = same_size.drop("_n").unionByName(by_part.drop("_n")).dropDuplicates(["call_id", "route_id"])
    method = F.col("_m") == F.col("_rm")
    hits = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.when(x == y, 1.0).when(y.startswith(":"), 0.5).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
    ratio = F.when(F.size("_a") == F.size("_b"), hits / F.size("_a")).otherwise(0.0)
    shared = F.size(F.array_intersect(fixed, F.col("_a")))
    score = (
        F.when(F.col("_p") == F.col("_rp"), F.when(method, 100).otherwise(80))
        .when(F.regexp_like("_p", route_regex(F.col("_rp"))), F.when(method, 90).otherwise(70))
        .when((ratio > 0.6) & method, half_up(F.round(ratio * 80, 6)))
        .when((F.size(fixed) > 0) & (shared >= F.least(F.lit(2), F.size(fixed))) & method, 50)
        .otherwise(0)
    )
    best = pairs.withColumn("score", score.cast("int")).filter(F.col("score") >= least)
    return best.groupBy("call_id").agg(F.min_by(F.struct("route_id", "score"), F.struct(-F.col("score"), "route_id")).alias("x")).select("call_id", "x.*")


#: Phrases of boilerplate; fixed.
BOILERPLATE = ("const handle = async", "if (!res.ok) throw", "export default function Page", "className=\"flex flex-col", "try { await db", "return NextResponse.json", "const [isLoading, setIsLoading]")


def topology(degrees: DataFrame) -> DataFrame:
    """degrees(out_degree) -> topology: 16 hex digits over how many nodes have each number of dependencies, so that neither order nor ids count
    and what is gathered is a row per distinct number."""
    counted = degrees.groupBy("out_degree").agg(F.count("*").alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("out_degree", "n"))), lambda x: F.concat_ws(":", x["out_degree"].cast("string"), x["n"].cast("string"))), "|")
    return counted.agg(F.substring(F.sha2(F.coalesce(said, F.lit("")), 256), 1, 16).alias("topology"))


def genome(files: DataFrame, edges_entropy: DataFrame, shape: DataFrame, phrases: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """Per repository: mean complexity, the share of boilerplate (phrases for every 50 characters, times 10), the mutation rate of both and the graph's
    entropy, decay class and days left. entropy and shape are of one row."""
    cc = F.regexp_count("content", F.lit(r"if|for|while|switch|catch|&&|\|\||\?")) + 1
    length = F.length("content")
    hits = sum(((length - F.length(F.replace("content", F.lit(p), F.lit("")))) / len(p) for p in phrases), F.lit(0.0))
    per = files.groupBy("repo_id").agg(F.avg(cc).alias("_mean"), F.sum(hits).alias("_hits"), F.sum(length).alias("_chars"))
    share = F.when(F.col("_chars") > 0, F.least(F.lit(1.0), 500 * F.col("_hits") / F.col("_chars"))).otherwise(0.0)
    rate = F.round(F.least(F.lit(1.0), F.col("_mean") / 15) * 0.35 + F.col("entropy") * 0.45 + share * 0.2, 9)
    out = per.crossJoin(F.broadcast(edges_entropy.select("entropy"))).crossJoin(F.broadcast(shape)).withColumn("_share", share).withColumn("_rate", rate)
    left = F.when(F.col("_rate") > 0.75, F.greatest(F.lit(7), F.floor(30 * (1 - F.col("_rate"))))).when(F.col("_rate") > 0.45, F.greatest(F.lit(30), F.floor(180 * (1 - F.col("_rate"))))).otherwise(365)
    decay = F.when(F.col("_rate") > 0.75, "critical_decay").when(F.col("_rate") > 0.45, "degrading").otherwise("stable")
    return out.select("repo_id", half_up(F.round("_mean", 9), 2).alias("mean_complexity"), half_up(F.round("_share", 9), 4).alias("boilerplate"), half_up(F.col("_rate"), 4).alias("mutation"), decay.alias("decay"), left.cast("long").alias("days_left"), "topology")


def pair_features(nodes: DataFrame, edges: DataFrame, most: int = 128) -> DataFrame:
    """nodes(repo, id, type, line, bundle, complexity), edges(src, dst): eight features of every ordered pair of a repository's first nodes, each from
    0 to 1, and by repository their mean, maximum, share of near zeros and mean product of two features. The bound on nodes is the operator's."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("id"))
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    top = nodes.withColumn("_k", rank).filter(F.col("_k") <= most).drop("_k").join(ends, "id", "left").na.fill(0, ["degree"])
    whole = Window.partitionBy("repo")
    top = top.select("*", *[F.greatest(F.max(c).over(whole), F.lit(1)).alias(f"most_{c}") for c in ("degree", "line", "complexity")])
    other = top.select("repo", *[F.col(c).alias(f"{c}2") for c in ("id", "type", "degree", "line", "bundle", "complexity")])
    low, high = F.least("id", "id2"), F.greatest("id", "id2")
    linked = edges.select(F.least("src", "dst").alias("_low"), F.greatest("src", "dst").alias("_high")).distinct().withColumn("_edge", F.lit(1.0))
    pairs = top.join(other, "repo").withColumn("_low", low).withColumn("_high", high).join(linked, ["_low", "_high"], "left").withColumn("edge", F.coalesce("_edge", F.lit(0.0)))
    gap = lambda c: F.abs(F.col(c) - F.col(f"{c}2"))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    features = [
        yes(F.col("type") == F.col("type2")),
        1 - F.least(F.lit(1.0), gap("line") / 1000),
        F.col("edge"),
        yes((F.col("edge") == 1) & (F.col("degree") > 2) & (F.col("degree2") > 2)),
        1 - gap("degree") / F.col("most_degree"),
        1 - gap("line") / F.col("most_line"),
        1 - gap("bundle") / F.greatest(F.col("bundle") + F.col("bundle2"), F.lit(1)),
        1 - gap("complexity") / F.col("most_complexity"),
    ]
    made = pairs.select("repo", *[f.alias(f"f{k}") for k, f in enumerate(features)])
    f = [F.col(f"f{k}") for k in range(len(features))]
    both = [(a, b) for k, a in enumerate(f) for b in f[k + 1 :]]
    n = F.count("*")
    sums = made.groupBy("repo").agg(
        n.alias("pairs"),
        (F.sum(reduce(lambda a, b: a + b, f)) / (n * len(f))).alias("_mean"),
        F.max(F.greatest(*f)).alias("_max"),
        (F.sum(reduce(lambda a, b: a + b, [F.when(x < 0.01, 1).otherwise(0) for x in f])) / (n * len(f))).alias("_sparse"),
        (F.sum(reduce(lambda a, b: a + b, [a * b for a, b in both])) / (n * len(both))).alias("_both"),
    )
    said = lambda c: half_up(F.round(c, 9), 4)
    return sums.select("repo", "pairs", said("_mean").alias("mean"), said("_max").alias("max"), said("_sparse").alias("sparsity"), said("_both").alias("co_activation"))


def ranked_pairs(scored: DataFrame, patterns: DataFrame) -> DataFrame:
    """scored(_key, match_score, ...), patterns(_key, pattern): every match, the highest score first. The score is that of the one side, so
    that side alone is sorted, in four times as many ranges as a shuffle has, and its rows are matched as they come; patterns, a few bytes
    each, are broadcast. The optimizer drops sorts below a join, so the rows pass a step between that keeps their order."""
    n = 4 * int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.repartitionByRange(n, F.desc("match_score"), "id").sortWithinPartitions(F.desc("match_score"), "id")
    return ranged.mapInArrow(lambda batches: batches, ranged.schema).join(F.broadcast(patterns), "_key")


#: Sums of pair_features() by repository, before they are rounded.
PAIR_SUMS = ("mean", "max", "sparsity", "co_activation")


def _pair_sums(most: int) -> Callable[..., list[np.ndarray]]:
    def work(own: np.ndarray, src: np.ndarray, dst: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = at[: len(src)], at[len(src) :]
        leads = np.zeros((len(ids), len(ids)), bool)
        leads[a[~own], b[~own]] = True
        first = np.flatnonzero(own)
        first = first[np.argsort(src[first], kind="stable")][:most]
        if not len(first):
            return [np.zeros(0, np.int64), *[np.zeros(0)] * len(PAIR_SUMS)]
        degree = (leads.sum(0) + leads.sum(1) - leads.diagonal())[a[first]]
        kind, line, bundle, complexity = (v[first] for v in values)
        edge = (leads | leads.T)[np.ix_(a[first], a[first])]
        gap = lambda x: np.abs(x[:, None] - x)
        big = degree > 2
        f = [
            (kind[:, None] == kind).astype(float),
            1 - np.minimum(1.0, gap(line) / 1000),
            edge.astype(float),
            (edge & big[:, None] & big).astype(float),
            1 - gap(degree) / max(degree.max(), 1),
            1 - gap(line) / max(line.max(), 1),
            1 - gap(bundle) / np.maximum(bundle[:, None] + bundle, 1),
            1 - gap(complexity) / max(complexity.max(), 1),
        ]
        n, m, f = len(first) ** 2, len(f), np.stack(f)
        # Products of two features: the square of their sum holds each twice, beside their own squares.
        twice = np.square(f.sum(0)).sum() - np.square(f).sum()
        sums = (f.sum() / (n * m), f.max(), (f < 0.01).sum() / (n * m), twice / (n * m * (m - 1)))
        return [np.array([n]), *[np.array([float(x)]) for x in sums]]

    return work


def pair_features_by_repo(nodes: DataFrame, edges: DataFrame, repo: Column, most: int = 128, rows: int = SMALL) -> DataFrame:
    """pair_features() of edges that stay within their repository; repo is over src, and nodes have numbers in all columns. A repository of up
    to `rows` nodes and edges is worked on in a task, and none of its pairs leave it."""
    values = ("type", "line", "bundle", "complexity")
    own = nodes.select(F.col("repo").alias("graph"), F.lit(True).alias("own"), F.col("id").alias("src"), F.col("id").alias("dst"), *[F.col(c).cast("long").alias(c) for c in values])
    links = edges.select(repo.alias("graph"), F.lit(False).alias("own"), "src", "dst", *[F.lit(0).cast("long").alias(c) for c in values])
    small, large = by_size(own.unionByName(links), rows)
    schema = T.StructType([small.schema["graph"], T.StructField("pairs", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in PAIR_SUMS]])
    made = each_graph(small, _pair_sums(most), schema).select(F.col("graph").alias("repo"), "pairs", *[half_up(F.round(c, 9), 4).alias(c) for c in PAIR_SUMS])
    if large is None:
        return made
    rest = large.filter("own").select(F.col("graph").alias("repo"), F.col("src").alias("id"), *values)
    return made.unionByName(pair_features(rest, large.filter("NOT own").select("src", "dst"), most))


def pattern_match(sigs: DataFrame, references: DataFrame) -> DataFrame:
    """sigs(id, signature, source, sink, sanitiser), references(pattern, vulnerable, clean or null: signatures; a constant list): per file and pattern the
    similarity to the vulnerable reference, what it is above that to the clean one, whether a source and a sink stand in the file, verdict and
    probability. An equal signature counts as the same shape."""
    near = lambda c: F.aggregate(F.zip_with("signature", c, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / F.size("signature")
    met = sigs.crossJoin(F.broadcast(references)).withColumn("_s", near("vulnerable")).withColumn("_d", F.col("_s") - F.when(F.col("clean").isNotNull(), near("clean")).otherwise(0.0))
    s, d, tainted, clean = F.col("_s"), F.col("_d"), F.col("source") & F.col("sink"), F.col("sanitiser")
    open_ = tainted & ~clean
    yes = lambda c, x: F.when(c, x).otherwise(0.0)
    d = F.when(F.col("clean").isNotNull(), d).otherwise(s)
    chance = clamp(yes(s == 1, 0.35) + 0.25 * s + yes(tainted, 0.2) + yes(open_, 0.1) + 0.1 * F.greatest(d, F.lit(0.0)) - yes(clean, 0.15), 0.0, 1.0)
    verdict = F.when((s == 1) & open_, "match").when((s > 0.5) & open_, "zero-day").when((d < -0.15) | (tainted & clean), "looks-clean").otherwise("insufficient-evidence")
    four = lambda c: half_up(F.round(c, 9), 4)
    return met.select("id", "pattern", four(s).alias("similarity"), four(d).alias("differential"), tainted.alias("tainted"), verdict.alias("verdict"), four(chance).alias("probability"))


FINDINGS = "rule string, category string, path string, line_no int, severity string"


class RuleRegistry:
    """Rules by id and category. A rule that fails, when it is built or while it runs, becomes one info finding and takes no other with it.

    A rule is a function of the lines' DataFrame, or of one Arrow batch of lines that says which of them are findings. Rules of the first kind
    are each written to the shared folder by a job of their own, so that an error in a task is that rule's; those of the second kind run in
    one pass over the lines, and an error is caught in the task and comes out as a row."""

    def __init__(self):
        self._rules: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}
        self._masks: dict[str, tuple[str, str, Callable[[pa.RecordBatch], pa.Array]]] = {}

    def register(self, rule_id: str, category: str, rule: Callable[[DataFrame], DataFrame]) -> None:
        """rule(lines) -> path, line_no, severity."""
        self._rules[rule_id] = (category, rule)

    def register_mask(self, rule_id: str, category: str, severity: str, rule: Callable[[pa.RecordBatch], pa.Array]) -> None:
        """rule(batch of path, line_no, line) -> a boolean for each line."""
        self._masks[rule_id] = (category, severity, rule)

    def run(self, lines: DataFrame, ids: list[str] | None = None, category: str | None = None) -> DataFrame:
        spark = lines.sparkSession
        asked = lambda rules: {k: r for k, r in rules.items() if (ids is None or k in ids) and (category is None or r[0] == category)}
        parts = []
        for rule_id, (kind, rule) in asked(self._rules).items():
            try:
                found = stored(rule(lines).select(F.lit(rule_id).alias("rule"), F.lit(kind).alias("category"), F.col("path").cast("string").alias("path"), F.col("line_no").cast("int").alias("line_no"), F.col("severity").cast("string").alias("severity")))
            except Exception:  # whatever it is that breaks one rule
                found = spark.createDataFrame([(rule_id, kind, None, None, "info")], FINDINGS)
            parts.append(found)
        if masks := asked(self._masks):
            cells = lines.select(F.col("path").cast("string").alias("path"), F.col("line_no").cast("int").alias("line_no"), "line")
            found = stored(cells.mapInArrow(_masked(masks), f"{FINDINGS}, failed boolean"))
            failed = found.filter("failed").select("rule", "category").distinct()
            parts.append(found.filter("NOT failed").join(failed.select("rule"), "rule", "left_anti").select("rule", "category", "path", "line_no", "severity"))
            parts.append(failed.select("rule", "category", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line_no"), F.lit("info").alias("severity")))
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FINDINGS)


def _masked(rules: dict[str, tuple[str, str, Callable[[pa.RecordBatch], pa.Array]]]):
    """Each rule over each batch; a rule that raises, or says something else than a boolean for each line, gives a row that says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rule_id, (category, severity, rule) in rules.items():
                try:
                    said = rule(batch)
                    mask = pc.fill_null((said if isinstance(said, pa.Array) else pa.array(said)).cast(pa.bool_()), False)
                    hits, failed = batch.filter(mask), False
                except Exception:
                    hits, failed = batch.slice(0, 1), True
                n = hits.num_rows
                made = [pa.array([rule_id] * n, pa.string()), pa.array([category] * n, pa.string()), hits.column("path"), hits.column("line_no"), pa.array([severity] * n, pa.string()), pa.array([failed] * n, pa.bool_())]
                yield pa.RecordBatch.from_arrays(made, names=["rule", "category", "path", "line_no", "severity", "failed"])

    return run


def group_entropy(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Shannon entropy of a column's values in each group: sums over counts."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counted.groupBy(group).agg(F.sum("n").alias("_t"), F.sum(F.col("n") * F.log2("n")).alias("_s")).select(group, half_up(F.round(F.log2("_t") - F.col("_s") / F.col("_t"), 9), 4).alias("entropy"))


def depth_node_ratio(pairs: DataFrame) -> DataFrame:
    """Smaller over larger depth and node count of each pair."""
    share = lambda a, b: half_up(F.round(F.least(a, b) / F.greatest(a, b), 9), 4)
    return pairs.select("id", "other", share("depth_a", "depth_b").alias("depth_ratio"), share("nodes_a", "nodes_b").alias("node_ratio"))


def reality_penalty(rows: DataFrame) -> DataFrame:
    lost = 8 * F.col("mockups") + 10 * F.col("missing") + 5 * F.col("partial") + 12 * F.col("broken") + F.least(1.5 * F.col("cleanup"), F.lit(15.0)) + 10 * F.col("blockers")
    return rows.select("repo", half_up(F.round(clamp(100 - lost, 0.0, 100.0), 6)).alias("score"))


def issue_routes(issues: DataFrame, routes: DataFrame) -> DataFrame:
    """routes(file_path, route, stage, weight): issues by the route of their file, stage and severity, how many of them are findings (a drop above 0 %
    and more than 100 of revenue), and the revenue that all of them put at risk."""
    met = route_impact(issues.select("file_path", "severity").join(routes, "file_path"))
    return met.groupBy("route", "stage", "severity").agg(F.count("*").alias("n"), F.count_if("finding").alias("findings"), F.sum("impact").alias("revenue_impact"))


def unused_components(files: DataFrame, imports: DataFrame, folder: str) -> DataFrame:
    """Files of a component folder whose base name no import of their repository mentions."""
    base = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    parts = files.filter(F.col("path").rlike(folder)).select("repo_id", "path", base(F.col("path")).alias("name"))
    return parts.join(imports.select("repo_id", base(F.col("target")).alias("name")).distinct(), ["repo_id", "name"], "left_anti").select("repo_id", "path")


def undocumented_env(files: DataFrame, documented: DataFrame) -> DataFrame:
    """Environment variables that the code reads and the example file does not list; 5 points each, 30 without any example."""
    used = files.select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(r"process\.env\.([A-Z_0-9]+)"), F.lit(1))).alias("name")).distinct()
    missing = used.join(documented, ["repo_id", "name"], "left_anti").groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("missing"), F.count("*").alias("n"))
    has = documented.select("repo_id", F.lit(1).alias("_has")).distinct()
    return missing.join(has, "repo_id", "left").select("repo_id", "missing", (F.col("n") * 5 + F.when(F.col("_has").isNull(), 30).otherwise(0)).alias("penalty"))


def missing_policy(files: DataFrame) -> DataFrame:
    """Tables created without a row policy, and the share that has one, per repository."""
    names = lambda pattern: files.select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("name")).distinct()
    made, held = names(r"create table (\w+)"), names(r"create policy \w+ on (\w+)").withColumn("_held", F.lit(1))
    joined = made.join(held, ["repo_id", "name"], "left")
    open_tables = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_held").isNull(), F.col("name")))), ",")
    return joined.groupBy("repo_id").agg(open_tables.alias("open_tables"), half_up(100 * F.count("_held") / F.count("*")).alias("coverage"))


def boundary_findings(matches: DataFrame) -> DataFrame:
    """matches(id, has_auth, validates, tainted, reaches_db, sanitized, exact, get, has_body, has_id): findings per matched pair and integrity."""
    kinds = F.array_compact(F.array(F.when(~F.col("has_auth"), "auth_gap"), F.when(~F.col("validates"), "missing_validation"), F.when(F.col("tainted") & F.col("reaches_db"), "tainted_flow")))
    return matches.select("id", F.array_join(kinds, ",").alias("findings"), F.greatest(F.lit(0), 100 - 8 * F.size(kinds)).alias("integrity"))


def boundary_taint(matches: DataFrame) -> DataFrame:
    hit = matches.filter(F.col("tainted") & F.col("reaches_db"))
    return hit.select("id", F.when(F.col("sanitized"), 65).when(F.col("exact"), 92).otherwise(78).alias("confidence"))


def type_mismatch(matches: DataFrame) -> DataFrame:
    kinds = F.array_compact(F.array(F.when(F.col("has_id") & ~F.col("has_auth"), "id without auth"), F.when(F.col("get") & F.col("has_body"), "body on GET"), F.when(F.col("reaches_db") & ~F.col("has_auth"), "db without auth")))
    return matches.select("id", F.explode(kinds).alias("mismatch"))



#: Ordered leak classes: name, keywords, least and largest impact; fixed.
LEAKS = (("payment", "payment|checkout|stripe", 50_000, 500_000), ("access", "auth|login|session", 20_000, 200_000), ("speed", "slow|performance|latency", 10_000, 80_000), ("trust", "privacy|gdpr|consent", 15_000, 150_000))


def revenue_leak(issues: DataFrame, small: Column) -> DataFrame:
    """First leak class by title and description, with its impact; a hundredth for small companies."""
    kind = first_rule(F.concat_ws(" ", "title", "description"), LEAKS)
    amount = lambda k: F.create_map(*[F.lit(x) for r in LEAKS for x in (r[0], r[k])])[F.col("leak")] / F.when(small, 100).otherwise(1)
    return issues.withColumn("leak", kind).withColumn("least", half_up(amount(2))).withColumn("most", half_up(amount(3)))


def compliance(paths: DataFrame, rules: DataFrame, controls: DataFrame, least: float = 0.4) -> DataFrame:
    """paths(id, repo, class, confidence), rules(rule, class, needs), controls(repo, control): a rule fires on a path of its class with
    enough confidence unless half of its controls stand in the repository."""
    held = controls.groupBy("repo").agg(F.collect_set("control").alias("_held"))
    joined = paths.filter(F.col("confidence") >= least).join(F.broadcast(rules), "class").join(held, "repo", "left")
    share = F.size(F.array_intersect("needs", F.coalesce("_held", F.array().cast("array<string>")))) / F.size("needs")
    return joined.filter(share < 0.5).select("id", "rule", half_up(F.round(share, 9), 4).alias("covered"))
