"""Queries over source code and text: extraction, rules, metrics, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.functions import scalars as fn
from risklake.operators import joins, rules, similarity, windows
from risklake.plans.book import Book
from risklake.plans.domain import Domain
from risklake.sources import code

BOOK = Book()
Q = BOOK.add

LINES = "lines AS (SELECT file_id, repo_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line FROM (SELECT file_id, repo_id, string_split(content, chr(10)) AS parts FROM d_files))"
CODE_LINES = "lines AS (SELECT repo_id, path, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line FROM (SELECT repo_id, path, string_split(content, chr(10)) AS parts FROM d_code))"


def _lines(d: Domain):
    return code.code_lines(d.files, "file_id", "repo_id")


def _code_lines(d: Domain):
    return code.code_lines(d.code, "repo_id", "path")


Q("src_code_lines", f"WITH {LINES} SELECT file_id, count(*) AS n, CAST(sum(line_no * length(line)) AS BIGINT) AS weight FROM lines GROUP BY file_id")(
    lambda d: _lines(d).groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.col("line_no") * F.length("line")).alias("weight"))
)
MANIFEST = """'{"dependencies":{"pkg' || s_suppkey % 5 || '":"^1.' || s_suppkey % 9 || '.0","shared":"1.0.0"},"devDependencies":{"shared":"2.' || s_suppkey % 3 || '.0","tool":"*"}}'"""


def _manifests(d: Domain):
    k = F.col("s_suppkey")
    text = F.concat(F.lit('{"dependencies":{"pkg'), (k % 5).cast("string"), F.lit('":"^1.'), (k % 9).cast("string"), F.lit('.0","shared":"1.0.0"},"devDependencies":{"shared":"2.'), (k % 3).cast("string"), F.lit('.0","tool":"*"}}'))
    return d.table("supplier").select(k.alias("repo_id"), text.alias("content"))


Q(
    "src_manifest_deps",
    """SELECT s_suppkey AS repo_id, 'pkg' || s_suppkey % 5 AS name, '^1.' || s_suppkey % 9 || '.0' AS version_spec, false AS is_dev FROM supplier
    UNION ALL SELECT s_suppkey, 'shared', '2.' || s_suppkey % 3 || '.0', true FROM supplier UNION ALL SELECT s_suppkey, 'tool', '*', true FROM supplier""",
)(lambda d: code.manifest_deps(_manifests(d)))
IMPORTS = """imports AS (SELECT DISTINCT repo_id, path, target, CASE WHEN NOT regexp_matches(target, '^[./]') THEN CASE WHEN target[1] = '@' THEN array_to_string(string_split(target, '/')[1:2], '/') ELSE string_split(target, '/')[1] END END AS package
  FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '(?:from|require\\(|import)\\s*\\(?\\s*["'']([^"'']+)["'']', 1)) AS target FROM d_code))"""
Q("src_imports", f"WITH {IMPORTS} SELECT * FROM imports")(lambda d: code.imports(d.code))
ROUTES = """routes AS (SELECT DISTINCT repo_id, 'GET' AS method, path FROM (SELECT repo_id, unnest(regexp_extract_all(content, 'router\\.get\\("([^"]+)"', 1)) AS path FROM d_code))"""
Q("src_routes", f"WITH {ROUTES} SELECT * FROM routes")(lambda d: code.routes(d.code))
CALLS = """calls AS (SELECT DISTINCT repo_id, lower(regexp_replace(regexp_replace(string_split(url, '?')[1], '^[a-z]+://[^/]+', ''), '/[0-9]+', '/:id', 'g')) AS path FROM (SELECT repo_id, unnest(regexp_extract_all(content, 'fetch\\("([^"]+)"', 1)) AS url FROM d_code))"""
Q("src_client_calls", f"WITH {CALLS} SELECT * FROM calls")(lambda d: code.client_calls(d.code))
Q(
    "gr_module_edges",
    f"""WITH {IMPORTS}, t AS (SELECT repo_id, path AS src, regexp_replace(path, '[^/]*$', '') || target[3:] AS base FROM imports WHERE target[1] = '.') SELECT DISTINCT t.repo_id, src, f.path AS dst FROM t JOIN d_code f ON f.repo_id = t.repo_id AND f.path = base || '.ts'""",
)(lambda d: code.module_edges(code.imports(d.code), d.code))
Q(
    "jn_orphan_routes",
    f"""WITH {ROUTES}, {CALLS}, r AS (SELECT DISTINCT lower(regexp_replace(path, '/:[A-Za-z0-9_]+', '/:id', 'g')) AS path FROM routes), c AS (SELECT DISTINCT path FROM calls)
    SELECT path, 'MEDIUM' AS risk FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = r.path OR starts_with(c.path, r.path) OR starts_with(r.path, c.path))""",
)(
    lambda d: joins.orphan_routes(
        code.routes(d.code).select(fn.normalize_route(F.col("path")).alias("path")).distinct(), code.client_calls(d.code).select("path")
    )
)
PAGE_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '')"
HREF = 'href="([^"]+)"'
Q(
    "jn_orphan_routes_links",
    f"""WITH r AS (SELECT DISTINCT {PAGE_PATH} AS path FROM pages), l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages)
    SELECT path FROM r WHERE length(path) > 1 AND NOT regexp_matches(path, '^/(health|metrics|internal|admin|:id)') AND NOT EXISTS (SELECT 1 FROM l WHERE contains(link, path) OR contains(path, link))""",
)(
    lambda d: joins.orphan_routes_links(
        d.table("pages").select(F.expr(PAGE_PATH).alias("path")).distinct(), d.table("pages").select(F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("path"))
    )
)


Q(
    "jn_unused_deps",
    f"""WITH {IMPORTS}, deps AS (SELECT CAST(s_suppkey AS INT) AS repo_id, 'pkg' || n AS name, n AS seq FROM supplier, (SELECT unnest(range(10)) AS n)) SELECT repo_id, name, seq FROM deps d WHERE NOT EXISTS (SELECT 1 FROM imports i WHERE i.repo_id = d.repo_id AND i.package = d.name)""",
)(
    lambda d: joins.unused_deps(
        d.table("supplier").select(F.col("s_suppkey").cast("int").alias("repo_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seq")).withColumn("name", F.concat(F.lit("pkg"), F.col("seq").cast("string"))).withColumn("seq", F.col("seq").cast("long")),
        code.imports(d.code),
        "^(typescript|eslint|prettier|vite|webpack|jest|vitest)",
    )
)
Q(
    "jn_dep_reachability",
    f"""WITH {IMPORTS} SELECT repo_id, package AS name, count(DISTINCT path) AS files FROM imports WHERE package IS NOT NULL GROUP BY ALL""",
)(lambda d: code.imports(d.code).filter("package IS NOT NULL").groupBy("repo_id", F.col("package").alias("name")).agg(F.count_distinct("path").alias("files")))
Q(
    "rl_project_checks",
    """SELECT repo_id, missing FROM (SELECT repo_id, unnest([CASE WHEN NOT bool_or(regexp_matches(content, 'rate-?limit')) THEN 'rate_limit' END, CASE WHEN NOT bool_or(regexp_matches(content, 'password')) THEN 'password' END, CASE WHEN NOT bool_or(regexp_matches(content, 'pkg6')) THEN 'pkg6' END]) AS missing FROM d_code GROUP BY repo_id) WHERE missing IS NOT NULL""",
)(lambda d: rules.project_checks(d.code, {"rate_limit": "rate-?limit", "password": "password", "pkg6": "pkg6"}))
Q(
    "jn_missing_controls",
    """SELECT missing AS control, count(*) AS repos FROM (SELECT repo_id, unnest([CASE WHEN NOT bool_or(regexp_matches(content, 'encrypt')) THEN 'encryption' END, CASE WHEN NOT bool_or(regexp_matches(content, 'r1[0-9]/')) THEN 'audit' END]) AS missing FROM d_code GROUP BY repo_id) WHERE missing IS NOT NULL GROUP BY 1""",
)(lambda d: rules.project_checks(d.code, {"encryption": "encrypt", "audit": "r1[0-9]/"}).groupBy(F.col("missing").alias("control")).agg(F.count("*").alias("repos")))
Q(
    "wn_context_window",
    f"""WITH {LINES}, near AS (SELECT *, bool_or(contains(line, '<article')) OVER (PARTITION BY file_id ORDER BY line_no RANGE BETWEEN 30 PRECEDING AND 29 FOLLOWING) AS r FROM lines) SELECT file_id, line_no FROM near WHERE contains(line, '<footer') AND r""",
)(lambda d: windows.rule_context(_lines(d), F.col("line").contains("<footer"), F.col("line").contains("<article")).select("file_id", "line_no"))
Q(
    "wn_near_lines",
    f"""WITH {CODE_LINES}, near AS (SELECT *, bool_or(contains(line, 'password')) OVER (PARTITION BY repo_id, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS g FROM lines) SELECT repo_id, path, line_no FROM near WHERE contains(line, 'fetch(') AND NOT g""",
)(
    lambda d: windows
    .near_lines(_code_lines(d).withColumn("file_id", F.struct("repo_id", "path")), F.col("line").contains("fetch("), F.col("line").contains("password"))
    .select("repo_id", "path", "line_no")
)
LITERAL_SQL = rules.LITERAL.replace("'", "''")
#: Back references as blocks that repeat: four times or more, or digits three times or more.
AGAIN = "len(list_filter(range(1, n // 3 + 1), lambda p: n % p = 0 AND repeat(literal[:p], n // p) = literal AND (n >= 4 * p OR (p > 1 AND regexp_matches(literal, '^[0-9]+$'))))) > 0"
_class = lambda pattern: f"(len(regexp_extract_all(literal, '{pattern}')) / n >= 0.02)::INT"
SPECIAL_SQL = r"""[!@#$%^&*()_+\-=\[\]{};'':"\\|,.<>/?`~]"""
#: Literals of 16 characters and more hold no run of a keyboard, which has 10 at most.
LEAK_SQL = f"""chars AS (SELECT literal, unnest(string_split(literal, '')) AS ch FROM literals), shares AS (SELECT literal, ch, count(*) / sum(count(*)) OVER (PARTITION BY literal) AS p FROM chars WHERE ch <> '' GROUP BY literal, ch),
    told AS (SELECT literal, length(literal) AS n, count(*) AS kinds, floor(-sum(p * log2(p)) * 10000 + 0.5) / 10000 AS entropy FROM shares GROUP BY literal),
    judged AS (SELECT literal, entropy, n BETWEEN 16 AND 256 AND NOT regexp_matches(literal, '\\s') AND NOT ({AGAIN}) AND NOT regexp_matches(literal, '{rules.DATES}') AND NOT regexp_matches(lower(literal), '{rules.BOILERPLATE}')
      AND {_class('[A-Z]')} + {_class('[a-z]')} + {_class('[0-9]')} + {_class(SPECIAL_SQL)} >= 2 AND kinds / n >= 0.35 AND entropy > 4.5 AS leak FROM told)"""
TYPE_SQL = r"""CASE WHEN regexp_matches(literal, '^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$') THEN 'jwt' WHEN regexp_matches(literal, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN 'uuid' WHEN regexp_matches(literal, '^[A-Za-z0-9+/]+={0,2}$') AND length(literal) >= 20 THEN 'base64'
      WHEN regexp_matches(literal, '^[0-9a-fA-F]+$') AND length(literal) >= 32 THEN 'hex' WHEN regexp_matches(literal, '^[A-Za-z0-9_-]{20,}$') THEN 'alphanumeric_high_entropy' WHEN regexp_matches(literal, '^sk-[A-Za-z0-9_-]+$') THEN 'openai_key' WHEN regexp_matches(literal, '^ghp_[A-Za-z0-9_-]+$') THEN 'github_token' WHEN regexp_matches(literal, '^AKIA[A-Z0-9]{16}$') THEN 'aws_access_key' ELSE 'unknown' END"""
#: Documents, pages, source files and code.
TEXT_LINES = "lines AS (SELECT repo_id, path, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line FROM (SELECT repo_id, path, string_split(content, chr(10)) AS parts FROM (SELECT * FROM d_all UNION ALL SELECT CAST(repo_id AS VARCHAR(40)), path, content FROM d_code)))"


def _leaks(d: Domain):
    texts = d.everything.unionByName(d.code.withColumn("repo_id", F.col("repo_id").cast("string")))
    return rules.entropy_scan(code.code_lines(texts, "repo_id", "path"), ["repo_id", "path"])


LEAKS_SQL = f"""WITH {TEXT_LINES}, said AS (SELECT repo_id, path, line_no, unnest(regexp_extract_all(line, '{LITERAL_SQL}', 1)) AS literal FROM lines), literals AS (SELECT DISTINCT literal FROM said), {LEAK_SQL},
    leaks AS (SELECT repo_id, path, line_no, literal, entropy, {TYPE_SQL} AS type FROM said JOIN judged USING (literal) WHERE leak)"""
Q("rl_entropy_scan", f"{LEAKS_SQL} SELECT * FROM leaks")(_leaks)
Q("rl_entropy_report", f"{LEAKS_SQL} SELECT repo_id, type, count(*) AS n, floor(round(avg(entropy), 9) * 10000 + 0.5) / 10000 AS mean FROM leaks GROUP BY ALL")(lambda d: rules.entropy_report(_leaks(d), ["repo_id"]))
CC = "len(regexp_extract_all(content, '(?i)\\b(?:if|else\\s+if|for\\b|while\\b|catch\\b|switch|case)\\b|&&|\\|\\||\\?')) + 1"
Q(
    "ag_complexity_snapshot",
    f"""WITH f AS (SELECT repo_id, {CC} AS cc, len(string_split(content, chr(10))) AS n FROM d_files), s AS (SELECT *, n > 200 AND cc > 15 AS god FROM f)
    SELECT repo_id, count(*) AS files, floor(round(avg(cc), 9) * 100 + 0.5) / 100 AS mean, CAST(max(cc) AS INT) AS max, count(*) FILTER (god) AS gods, count(*) FILTER (n > 300) AS large,
      CASE WHEN avg(god::INT) > 0.3 THEN 'critical' WHEN avg(god::INT) > 0.2 THEN 'high' WHEN avg(god::INT) > 0.1 THEN 'moderate' ELSE 'low' END AS risk FROM s GROUP BY repo_id""",
)(lambda d: rules.complexity_report(rules.complexity_snapshot(d.files)))
FEATURES = {"login": {"frontend": "eval", "api": "router", "auth": "password", "data": "pkg3", "test": "expect"}, "shop": {"frontend": "fetch", "api": "router", "auth": "pkg", "data": "api/r4", "test": "import"}}
Q(
    "ag_feature_reality",
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT repo_id, '{f}' AS feature, bool_or(regexp_matches(content, '{x['frontend']}')) AS shown, ({' + '.join(f'bool_or(regexp_matches(content, {chr(39)}{p}{chr(39)}))::INT' for p in x.values())}) / 5.0 AS r FROM d_code GROUP BY repo_id" for f, x in FEATURES.items())
    + ") SELECT repo_id, feature, CAST(floor(r * 100 + 0.5) AS BIGINT) AS percent, CASE WHEN r >= 0.8 THEN 'verified' WHEN r >= 0.4 THEN 'partial' ELSE 'mocked' END AS status FROM f WHERE shown",
)(lambda d: rules.feature_reality(d.code, FEATURES))

# Scalar functions
ALNUM = "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"
Q("fn_normalize_title", f"SELECT title, {ALNUM} AS key, count(*) AS n FROM (SELECT title || '--' || upper(category) || '!! (x) ' AS title FROM d_issues) GROUP BY ALL")(
    lambda d: d.issues.select(F.concat("title", F.lit("--"), F.upper("category"), F.lit("!! (x) ")).alias("title")).groupBy("title", fn.normalize_title(F.col("title")).alias("key")).agg(F.count("*").alias("n"))
)
Q("fn_title_fp", "SELECT DISTINCT trim(regexp_replace(lower(title || '-' || category), '[^a-z0-9 ]', '', 'g'))[:40] AS fp FROM d_issues")(lambda d: d.issues.select(fn.title_key(F.concat("title", F.lit("-"), "category")).alias("fp")).distinct())
Q("fn_normalize_route", "SELECT url, lower(regexp_replace(regexp_replace(url, '/:[A-Za-z0-9_]+', '/:id', 'g'), '/[0-9]+', '/:id', 'g')) AS route FROM pages")(lambda d: d.table("pages").select("url", fn.normalize_route(F.col("url")).alias("route")))
Q("fn_normalize_path", "SELECT url, lower(regexp_replace(regexp_replace(regexp_replace(url, '[\"''`]', '', 'g'), '/+', '/', 'g'), '/$', '')) AS path FROM pages")(lambda d: d.table("pages").select("url", fn.normalize_path(F.col("url")).alias("path")))
Q("fn_route_regex", f"WITH {ROUTES} SELECT DISTINCT path, '^' || regexp_replace(path, ':[A-Za-z0-9_]+', '([^/]+)', 'g') || '$' AS regex FROM routes")(lambda d: code.routes(d.code).select("path", fn.route_regex(F.col("path")).alias("regex")).distinct())
Q("fn_semver", "SELECT DISTINCT version_spec, regexp_replace(version_spec, '^\\^', '') AS version FROM d_deps")(
    lambda d: d.held(d.stock).select("version_spec").distinct().select("version_spec", F.concat_ws(".", F.transform(fn.semver(F.col("version_spec")), lambda x: x.cast("string"))).alias("version"))
)
Q(
    "fn_shannon",
    """WITH c AS (SELECT url, unnest(string_split(url, '')) AS ch FROM (SELECT DISTINCT url FROM pages)), n AS (SELECT url, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL), p AS (SELECT url, ch, k / sum(k) OVER (PARTITION BY url) AS p FROM n)
    SELECT url, floor(round(floor(-sum(p * log2(p)) * 10000 + 0.5) / 10000, 6) * 100 + 0.5) / 100 AS entropy FROM p GROUP BY url""",
)(lambda d: d.table("pages").select("url").distinct().select("url", fn.half_up(F.round(fn.char_entropy(F.col("url")), 6), 2).alias("entropy")))
Q(
    "fn_char_classes",
    "SELECT url, len(regexp_extract_all(url, '[A-Z]')) AS upper, len(regexp_extract_all(url, '[a-z]')) AS lower, len(regexp_extract_all(url, '[0-9]')) AS digit FROM pages",
)(lambda d: d.table("pages").select("url", fn.char_classes(F.col("url")).alias("x")).select("url", "x.upper", "x.lower", "x.digit"))
Q(
    "fn_secret_type",
    """SELECT word, CASE WHEN regexp_matches(word, '^[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+$') THEN 'jwt' WHEN regexp_matches(word, '^[A-Za-z0-9+/]+={0,2}$') AND length(word) >= 20 THEN 'base64' WHEN regexp_matches(word, '^[A-Za-z0-9_-]{20,}$') THEN 'alphanumeric_high_entropy' ELSE 'unknown' END AS type
    FROM (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]+')) AS word FROM documents) WHERE word <> ''""",
)(lambda d: d.table("documents").select(F.explode(F.split("text", "[ \\n]+")).alias("word")).filter("word <> ''").distinct().select("word", fn.secret_type(F.col("word")).alias("type")))
Q("fn_purl", "SELECT DISTINCT 'pkg:npm/' || name || '@' || version_spec AS purl, regexp_replace(name, '[^A-Za-z0-9]', '-', 'g') || '-' || version_spec AS bom_ref FROM d_deps")(
    lambda d: d.held(d.stock).select("name", "version_spec").distinct().select(fn.purl(F.col("name"), F.col("version_spec")).alias("purl"), fn.bom_ref(F.col("name"), F.col("version_spec")).alias("bom_ref")).distinct()
)
Q("fn_impact_label", "SELECT o_orderkey AS id, CASE WHEN p >= 100000 THEN printf('%.1f', p / 100000.0) || 'L' WHEN p >= 1000 THEN CAST(floor(p / 1000 + 0.5) AS BIGINT) || 'K' ELSE CAST(p AS VARCHAR) END AS label FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 10 + 3 AS p FROM orders)")(
    lambda d: d.table("orders").select(F.col("o_orderkey").alias("id"), fn.impact_label(F.floor("o_totalprice") * 10 + 3).alias("label"))
)
Q("fn_language", "SELECT file_id, CASE WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'unknown' END AS language FROM d_files")(lambda d: d.files.select("file_id", fn.language(F.col("path")).alias("language")))
Q("fn_cyclomatic", "SELECT file_id, CAST(len(regexp_extract_all(content, '\\b(?:if|for|while|case|catch)\\b|&&|\\|\\||\\?')) + 1 AS INT) AS cyclomatic FROM d_files")(lambda d: d.files.select("file_id", fn.cyclomatic(F.col("content")).alias("cyclomatic")))
NCDF = "CASE WHEN x > 0 THEN 1 - t ELSE t END"
Q(
    "fn_norm_cdf",
    f"""WITH a AS (SELECT id, x, 1 / (1 + 0.2316419::DOUBLE * abs(x)) AS k FROM (SELECT c_custkey AS id, c_acctbal / 2500 AS x FROM customer)), b AS (SELECT id, x, 0.3989423 * exp(-x * x / 2) * k * (0.3193815 + k * (-0.3565638 + k * (1.781478 + k * (-1.821256 + k * 1.330274)))) AS t FROM a) SELECT id, round({NCDF}, 6) AS p FROM b""",
)(lambda d: d.table("customer").select(F.col("c_custkey").alias("id"), F.round(fn.normal_cdf(F.col("c_acctbal") / 2500), 6).alias("p")))
Q("fn_hick", "SELECT event_id, round(0.15 + 0.19 * log2(event_id % 50 + 1), 6) AS seconds, 0.15 + 0.19 * log2(event_id % 50 + 1) > 1.2 AS slow FROM events")(
    lambda d: d.table("events").select("event_id", F.round(fn.hick_seconds(F.col("event_id") % 50), 6).alias("seconds"), (fn.hick_seconds(F.col("event_id") % 50) > 1.2).alias("slow"))
)

# Similarity
def _signatures(files, *others):
    tokens = F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return similarity.signatures(files.withColumn("id", F.col("file_id")), tokens, *others)


_slots = [f"min((h * {k * 12345 + 67890} + {k * 54321 + 9876}) % 4294967311)" for k in range(64)]
HASHED = """w AS (SELECT DISTINCT file_id, unnest(string_split_regex(lower(content), '[^a-z0-9]+')) AS w FROM d_files), h AS (SELECT file_id, CAST('0x' || md5(w)[:8] AS BIGINT) AS h FROM w WHERE length(w) > 2)"""
#: A column s0 to s63 per slot.
SIGNED = f"{HASHED}, sigs AS MATERIALIZED (SELECT file_id AS id, {', '.join(f'{x} AS s{k}' for k, x in enumerate(_slots))} FROM h GROUP BY file_id)"
SAME = "(" + " + ".join(f"(a.s{k} = b.s{k})::INT" for k in range(64)) + ") / 64"
#: All signatures against all: no bands. Equal signatures pair through their first id.
CLONES = f"""{SIGNED}, firsts AS MATERIALIZED (SELECT *, min(id) OVER (PARTITION BY {', '.join(f's{k}' for k in range(64))}) AS lead FROM sigs),
    clones AS MATERIALIZED (SELECT id, other, similarity FROM (SELECT a.id, b.id AS other, {SAME} AS similarity FROM firsts a JOIN firsts b ON a.id < b.id WHERE a.id = a.lead AND b.id = b.lead) WHERE similarity >= 0.7 UNION ALL SELECT lead, id, 1 FROM firsts WHERE id <> lead)"""
Q("sm_minhash", f"WITH {HASHED} SELECT file_id AS id, md5(concat_ws(',', {', '.join(_slots)})) AS signature FROM h GROUP BY file_id")(lambda d: _signatures(d.files).select("id", F.md5(F.array_join("signature", ",")).alias("signature")))
Q(
    "sm_similarity_pairs",
    f"WITH {CLONES} SELECT id, other, similarity, CASE WHEN similarity >= 0.95 THEN 'identical' WHEN similarity >= 0.85 THEN 'near-clone' WHEN similarity >= 0.65 THEN 'type-3' ELSE 'type-4' END AS kind FROM clones",
)(lambda d: similarity.clone_pairs(_signatures(d.files), 0.7))
Q(
    "sm_clone_groups",
    f"""WITH RECURSIVE {CLONES}, e AS MATERIALIZED (SELECT id, other FROM clones UNION SELECT other, id FROM clones), r AS (SELECT id, id AS node FROM e UNION SELECT r.id, e.other FROM r JOIN e ON r.node = e.id)
    SELECT id, min(node) AS root FROM r GROUP BY id""",
)(lambda d: similarity.clone_groups(similarity.clone_pairs(_signatures(d.files), 0.7)))
Q(
    "sm_merkle",
    f"""WITH RECURSIVE {CODE_LINES}, bare AS (SELECT repo_id, path, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines),
    leaf AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY path, line_no) - 1 AS pos, sha256(path || ':' || line_no || ':' || line) AS hash FROM bare WHERE line <> ''),
    up AS (SELECT 0 AS level, repo_id, pos, hash FROM leaf UNION ALL SELECT level + 1, repo_id, pos // 2, sha256(min_by(hash, pos) || max_by(hash, pos)) FROM (SELECT *, max(pos) OVER (PARTITION BY repo_id) AS last FROM up) WHERE last > 0 GROUP BY level, repo_id, pos // 2)
    SELECT repo_id, max_by(hash, level) AS root, count(*) FILTER (level = 0) AS leaves FROM up GROUP BY repo_id""",
)(lambda d: similarity.merkle_roots(_code_lines(d)))
Q(
    "sm_shape_hash",
    "SELECT scan_id % 100 AS repo, sha256(string_agg(agent_name || ':' || confidence, '|' ORDER BY agent_name || ':' || confidence))[:16] AS shape FROM d_issues GROUP BY 1",
)(lambda d: similarity.shape_hash(d.issues.select((F.col("scan_id") % 100).alias("repo"), F.col("k2").alias("id"), F.col("agent_name").alias("type"), F.col("confidence").alias("degree"))))
