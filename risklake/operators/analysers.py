"""Analysers' scores over source text: counts per line or file, combined before the shuffle, and a formula per repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklake.functions.scalars import clamp, half_up

#: Cryptography: name, pattern, effect; fixed.
CRYPTO = (
    ("MD5", r"(?i)\bcreateHash\s*\(\s*[\"']md5[\"']\)", "critical"),
    ("SHA-1", r"(?i)\bcreateHash\s*\(\s*[\"']sha1[\"']\)", "high"),
    ("MD5/SHA1", r"(?i)\b(md5|sha1)\s*\(", "critical"),
    ("SHA-256", r"(?i)\bcreateHash\s*\(\s*[\"']sha256[\"']\)", "modern"),
    ("SHA-512", r"(?i)\bcreateHash\s*\(\s*[\"']sha512[\"']\)", "modern"),
    ("SHA-256/512", r"(?i)\b(sha256|sha512)\s*\(", "modern"),
    ("bcrypt/scrypt/argon2/pbkdf2", r"(?i)\b(bcrypt|scrypt|argon2|pbkdf2)\b", "modern"),
    ("DES/RC4", r"(?i)\b(DES|RC4|TripleDES|createCipher\s*\(\s*[\"']des)", "critical"),
    ("AES-CBC (potentially weak)", r"(?i)\bcreateCipher\s*\(\s*[\"']aes[\"']", "medium"),
    ("AES-256-GCM", r"(?i)\bcreateCipheriv\s*\(\s*[\"']aes-256-gcm[\"']", "modern"),
    ("XChaCha20-Poly1305", r"(?i)\bXChaCha20|chacha20-poly1305", "modern"),
    ("Math.random (not crypto-safe)", r"(?i)\bMath\.random\s*\(", "high"),
    ("Ed25519/EdDSA", r"(?i)\bed25519|Ed25519|ed448|EdDSA", "modern"),
    ("ECDSA", r"(?i)\becdsa|ECDSA", "modern"),
    ("RSA-SHA256", r"(?i)\brsa-sha256|RS256|PS256", "modern"),
    ("Hardcoded secret", r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*[\"'][a-zA-Z0-9_\-]{16,}[\"']", "critical"),
    ("Hardcoded private key", r"(PRIVATE KEY|RSA PRIVATE KEY|BEGIN CERTIFICATE)", "critical"),
)
#: Algorithms: name, pattern, what a quantum computer does to it (shor: breaks it, grover: halves it); fixed.
ALGORITHMS = (
    ("rsa_rhs", r"(?i)\b(RSA|rsa\.|node-rsa|PKCS1_OAEP|createCipheriv\('rsa)", "shor"),
    ("ecc_ecdsa", r"(?i)\b(ecdsa|ECDSA|elliptic|secp256k1|secp384r1|secp521r1|createECDH)", "shor"),
    ("aes128", r"(?i)\b(aes-128|AES-128|aes128|aes_128|createCipher\('aes-128)", "grover"),
    ("aes256", r"(?i)\b(aes-256|AES-256|aes256|aes_256|createCipheriv\('aes-256-gcm)", "safe"),
    ("sha1_hash", r"(?i)\bcreateHash\('sha1'\)|sha1\b|SHA-1", "weak"),
    ("md5_hash", r"(?i)\bcreateHash\('md5'\)|md5\b|MD5", "weak"),
    ("sha256_hash", r"(?i)\bcreateHash\('sha256'\)|sha256\b|SHA-256", "safe"),
    ("sha512_hash", r"(?i)\bcreateHash\('sha512'\)|sha512\b|SHA-512", "safe"),
    ("bcrypt_kdf", r"(?i)\b(bcrypt|scrypt)\b", "safe"),
    ("argon2", r"(?i)\bargon2\b", "safe"),
)
#: Ways to cheat a score: pattern, added fraud risk of a line; and what each file must say or not say; fixed.
SCORE_HACKS = (
    (r"(?i)\b(localStorage|sessionStorage|cookie)\b.*\b(score|points|reward)\b", 30),
    (r"(?i)\b(score|points)\s*[=:]\s*\d+", 15),
    (r"(?i)\b(Math\.random|Math\.floor|Math\.ceil)\b.*\b(reward|score|points)\b", 15),
    (r"(?i)\b(increaseBy|addPoints|setScore|updateScore)\b.*\b(=\s*[^)]*\))\s*\{", 30),
)
INVARIANTS = (
    ("Monotonicity", r"(?i)\b(reward|score|points)\b.*\b(decrement|subtract|remove|lose)\b", True),
    ("Bounded Growth", r"(?i)\b(max|limit|cap|ceiling|MAX_REWARD)\b", True),
    ("Server Authority", r"server|api|database|backend", True),
    ("No Self-Referral", r"(?i)\breferral\b.*\b(self|own|same)\b", False),
)
#: Memory operations: pattern, bytes of each; fixed.
ALLOCATIONS = (
    (r"\bnew\s+(Array|Object|Map|Set|WeakMap|WeakSet|Promise)\s*\(", 256),
    (r"\bnew\s+\w+\s*\(", 128),
    (r"\[\s*\]|\{\s*\}", 64),
    (r"\b(Array\.from|Array\.of|Array\.concat)\b", 128),
    (r"\b(Object\.assign|Object\.create|Object\.spread|\.\.\.)\b", 256),
    (r"\b(JSON\.parse|JSON\.stringify)\b", 512),
    (r"\b(structuredClone|cloneDeep|\.clone\(\))\b", 512),
)
MUTATIONS = (
    r"\b(Object\.assign|Object\.defineProperty|Object\.freeze|Object\.seal)\b",
    r"(\.push\(|\.pop\(|\.shift\(|\.unshift\(|\.splice\(|\.fill\()",
    r"\bdelete\s+\w+",
    r"(\w+\[.*?\]\s*=|\w+\.\w+\s*=)",
)
DEALLOCATIONS = (
    r"\bdelete\s+\w+",
    r"(\.length\s*=\s*0|\.splice\(0,\s*\.length\))",
    r"\b(null\s*=\s*|undefined\s*=\s*|weakRef|WeakRef|FinalizationRegistry)\b",
)
#: Resilience: name, pattern, weight; fixed.
RESILIENCE = (
    ("asyncAwait", r"\basync\s+(function|\(|\w+\s*=>)", 15),
    ("promises", r"\b(Promise\.all|Promise\.race|Promise\.allSettled|Promise\.any|new\s+Promise)\b", 10),
    ("fetchWithHandling", r"fetch\s*\([^)]+\)\s*\.\s*(then|catch)", 5),
    ("abortController", r"\b(AbortController|AbortSignal|signal\s*:\s*abort)", 10),
    ("timeoutConfig", r"(?i)\bsetTimeout|clearTimeout|timeout\s*[=:]\s*\d+|REQUEST_TIMEOUT|HTTP_TIMEOUT", 8),
    ("retryWithBackoff", r"(?i)\b(retry|backoff|exponential|attempt|retries|maxRetries)", 15),
    ("circuitBreaker", r"(?i)\b(circuitBreaker|circuit.breaker|openCircuit|halfOpen|closedCircuit)", 10),
    ("caching", r"(?i)\b(cache|redis|memcache|stale-while-revalidate|Cache-Control|ETag|If-None-Match)", 10),
    ("offlineSupport", r"(?i)\b(offline|serviceWorker|localForage|indexedDB|background-sync|sync\.manager)", 15),
    ("messageQueue", r"(?i)\b(queue|bull|kafka|rabbitmq|eventEmitter|storeAndForward)", 10),
    ("errorBoundaries", r"(?i)(ErrorBoundary|\.catch\s*\(|onerror|onunhandledrejection|errorFallback)", 8),
    ("gracefulDegradation", r"(?i)\b(fallback|degraded|graceful|partial\s+data|stale\s+data)", 5),
)
#: Deployment checks: name, severity, patterns of which each must be in some file's text (or path); fixed.
DEPLOYMENT = (
    ("Production build configuration", "critical", (("build", r"(?i)output|dist|build"),)),
    ("Environment variable management", "high", (("path", r"\.env"),)),
    ("Security headers (CSP, HSTS)", "high", (("content", r"(?i)Content-Security-Policy|CSP"), ("content", r"(?i)https|secure|TLS"))),
    ("CORS configuration", "high", (("content", r"(?i)cors|Access-Control-Allow-Origin"),)),
    ("Error handling / 404 page", "medium", (("content", r"(?i)ErrorBoundary|error\.tsx|404|Not Found"),)),
    ("Logging configured", "medium", (("content", r"(?i)logger|pino|winston|console\.(log|error|warn)"),)),
    ("Rate limiting", "high", (("content", r"(?i)rate|throttle|limiter"),)),
    ("Webhook signature verification", "high", (("content", r"(?i)webhook.*signature|verify.*signature|hmac"),)),
    ("Database migrations ready", "medium", (("content", r"(?i)migration|migrate|schema\.sql"),)),
    ("Health check endpoint", "medium", (("health", r"(?i)health|ping|alive"),)),
)
BUILD_FILES = r"(vite\.config\.ts|next\.config\.js|webpack\.config\.js|Dockerfile|vercel\.json|netlify\.toml)$"
SERVED = r"(?i)route|router|app\.(get|use)"
#: Gates on the way to market; patterns over paths and texts; fixed.
MIGRATION_PATH = r"migration|migrate|schema\.sql|drizzle|prisma"
MODEL_PATH = (r"(?i)schema|model|entity", r"\.(ts|js|prisma|sql)$")
VALIDATION = r"zod|z\.object|z\.string|safeParse|express-validator|check\(|validationResult|joi|Joi\.|valibot|v\.object|v\.string"
ACCESS = r"requireAuth|authenticate|verifyToken|isAuthenticated|hasRole|canAccess|middleware|role|permission|scopes|rbac|abilities"
ERRORS = r"ErrorBoundary|error\.tsx|componentDidCatch|getDerivedStateFromError|logger|winston|pino|sentry|captureException"
TEST_PATH = r"\.(test|spec)\.(ts|tsx|js|jsx)$"
TESTS = r"\"test\"\s*:|vitest|jest|mocha|cypress|playwright"
CI_PATH = r"(?i)\.github/workflows|\.gitlab-ci|\.circleci|azure-pipelines|\.netlify|\.vercel|Dockerfile"


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("long"))


def _lines_met(pattern: str) -> Column:
    return F.count_if(F.col("line").rlike(pattern))


def _band(score: Column, names: tuple[str, str, str, str]) -> Column:
    return F.when(score >= 80, names[0]).when(score >= 60, names[1]).when(score >= 40, names[2]).otherwise(names[3])


def crypto_score(lines: DataFrame) -> DataFrame:
    """lines(repo_id, line): lines with critical, high and medium faults and with modern algorithms; 100 - 25c - 15h - 5m + 3 modern, and a band."""
    met = lines.groupBy("repo_id").agg(*[_lines_met(p).alias(f"_{k}") for k, (_, p, _) in enumerate(CRYPTO)])
    totals = {e: _total(F.col(f"_{k}") for k, (_, _, effect) in enumerate(CRYPTO) if effect == e) for e in ("critical", "high", "medium", "modern")}
    score = clamp(100 - 25 * F.col("critical") - 15 * F.col("high") - 5 * F.col("medium") + 3 * F.col("modern"), 0, 100)
    found = met.select("repo_id", *[c.alias(e) for e, c in totals.items()]).withColumn("score", score.cast("long"))
    return found.withColumn("band", _band(F.col("score"), ("strong", "adequate", "weak", "critical")))


def pq_inventory(lines: DataFrame) -> DataFrame:
    """lines(repo_id, path, line_no, line): a row per repository and algorithm found, with its places, and the repository's score
    100 - 30 per algorithm that Shor's breaks - 15 per one that Grover's halves, and risk."""
    each = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(name).alias("algorithm"), F.lit(effect).alias("effect"))) for name, p, effect in ALGORITHMS]))
    hits = lines.select("repo_id", "path", "line_no", F.explode(each).alias("x")).select("repo_id", "x.*", "path", "line_no")
    places = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line_no"))), lambda x: F.concat_ws(":", x["path"], x["line_no"].cast("string"))), ",")
    inventory = hits.groupBy("repo_id", "algorithm", "effect").agg(places.alias("locations"), F.count("*").alias("n"))
    score = clamp(100 - 30 * F.count_if(F.col("effect") == "shor") - 15 * F.count_if(F.col("effect") == "grover"), 0, 100).cast("long")
    scores = inventory.groupBy("repo_id").agg(score.alias("score"))
    return inventory.join(scores, "repo_id").withColumn("risk", _band(F.col("score"), ("low", "medium", "high", "critical")))


def reward_score(files: DataFrame) -> DataFrame:
    """files(repo_id, content): 100 - 15 per violated invariant of a file - 8 per way to cheat in a file - half the lines' fraud risk, and a risk class."""
    lines = F.split("content", "\n", -1)
    said = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    hacks = [(F.col("content").rlike(p).cast("long"), said(p) * risk) for p, risk in SCORE_HACKS]
    broken = [(F.col("content").rlike(p) != must).cast("long") for _, p, must in INVARIANTS]
    per_file = files.select("repo_id", _total(broken).alias("violations"), _total(h for h, _ in hacks).alias("hacks"), _total(r for _, r in hacks).alias("fraud"))
    found = per_file.groupBy("repo_id").agg(*[F.sum(c).alias(c) for c in ("violations", "hacks", "fraud")])
    score = clamp(half_up(100 - 15 * F.col("violations") - 8 * F.col("hacks") - 0.5 * F.col("fraud")), 0, 100).cast("long")
    safe = (F.col("score") >= 80) & (F.col("violations") == 0) & (F.col("hacks") == 0)
    risk = F.when(safe, "safe").when((F.col("score") >= 50) & (F.col("hacks") <= 2), "at-risk").otherwise("critical")
    return found.withColumn("score", score).withColumn("risk", risk)


def memory_ops(lines: DataFrame) -> DataFrame:
    """lines(repo_id, line): allocations, their bytes, mutations, deallocations, lines that allocate in a loop's head, and garbage pressure."""
    count = lambda p: F.regexp_count("line", F.lit(p))
    counted = lines.select(
        "repo_id",
        _total(count(p) for p, _ in ALLOCATIONS).alias("a"),
        _total(count(p) * size for p, size in ALLOCATIONS).alias("b"),
        _total(map(count, MUTATIONS)).alias("m"),
        _total(map(count, DEALLOCATIONS)).alias("d"),
        (F.col("line").rlike(r"\b(for|while)\s*\(") & F.col("line").rlike(r"new\s+")).alias("g"),
    )
    sums = [F.sum(c).alias(name) for c, name in (("a", "allocations"), ("b", "bytes"), ("m", "mutations"), ("d", "deallocations"))]
    found = counted.groupBy("repo_id").agg(*sums, F.count_if("g").alias("loop_points"))
    share = half_up(F.col("allocations") / F.greatest(F.lit(1), F.col("allocations") + F.col("deallocations")) * 100)
    return found.withColumn("pressure", F.when(F.col("allocations") > 0, F.least(F.lit(100), share)).otherwise(0).cast("long"))


def resilience_patterns(files: DataFrame) -> DataFrame:
    """files(repo_id, content): the patterns that any file has, the sum of their weights, at most 100, and a band."""
    seen = files.groupBy("repo_id").agg(*[F.max(F.col("content").rlike(p)).alias(name) for name, p, _ in RESILIENCE])
    score = F.least(F.lit(100), _total(F.when(F.col(name), w).otherwise(0) for name, _, w in RESILIENCE)).cast("long")
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name, _, _ in RESILIENCE])), ",")
    return seen.select("repo_id", names.alias("patterns"), score.alias("score")).withColumn("band", _band(F.col("score"), ("resilient", "moderate", "fragile", "brittle")))


def perf_scores(findings: DataFrame, functions: DataFrame, bundles: DataFrame) -> DataFrame:
    """findings(repo, category, severity), functions(repo, complexity), bundles(repo, kb): performance, bundle, complexity and reliability scores."""
    n = lambda c: F.count_if(F.col("category") == c).alias(c)
    seen = findings.groupBy("repo").agg(*map(n, ("n_plus_one", "sync_blocking", "heavy_import", "memory_leak", "dead_code")), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high")])
    walked = functions.groupBy("repo").agg(F.avg("complexity").alias("mean"), F.count_if(F.col("complexity") > 15).alias("complex"))
    joined = bundles.join(seen, "repo", "left").join(walked, "repo", "left").na.fill(0, ["n_plus_one", "sync_blocking", "heavy_import", "memory_leak", "dead_code", "critical", "high", "complex"]).na.fill(1.0, ["mean"])
    penalty = F.when(F.col("kb") > 500, 20).when(F.col("kb") > 200, 10).otherwise(0)
    least = lambda x: F.greatest(F.lit(0), x)
    return joined.select(
        "repo",
        least(100 - F.least(F.col("n_plus_one") * 15, F.lit(40)) - F.least(F.col("sync_blocking") * 20, F.lit(40)) - F.col("critical") * 10 - F.col("high") * 5).cast("long").alias("performance"),
        least(100 - penalty - F.col("heavy_import") * 5).cast("long").alias("bundle"),
        half_up(F.round(F.greatest(F.lit(0.0), 100 - F.col("complex") * 8 - F.greatest(F.lit(0.0), F.col("mean") - 5) * 5), 9), 4).alias("complexity"),
        least(100 - F.col("memory_leak") * 15 - F.col("dead_code") * 3).cast("long").alias("reliability"),
    )


def llm_guard(endpoints: DataFrame, findings: DataFrame) -> DataFrame:
    """endpoints(repo, sanitized), findings(repo, severity): percentage of sanitised endpoints, and 100 - 40, 20, 10 or 5 per finding."""
    cost = F.when(F.col("severity") == "critical", 40).when(F.col("severity") == "high", 20).when(F.col("severity") == "medium", 10).otherwise(5)
    lost = findings.groupBy("repo").agg(F.sum(cost).alias("_lost"))
    guarded = endpoints.groupBy("repo").agg(half_up(F.count_if("sanitized") / F.count("*") * 100).cast("long").alias("coverage"))
    joined = guarded.join(lost, "repo", "full")
    return joined.select("repo", F.coalesce("coverage", F.lit(100).cast("long")).alias("coverage"), F.greatest(F.lit(0), 100 - F.coalesce("_lost", F.lit(0))).cast("long").alias("score"))


def deploy_score(findings: DataFrame) -> DataFrame:
    """findings(repo, category, penalty) of docker, ci and env_vars: a score of each from 100 down, and their .4, .4, .2 mix before it is cut at 0."""
    raw = findings.groupBy("repo").agg(*[(100 - F.coalesce(F.sum(F.when(F.col("category") == c, F.col("penalty"))), F.lit(0))).alias(c) for c in ("docker", "ci", "env_vars")])
    mixed = F.greatest(F.lit(0), half_up(F.round(F.col("docker") * 0.4 + F.col("ci") * 0.4 + F.col("env_vars") * 0.2, 6)))
    return raw.select("repo", *[F.greatest(F.lit(0), F.col(c)).cast("long").alias(c) for c in ("docker", "ci", "env_vars")], mixed.cast("long").alias("score"))


def deploy_checks(files: DataFrame) -> DataFrame:
    """files(repo_id, path, content): a row per repository and check, and how many critical checks the repository fails."""
    text, path = F.col("content"), F.col("path")
    where = {"content": lambda p: text.rlike(p), "path": lambda p: path.rlike(p), "build": lambda p: path.rlike(BUILD_FILES) & text.rlike(p), "health": lambda p: text.rlike(p) & text.rlike(SERVED)}
    parts = [(k, i, where[kind](p)) for k, (_, _, needs) in enumerate(DEPLOYMENT) for i, (kind, p) in enumerate(needs)]
    any_file = files.groupBy("repo_id").agg(*[F.max(met).alias(f"_{k}_{i}") for k, i, met in parts])
    passed = [reduce(lambda a, b: a & b, (F.col(f"_{n}_{i}") for n, i, _ in parts if n == k)) for k in range(len(DEPLOYMENT))]
    failed = _total((~p).cast("long") for p, (_, severity, _) in zip(passed, DEPLOYMENT, strict=True) if severity == "critical")
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), p.alias("passed")) for p, (name, severity, _) in zip(passed, DEPLOYMENT, strict=True)])
    return any_file.select("repo_id", failed.alias("failed_critical"), F.explode(rows).alias("x")).select("repo_id", "x.*", "failed_critical")


def readiness(files: DataFrame, nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """files(repo_id, path, content), nodes(repo_id, type), scores(repo_id, score, critical, blockers): gates passed, progress and stage."""
    text, path = F.col("content"), F.col("path")
    any_file = {
        "migrations": path.rlike(MIGRATION_PATH),
        "models": path.rlike(MODEL_PATH[0]) & path.rlike(MODEL_PATH[1]),
        "validation": text.rlike(VALIDATION),
        "access": text.rlike(ACCESS),
        "errors": text.rlike(ERRORS),
        "tests": path.rlike(TEST_PATH) | text.rlike(TESTS),
        "ci": path.rlike(CI_PATH),
    }
    seen = files.groupBy("repo_id").agg(*[F.max(c).alias(n) for n, c in any_file.items()])
    types = {"dbquery": "queries", "sanitizer": "sanitizers", "auth_check": "checks", "try_catch": "catches"}
    graph = nodes.groupBy("repo_id").agg(*[F.max(F.col("type") == t).alias(n) for t, n in types.items()])
    joined = seen.join(graph, "repo_id", "left").na.fill(False, list(types.values())).join(scores, "repo_id", "left").na.fill(0, ["score", "critical", "blockers"])
    c = F.col
    gates = [c("migrations") & c("queries") & c("models"), c("validation") | c("sanitizers"), c("access") | c("checks"), c("errors") | c("catches"), c("tests"), c("ci")]
    counted = joined.withColumn("passed", _total(g.cast("long") for g in gates))
    stage = (
        F.when((c("passed") == 6) & (c("score") >= 85) & (c("blockers") == 0) & (c("critical") == 0), "enterprise")
        .when((c("passed") >= 5) & (c("score") >= 70) & (c("blockers") <= 1) & (c("critical") == 0), "market")
        .when((c("passed") >= 3) & (c("score") >= 55) & (c("critical") <= 1), "mvp")
        .otherwise("demo")
    )
    return counted.select("repo_id", "passed", half_up(c("passed") / 6 * 100).cast("long").alias("progress"), stage.alias("stage"))


def state_coverage(components: DataFrame) -> DataFrame:
    """components(repo_id, loading, error, empty, success, lacks_loading): how many have each state, how many fetch data, and the mean
    share of the four states."""
    states = ("loading", "error", "empty", "success")
    share = _total(F.col(s).cast("long") * 25 for s in states)
    fetches = F.count_if(F.col("loading") | F.col("error") | F.col("lacks_loading")).alias("fetching")
    return components.groupBy("repo_id").agg(F.count("*").alias("components"), fetches, *[F.count_if(s).alias(f"with_{s}") for s in states], half_up(F.avg(share)).cast("long").alias("coverage"))


def feature_truth(files: DataFrame) -> DataFrame:
    """files(repo_id, path, content): each user-interface file that is live, partly connected or mocked, with the confidence."""
    text, path = F.col("content"), F.col("path")
    server = path.contains("route") | path.contains("api") | path.contains("server")
    real = files.groupBy("repo_id").agg(F.max(server & text.rlike(r"(?i)(fetch|axios|prisma|drizzle|supabase|knex|mongodb)")).alias("real"))
    calls, state, form = text.rlike(r"fetch\s*\(|axios|useQuery|useSWR|useAxios"), text.rlike(r"useState|useReducer|Context|localStorage"), text.rlike(r"form|submit|handleSubmit")
    shown = files.filter(path.rlike(r"\.(tsx|jsx)$") & ~path.contains("node_modules")).join(real, "repo_id")
    status = F.when(F.col("real") & calls, "verified_live").when(calls, "partially_connected").when(form | state, "mocked")
    confidence = F.when(F.col("real") & calls, 90).when(calls, 70).when(form, 88).when(state, 75)
    return shown.select("repo_id", "path", status.alias("status"), confidence.alias("confidence")).filter("status IS NOT NULL")
