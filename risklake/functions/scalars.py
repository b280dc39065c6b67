"""Scalar expressions; each takes and returns Columns and stays inside generated code where Spark can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at a decimal place: halves go up, also below zero."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def effective_status(status: Column, score: Column) -> Column:
    return F.coalesce(status, F.when(score.isNotNull(), "completed").otherwise("pending"))


def is_completed(status: Column, score: Column) -> Column:
    return F.coalesce((status == "completed") | (status.isNull() & score.isNotNull()), F.lit(False))


def evidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 95, "Verified Exploit").when(confidence >= 85, "Verified Code Risk").when(confidence >= 70, "Likely Risk").otherwise("Advisory")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]", " "), " +", " "))


def title_key(title: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", "")), 1, 40)


def normalize_route(route: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(route, r"/:[A-Za-z0-9_]+", "/:id"), r"/[0-9]+", "/:id"))


def normalize_path(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(path, "[\"'`]", ""), "/+", "/")
    return F.lower(F.when(F.length(bare) > 1, F.regexp_replace(bare, "/$", "")).otherwise(bare))


def route_regex(path: Column) -> Column:
    return F.concat(F.lit("^"), F.regexp_replace(path, r":[A-Za-z0-9_]+|\{[A-Za-z0-9_]+\}|\[[A-Za-z0-9_]+\]", "([^/]+)"), F.lit("$"))


def semver(spec: Column) -> Column:
    """Three numbers; null where any part is not a number."""
    parts = F.split(F.regexp_replace(spec, r"^[\^~>=<\s]+", ""), r"\.")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    padded = F.slice(F.concat(numbers, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3)
    return F.when(~F.exists(numbers, lambda n: n.isNull()), padded)


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, 4 decimals: one pass over the distinct characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return F.when(n > 0, half_up(bits, 4)).otherwise(F.lit(0.0))


def char_classes(text: Column) -> Column:
    upper, lower, digit = (F.regexp_count(text, F.lit(p)) for p in ("[A-Z]", "[a-z]", "[0-9]"))
    special = F.regexp_count(text, F.lit(r"[!@#$%^&*()_+\-=\[\]{};':\"\\|,.<>/?`~]"))
    return F.struct(upper.alias("upper"), lower.alias("lower"), digit.alias("digit"), special.alias("special"), (F.length(text) - upper - lower - digit - special).alias("other"))


def diversity(text: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))) / F.length(text)


def secret_type(text: Column) -> Column:
    word = "[A-Za-z0-9_-]+"
    return (
        F.when(text.rlike(rf"^{word}\.{word}\.{word}$"), "jwt")
        .when(text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "uuid")
        .when(text.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(text) >= 20), "base64")
        .when(text.rlike("^[0-9a-fA-F]+$") & (F.length(text) >= 32), "hex")
        .when(text.rlike("^[A-Za-z0-9_-]{20,}$"), "alphanumeric_high_entropy")
        .when(text.rlike(f"^sk-{word}$"), "openai_key")
        .when(text.rlike(f"^ghp_{word}$"), "github_token")
        .when(text.rlike("^AKIA[A-Z0-9]{16}$"), "aws_access_key")
        .otherwise("unknown")
    )


def redact(text: Column) -> Column:
    return F.regexp_replace(text, r"([=:\s\"'`])([a-zA-Z0-9_\-+/]{6})[a-zA-Z0-9_\-+/]{6,}([a-zA-Z0-9_\-+/]{4})", r"$1$2●●●●●●$3")


def snippet(line: Column, most: int = 120) -> Column:
    bare = F.trim(line)
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("…"))).otherwise(bare)


def file_hint(evidence: Column) -> Column:
    path = F.regexp_extract(evidence, r"([a-zA-Z0-9_\-./]+\.(?:ts|js|jsx|tsx|py|go|rb|java|php|env|yaml|yml|json|sh))", 1)
    name = F.element_at(F.split(path, "/"), -1)
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    masked = F.when(F.length(stem) > 4, F.concat(F.substring(stem, 1, 3), F.repeat(F.lit("_"), F.least(F.lit(5), F.length(stem) - 3)), ext)).otherwise(name)
    hint = F.concat(F.regexp_replace(path, r"[^/]*$", ""), masked)
    return F.when(path != "", F.when(hint.startswith("/"), hint).otherwise(F.concat(F.lit("/"), hint)))


def purl(name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:npm/"), F.regexp_replace(name, "^@", "%40"), F.lit("@"), version)


def bom_ref(name: Column, version: Column) -> Column:
    return F.concat(F.regexp_replace(name, "[^A-Za-z0-9]", "-"), F.lit("-"), version)


def impact_label(amount: Column) -> Column:
    return (
        F.when(amount >= 100_000, F.concat(F.format_string("%.1f", amount / 100_000), F.lit("L")))
        .when(amount >= 1000, F.concat(half_up(amount / 1000).cast("string"), F.lit("K")))
        .otherwise(amount.cast("string"))
    )


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("ts", "tsx"), "typescript").when(ext.isin("js", "jsx"), "javascript").when(ext == "py", "python").when(ext == "go", "go").otherwise("unknown")


def normal_cdf(x: Column) -> Column:
    """Polynomial approximation of the standard normal distribution."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    series = F.lit(1.330274)
    for c in (-1.821256, 1.781478, -0.3565638, 0.3193815):
        series = series * t + c
    tail = 0.3989423 * F.exp(-x * x / 2) * t * series
    return F.when(x > 0, 1 - tail).otherwise(tail)


def option_value(price: Column, strike: Column, years: float, rate: float, volatility: float) -> Column:
    """Price of a European call; 0 where price or strike is."""
    spread = volatility * years**0.5
    d1 = (F.log(price / strike) + (rate + volatility * volatility / 2) * years) / spread
    value = price * normal_cdf(d1) - strike * F.exp(F.lit(-rate * years)) * normal_cdf(d1 - spread)
    return F.when((price > 0) & (strike > 0), value).otherwise(F.lit(0.0))


def hick_seconds(choices: Column) -> Column:
    return 0.15 + 0.19 * F.log2(choices + 1)


def cyclomatic(code: Column) -> Column:
    """One more than the branching tokens."""
    return F.regexp_count(code, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?")) + 1
