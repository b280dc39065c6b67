r"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once and keeps one row per document: the measurements and a long with one failure bit per
rule. Policies are versioned bit masks over the ledger, so a new policy, or what each rule costs, is bitwise work over
the ledger and never reads the texts again.

Cases. A null or empty text has no words: every count is 0 and it fails `few_words`. Rows that repeat whole are judged
each. An empty table gives an empty ledger. Columns of the input that bear one of the ledger's names are not read.
Repeated windows are found by their 64-bit hashes within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.common import SPACE, table

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeat_words(words: Column) -> Column:
    """Words in windows found twice or more. Equal hashes stand together after a sort; the places of repeated windows, sorted, each cover up to WINDOW words until the next one."""
    last = F.size(words) - WINDOW
    hashed = lambda i: F.struct(
        F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))).alias("hash"), i.alias("at")
    )
    return F.when(last >= 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), hashed)))


def _covered(places: Column) -> Column:
    reach = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and MEASURES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _repeat_words(F.col("words")).alias("sorted"),
    )
    same = lambda i, x: F.coalesce(F.get("sorted", i)["hash"] == x["hash"], F.lit(False))
    again = F.filter("sorted", lambda x, i: F.when(i > 0, same(i - 1, x)).otherwise(False) | same(i + 1, x))
    base = base.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(again, lambda x: x["at"])).alias("places"),
    )
    return base.select("doc_id", *MEASURES[:4], F.coalesce(_covered(F.col("places")), F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines")


#: The rules in the order of their bits; a rule's bit never changes, new rules are appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document fails if it fails any rule in `fatal`, or more than `tolerated` of those in `counted`."""

    version: int
    fatal: int
    counted: int = 0
    tolerated: int = 0


def mask(*names: str) -> int:
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in names)


BASE = mask("few_words", "repeated_words")
POLICIES = {
    1: Policy(1, fatal=BASE),
    2: Policy(2, fatal=BASE | mask("symbols"), counted=mask("duplicate_lines", "word_length"), tolerated=1),
}


def ledger(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the measurements and `failures`, the failure bits."""
    bits = (F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES))
    failures = F.lit(0).cast("long")
    for bit in bits:
        failures = failures.bitwiseOR(bit)
    return measured(docs).withColumn("failures", failures)


def save_ledger(entries: DataFrame, path: str) -> None:
    """Store a ledger; later policies and ablations read it and no text."""
    entries.write.mode("overwrite").parquet(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verdicts(entries: DataFrame, policies: dict[int, Policy] | None = None) -> DataFrame:
    """entries -> doc_id and a row per policy version with its verdict."""
    judged = [F.struct(F.lit(version).alias("version"), passes(policy).alias("kept")) for version, policy in (policies or POLICIES).items()]
    return entries.select("doc_id", F.explode(F.array(*judged)).alias("x")).select("doc_id", "x.*")


def passes(policy: Policy, failures: str = "failures") -> Column:
    met = F.col(failures).bitwiseAND(F.lit(policy.fatal).cast("long")) == 0
    if policy.counted:
        met &= F.bit_count(F.col(failures).bitwiseAND(F.lit(policy.counted).cast("long"))) <= policy.tolerated
    return met


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule: documents that fail it, that fail no other rule of the policy, and that the policy keeps without the
    rule. The ledger shrinks to one row per distinct mask first; the rules are a constant list."""
    masks = entries.groupBy("failures").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    used = policy.fatal | policy.counted
    rows = []
    for k, (name, _) in enumerate(RULES):
        bit = 1 << k
        fails = F.col("failures").bitwiseAND(F.lit(bit).cast("long")) != 0
        alone = F.col("failures").bitwiseAND(F.lit(used).cast("long")) == bit
        without = Policy(policy.version, policy.fatal & ~bit, policy.counted & ~bit, policy.tolerated)
        rows.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(fails, F.col("docs"))), F.lit(0)).alias("failing"),
                F.coalesce(F.sum(F.when(alone, F.col("docs"))), F.lit(0)).alias("failing_alone"),
                F.coalesce(F.sum(F.when(passes(without), F.col("docs"))), F.lit(0)).alias("kept_without"),
                F.coalesce(F.sum(F.when(passes(without), F.col("words"))), F.lit(0)).alias("words_kept_without"),
            )
        )
    return masks.agg(F.array(*rows).alias("rules")).select(F.lit(policy.version).alias("version"), F.inline("rules"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        *MEASURES[:5],
        (F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0).alias("base_failed"),
        passes(POLICIES[2]).alias("kept"),
        "failures",
    )


OP3_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS place, words FROM texts WHERE len(words) >= 5
), keyed AS (
  SELECT doc_id, place, array_to_string(words[place : place + 4], ' ') AS gram FROM grams
), repeated AS (
  SELECT doc_id, place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM keyed) WHERE times > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place + step) AS n FROM repeated, (SELECT unnest(range(0, 5)) AS step) GROUP BY doc_id
), measures AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id
), ledger AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END AS BIGINT) AS failures
  FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
  failures & 7 = 0 AND bit_count(failures & 24) <= 1 AS kept, failures
FROM ledger
"""
