"""Isolation of rules at run time, and containment by rare grams against all pairs."""

import random

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from risklake import registry as risklake_registry
from risklake.operators import insights, joins

LINES = [("a.ts", 1, "eval(x)"), ("a.ts", 2, "fine"), ("b.ts", 1, "eval(y)"), ("b.ts", 2, None)]


def ids_of(found):
    return sorted((r["rule"], r["category"], r["path"] or "", r["line_no"] or 0, r["severity"]) for r in found.collect())


WANT = [("bad", "c", "", 0, "info"), ("ok", "c", "a.ts", 1, "high"), ("ok", "c", "b.ts", 1, "high")]


def test_a_rule_that_fails_in_a_task_takes_no_other_with_it(spark):
    lines = spark.createDataFrame(LINES, "path string, line_no int, line string").repartition(2)
    registry = insights.RuleRegistry()
    registry.register("ok", "c", lambda df: df.filter(F.col("line").contains("eval")).withColumn("severity", F.lit("high")))
    registry.register("bad", "c", lambda df: df.withColumn("severity", F.when(F.col("line_no") > 1, F.raise_error(F.lit("no"))).otherwise("high")))
    assert ids_of(registry.run(lines)) == WANT


@pytest.mark.parametrize("bad", [lambda b: 1 // 0, lambda b: [True], lambda b: b.column("nothing"), lambda b: [x.as_py() == "fine" and 1 // 0 for x in b.column("line")], lambda b: ["x"] * b.num_rows])
def test_masks_are_isolated_within_one_pass(spark, bad):
    lines = spark.createDataFrame(LINES, "path string, line_no int, line string").repartition(2)
    registry = insights.RuleRegistry()
    registry.register_mask("ok", "c", "high", lambda b: pc.match_substring(b.column("line"), "eval"))
    registry.register_mask("bad", "c", "low", bad)
    registry.register_mask("other", "d", "low", lambda b: 1 // 0)
    assert ids_of(registry.run(lines, category="c")) == WANT
    assert ids_of(registry.run(lines, ids=["ok"])) == WANT[1:] and registry.run(lines, ids=[]).count() == 0


def test_containment_by_rare_grams_equals_all_pairs(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("/ab") for _ in range(n))
    parts, wholes = [[word(rng.randrange(0, 7)) for _ in range(60)] + [None, "", "/x/very/rare"] for _ in range(2)]
    wholes += ["/" + "ab" * 300, "pre/x/very/rare/post"]
    frame = lambda rows: spark.createDataFrame([(r, 1) for r in rows], "path string, part int")
    got = sorted(map(tuple, joins.within(frame(parts), frame(wholes)).collect()))
    assert got == sorted({(p, w) for p in parts for w in wholes if p and w and p in w})


def test_index_rows_follow_the_length_of_a_path(spark):
    frame = spark.createDataFrame([("/" + "abcdefghij" * 40,)], "path string")
    assert frame.select(F.explode(joins._grams(F.col("path"), F.lit(3)))).count() <= 401


def test_genome_counts_phrases_and_the_topology_is_of_degrees_alone(spark):
    files = spark.createDataFrame([("a", "if (x) " + "try { await db " * 2 + "y" * 300), ("a", None), ("b", ""), ("c", "plain" * 20)], "repo_id string, content string")
    entropy = spark.createDataFrame([(0.5,)], "entropy double")
    degrees = lambda rows: insights.topology(spark.createDataFrame([(k,) for k in rows], "out_degree long"))
    got = {r["repo_id"]: r for r in insights.genome(files, entropy, degrees([1, 2, 2])).collect()}
    assert got["a"]["boilerplate"] == 1.0 and got["b"]["boilerplate"] == got["c"]["boilerplate"] == 0.0 and got["a"]["decay"] == "degrading" and got["c"]["days_left"] == 365
    one = lambda df: df.first()["topology"]
    assert one(degrees([2, 1, 2])) == one(degrees([1, 2, 2])) != one(degrees([1, 1, 2])) and len(one(degrees([]))) == 16


def test_files_are_not_sent_through_the_driver(spark):
    """Before, the paths of all files were broadcast, since Spark took them for few bytes."""
    df = risklake_registry.queries()["gr_module_edges"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
