"""Clone groups of long chains, and files of all kinds in similarity."""

import random

import pytest

from risklake.operators import similarity
from risklake.plans import corpus, insights
from risklake.plans.domain import Domain


def test_a_long_chain_is_one_group(spark):
    order = [(k * 37) % 101 for k in range(101)]
    pairs = spark.createDataFrame([*zip(order, order[1:], strict=False), (500, 501), (502, 501)], "id long, other long")
    got = {r["id"]: r["root"] for r in similarity.clone_groups(pairs).collect()}
    assert got == {k: 0 for k in range(101)} | {500: 500, 501: 500, 502: 500}
    assert similarity.clone_groups(pairs.limit(0)).count() == 0


def stored(spark, folder, documents, pages):
    spark.createDataFrame(documents, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return Domain(spark, str(folder))


def test_pages_are_compared_and_do_not_clash_with_documents(spark, tmp_path):
    text = "several words of a text that a page repeats whole"
    d = stored(spark, tmp_path, [(1, text, "a"), (1000000, "quite other tokens stand here alone", "b"), (0, None, "a")], [(0, text)])
    assert sorted(r["file_id"] for r in d.files.collect()) == [-1, 0, 1, 1000000]
    assert {frozenset((r["id"], r["other"])) for r in similarity.clone_pairs(corpus._signatures(d.files)).collect()} == {frozenset((1, -1))}


def test_patterns_are_matched_on_all_files(spark, tmp_path):
    d = stored(spark, tmp_path, [(1, "words of one", "a"), (1000000, "words of another", "b")], [(0, "words of a page")])
    assert sorted(r["id"] for r in insights._pattern_sigs(d).collect()) == [-1, 1, 1000000]


@pytest.mark.parametrize("block", [5, 2048])
def test_no_pair_above_the_threshold_is_missed(spark, block):
    """Bands that many signatures share are cut into blocks of five, or not at all."""
    rng = random.Random(4)
    base = [rng.randrange(10**6) for _ in range(64)]
    rows = [(0, base)]
    for k in range(1, 200):
        own = list(rng.choice(rows)[1])
        for at in rng.sample(range(64), rng.randrange(1, 26)):
            own[at] = rng.randrange(10**6)
        rows.append((k, own))
    got = {frozenset((r["id"], r["other"])) for r in similarity.clone_pairs(spark.createDataFrame(rows, "id long, signature array<long>"), 0.7, block).collect() if r["similarity"] < 1}
    near = {frozenset((a, b)) for a, x in rows for b, y in rows if a < b and x != y and sum(p == q for p, q in zip(x, y, strict=True)) >= 0.7 * 64}
    assert got == near and len(near) > 100


def test_files_are_signed_once_for_all_patterns(spark):
    """Once for all files and once for the few that the patterns are made of; before, each pattern signed all of them again."""
    plan = insights._matched(Domain(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Join Cross") == 1


def test_a_pattern_without_its_file_has_no_rows(spark, tmp_path):
    d = stored(spark, tmp_path, [(3, "words of a pattern", "a"), (4, "words of another one", "b")], [(0, "words of a page")])
    assert {r["pattern"] for r in insights._matched(d).collect()} == {"p4"}
