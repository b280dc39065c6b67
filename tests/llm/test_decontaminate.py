import random
import re

from pyspark.sql import functions as F

from risklake.llm import decontaminate as dc
from tests.llm.data import documents, empty, sentence

ITEM = "item_id long, text string"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    words, hit, found = tokens(text), set(), set()
    for item, said in items:
        target = tokens(said)
        n = min(10, len(target))
        grams = {tuple(target[k : k + n]) for k in range(len(target) - n + 1)} if target else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(item) if item is not None else "null")
    return len(words), len(hit), sorted(found)


def items(spark):
    texts = [r["text"] for r in documents(spark).filter("doc_id >= 11").orderBy("doc_id").collect()]
    return [(1, texts[0]), (2, texts[1].upper()), (2, texts[1]), (3, "MIT license!"), (4, None), (5, "..."), (None, texts[2]), (6, "one, TWO three")]


def test_a_joined_benchmark_gives_the_same_spans(spark):
    rng = random.Random(3)
    passages = [sentence(rng, 14) for _ in range(12)]
    rows = [(k, " ".join([sentence(rng, rng.randrange(0, 9)), rng.choice(passages), sentence(rng, 5), passages[0]])) for k in range(60)] + [(k, passages[k % 3] * 2) for k in range(60, 90)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(passages)), ITEM)
    both = [sorted(map(repr, dc.annotate(docs, bench, **way).collect())) for way in ({}, {"broadcast_bytes": 0})]
    assert both[0] == both[1] and len(both[0]) == 90


def test_matches_brute_force_in_one_part_and_in_many(spark):
    docs, bench = documents(spark, clash=True), items(spark)
    for way in ({"part_bytes": 4_000_000}, {"part_bytes": 100}, {"broadcast_bytes": 0}):
        found = dc.annotate(docs, spark.createDataFrame(bench, ITEM), **way)
        got = sorted((str(r["doc_id"]), r["n_words"], r["n"], r["items"]) for r in found.select("*", dc.hit_words(F.col("spans")).alias("n")).collect())
        assert got == sorted((str(r["doc_id"]), *brute(r["text"], bench)) for r in docs.collect())


def test_spans_are_cut_and_documents_dropped(spark):
    import random

    said = sentence(random.Random(1), 12)
    docs = spark.createDataFrame([(1, f"é before {said} after"), (2, "clean words only"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, said)], ITEM)
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {1: "é before  after", 2: "clean words only", 3: None}
    assert sorted(r["doc_id"] for r in dc.decontaminate(docs, bench).collect()) == [2, 3]


def test_clashing_columns_are_kept(spark):
    docs = documents(spark, clash=True)
    for remove in ("documents", "spans"):
        out = dc.decontaminate(docs, spark.createDataFrame(items(spark), ITEM), remove=remove)
        assert out.columns == docs.columns and out.filter("spans <> 'kept spans' OR items <> 'kept items' OR n_words <> 'kept n_words'").count() == 0


def test_empty(spark):
    bench = spark.createDataFrame(items(spark), ITEM)
    assert dc.annotate(empty(spark), bench).count() == 0
    none = dc.annotate(documents(spark), spark.createDataFrame([], ITEM))
    assert none.filter(F.size("spans") > 0).count() == 0 and none.count() == documents(spark).count()
