import hashlib
import random

import pytest
from pyspark.sql import functions as F

from risklake.llm import substring
from tests.llm.data import documents, empty, sentence

DOC = "doc_id long, text string"


def brute(rows):
    """rows of unique ids: (id, words, removed, digest)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((str(i), len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def run(spark, rows):
    marked = substring._marked(spark.createDataFrame(rows, DOC))
    out = marked.mapInArrow(substring._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect())


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [sentence(rng, rng.randrange(15, 70)) for _ in range(5)]
    rows = []
    for k in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 5))]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(k + 100, rows[k % 80][1]) for k in range(30)] + [(200, "a b " * 100), (201, "z " * 60), (202, None), (203, ""), (None, passages[0])]
    rows += [(300, " ".join(rows[0][1].split()[:-1] + ["changed"])), (301, "x " + rows[1][1])]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_small_batches_and_partitions(spark):
    """Runs of equal keys go on from one Arrow batch to the next."""
    rng = random.Random(5)
    shared = sentence(rng, 60)
    rows = [(k, f"{sentence(rng, 8)} {shared} {sentence(rng, 8)}") for k in range(150)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_factors_point_to_equal_earlier_words(spark):
    rng = random.Random(11)
    passages = [sentence(rng, rng.randrange(25, 300)) for _ in range(6)]
    rows = [(k, " ".join([sentence(rng, rng.randrange(1, 30)), *rng.sample(passages, 2), sentence(rng, 9)])) for k in range(40)]
    rows += [(50, passages[0]), (51, " ".join(passages[2].split()[5:24] + passages[3].split()[:40]))]
    docs = spark.createDataFrame(rows, DOC)
    by_key = {r["k"]: (r["doc_id"], r["text"].split()) for r in docs.select("*", F.xxhash64("doc_id", "text").alias("k")).collect()}
    found = substring.factors(docs).collect()
    covered = {}
    for r in found:
        (own, words), (other, theirs) = by_key[r["dkey"]], by_key[r["ref"]]
        assert other < own and r["length"] >= 20
        assert words[r["start"] : r["start"] + r["length"]] == theirs[r["ref_start"] : r["ref_start"] + r["length"]]
        covered.setdefault(own, set()).update(range(r["start"], r["start"] + r["length"]))
    assert max(r["length"] for r in found) > 150
    assert {i: len(covered.get(i, ())) for i, _ in rows} == {int(i): n for i, _, n, _ in brute(rows)}


def test_a_passage_over_several_references(spark):
    """Windows over a boundary between references that only a third document has whole, and a block with other words around it."""
    rng = random.Random(2)
    a, b, c = (sentence(rng, 90).split() for _ in range(3))
    rows = [(1, a), (2, b), (3, a[30:60] + b[10:50]), (4, c + a[30:60] + b[10:50]), (5, b[:45] + a[40:]), (6, a[:8] + c[5:30] + a[8:])]
    rows = [(k, " ".join(w)) for k, w in rows] + [(7, " ".join(c[40:] + a[52:60] + b[10:24] + c[:9])), (8, " ".join((a[:25] + ["x"]) * 3))]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_are_one_document(spark):
    text = sentence(random.Random(3), 40)
    got = run(spark, [(6, text), (6, text), (7, text)])
    assert [r[2] for r in got] == [0, 0, 40]


def test_repeats_are_removed_from_the_text(spark):
    docs = documents(spark, clash=True)
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert by_id[5]["text"] == "" and by_id[4]["text"] == texts[4] and by_id[1]["text"] is None
    assert len(by_id[9]["text"].split()) == 60


def test_empty(spark):
    assert substring.remove_repeats(empty(spark)).count() == 0
