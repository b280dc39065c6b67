import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from risklake.llm import toxicity
from risklake.llm.wordhash import alphanumeric_table, text_groups
from tests.llm.data import documents, empty, sentence

BAD = ["vileword", "nastyword", "awfulword"]


def corpus(n=600):
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.3
        words = sentence(rng, rng.randrange(20, 80)).split()
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words) + "."))
        labels.append((k, int(bad) if rng.random() > 0.03 else int(not bad)))
    return docs, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    truth = dict(labels)
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = np.mean([(r["score"] >= 0.5) == (truth[r["doc_id"]] == 1) for r in held])
    assert len(held) > 80 and right > 0.9
    for r in out:
        for s in r["spans"]:
            assert any(b in r["text"][s["start_char"] : s["end_char"]] for b in BAD)
            assert r["text"].replace(".", "").split()[s["start_word"] : s["end_word"]] == r["text"][s["start_char"] : s["end_char"]].split()
    assert sum(len(r["spans"]) for r in out) > 100


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(k, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, t in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.head, b.head)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    moves, score = rng.normal(size=(2, 2)), rng.normal(size=5)
    found = toxicity.Chains(np.array([0]), np.array([5]), [])
    marginal, counts = toxicity.forward_backward(found, score, moves)
    total, at, pairs = 0.0, np.zeros(5), np.zeros((2, 2))
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        p = np.exp(sum(s for s, t in zip(score, y, strict=True) if t) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        at += p * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            pairs[a, b] += p
    assert np.allclose(marginal, at / total) and np.allclose(counts, pairs / total)


def test_chains_end_at_sentences_and_documents():
    texts = ["One two. Three four five\nsix", "seven " * 150, "", "eight! nine"]
    (_, _, words), *_ = text_groups(pa.array(texts), alphanumeric_table())
    found = toxicity.chains(words)
    spans = sorted(zip(found.starts.tolist(), found.lengths.tolist(), strict=True))
    assert [n for _, n in spans] == [2, 3, 1, 64, 64, 22, 1, 1] and sum(n for _, n in spans) == len(words)


def test_messy_rows_no_labels_and_empty(spark):
    docs = documents(spark, clash=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.filter("score >= 0.5").count() == 0
    marks = spark.createDataFrame([(k, k % 2) for k in range(4, 60)] + [(None, 1), (8, None), (9, 7), (11, 1), (11, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, marks), with_spans=False)
    assert scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.filter("score <> 'kept score'").count() == 0
