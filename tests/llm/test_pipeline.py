import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from risklake.llm import decontaminate, simhash, toxicity
from risklake.llm.common import table
from tests.llm.data import DOCUMENT, documents, rows
from tests.llm.test_decontaminate import ITEM, brute
from tests.llm.test_mixing import targets
from tests.llm.test_sharding import brute_deal
from tests.llm.test_simhash import brute_fingerprint, brute_groups

SF = "/root/testdata/sf0.001"
LABEL = "doc_id long, quality int, toxic int"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "toxicity":
            scored = toxicity.score(before, toxicity.fit(before, table(spark, SF, "labels")), with_spans=False)
            assert counts[-1] == scored.filter("score < 0.5").count()
        if name == "simhash_near_dedup":
            assert counts[-1] == simhash.near_duplicates(before).select("component_id").distinct().count()
        if name == "benchmark_decontamination":
            hit = decontaminate.annotate(before, table(spark, SF, "benchmark")).filter("size(spans) > 0").count()
            assert counts[-1] == counts[-2] - hit and hit > 0
    assert counts[0] > counts[1] > counts[2] > counts[3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == counts[-1] and set(columns) < set(out.columns)


def survivors(docs, items):
    """Near-dedup and decontamination in plain Python: all pairs of fingerprints, every window of every item."""
    label, least = brute_groups([brute_fingerprint(r["text"]) for r in docs]), {}
    for r, root in zip(docs, label, strict=True):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    return {r["doc_id"]: r for r in docs if r["doc_id"] in least.values() and not brute(r["text"], items)[1]}


def is_part(words, whole):
    rest = iter(whole)
    return all(w in rest for w in words)


def test_run_against_brute_force(spark):
    """The classifier's scores are given (its sums are tested by enumeration); what follows from them is worked out in plain Python."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels), with_spans=False).collect()}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    kept = survivors([r for r in docs.collect() if scores[r["doc_id"]] < 0.5], items)
    words = {k: (r["text"] or "").split() for k, r in kept.items()}

    out = corpus_pipeline.run(spark, SF).collect()
    sizes, taken, drawn = Counter(), Counter(), Counter()
    for k, r in kept.items():
        sizes[r["source"]] += len(words[k])
    for r in out:
        was = kept[r["doc_id"]]
        said = r["text"].split()
        assert (r["source"], r["lang"]) == (was["source"], was["lang"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == was["text"] or is_part(said, words[r["doc_id"]])
        taken[r["source"]] += len(said)
        drawn[r["doc_id"]] += len(said)
    assert all(n <= 3 * len(words[k]) for k, n in drawn.items())
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    for s, wanted in targets(sizes, {s: k % 3 + 1 for k, s in enumerate(order)}).items():
        assert abs(taken[s] - wanted) <= 0.02 * wanted + 64

    weights, slots = dict.fromkeys(range(4096), 0), defaultdict(list)
    for r in out:
        raw = r["text"].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        weights[r["virtual_slot"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    dealt = brute_deal(weights, 24)
    assert all(r["shard"] == dealt[r["virtual_slot"]] for r in out)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


@pytest.fixture
def folder(spark, tmp_path):
    """Writes the three tables that the stages read."""

    def write(docs, labels, items):
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, LABEL).write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame(items, ITEM).write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return write


def test_messy_rows_and_clashing_columns(spark, folder):
    docs = documents(spark, clash=True)
    labels = [(k, 1, int(k % 5 == 0)) for k in range(4, 60)] + [(None, None, 1), (5, None, None), (7, 0, 1), (7, 0, 1)]
    sf = folder(docs, labels, [(1, next(r[1] for r in rows() if r[0] == 12)), (2, None), (None, "")])
    out = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) <= set(out.columns) and out.select("shard").distinct().count() <= 24
    assert out.filter("doc_id = 12 OR doc_id = 5").count() == 0 and out.filter("text IS NULL").count() == 0


@pytest.mark.parametrize("some", [False, True])
def test_empty_tables(spark, folder, some):
    """No documents at all, or documents without a label or a benchmark item: then no document is toxic or contaminated."""
    docs = documents(spark) if some else spark.createDataFrame([], DOCUMENT)
    out = corpus_pipeline.run(spark, folder(docs, [], []))
    kept = {r["doc_id"] for r in out.collect()}
    assert (20 in kept) == some and set(DOCUMENT.replace(" long", "").replace(" string", "").split(", ")) <= set(out.columns)
