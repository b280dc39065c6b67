from collections import defaultdict

from pyspark.sql import functions as F

from risklake.llm import mixing
from tests.llm.data import CLASHES, documents, empty


def targets(sizes, weights, most=3):
    """Water-filling, step by step."""
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in stopped}
        left = total - sum(stopped.values())
        level = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s for s in rest if level[s] > most * sizes[s]}
        if not over:
            return {**level, **stopped}
        stopped |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(k, f"s{k % 6}" if k % 7 else None, (k * 37) % 400 if k % 6 else 3) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(docs, mixing.cyclic_weights(), shard_tokens=20_000).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    expected = targets(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6 * (1 + expected[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 0.02 * expected[s] + 128
    again = mixing.mix(docs, mixing.cyclic_weights(), shard_tokens=20_000).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_sainte_lague_deals_by_highest_quotients(spark):
    votes = [53_000, 24_000, 23_000, 100]
    total, seats = sum(votes), 77
    claims = spark.createDataFrame([(k, v, v * seats / total) for k, v in enumerate(votes)], "party int, votes long, share double")
    got = {r["party"]: r["quota"] for r in mixing.sainte_lague(claims, [], "share", F.lit(seats), "party").collect()}
    assert got == highest_quotients(votes, seats)


def highest_quotients(votes, seats):
    quotients = sorted(((v / (2 * k + 1), -p) for p, v in enumerate(votes) for k in range(seats)), reverse=True)[:seats]
    return {p: sum(-q == p for _, q in quotients) for p in range(len(votes))}


def test_sainte_lague_far_from_rounded_shares(spark):
    """Sixty small claims that all round up cost the large one more seats than any fixed slack."""
    votes = [200_000] + [130] * 60
    total, seats = sum(votes), 960
    claims = spark.createDataFrame([(k, v * seats / total) for k, v in enumerate(votes)], "party int, share double")
    got = {r["party"]: r["quota"] for r in mixing.sainte_lague(claims, [], "share", F.lit(seats), "party").collect()}
    assert got == highest_quotients(votes, seats)


def test_a_tree_of_shards_deals_all_seats(spark):
    shards = [(s, k, 500 + (k * 7919 + s) % 900) for s in range(2) for k in range(90) if k % 5]
    sizes = {s: sum(n for t, _, n in shards if t == s) for s in range(2)}
    pools = spark.createDataFrame(shards, "source_no int, _shard int, _pool long")
    quotas = spark.createDataFrame([(0, sizes[0], 1999), (1, sizes[1], 5)], "source_no int, source_size long, quota long")
    got = mixing.shard_quotas(pools, quotas, n_shards=90, fan_out=4).collect()
    assert sorted((r["source_no"], r["_shard"], r["_pool"]) for r in got) == sorted(shards)
    assert [sum(r["quota"] for r in got if r["source_no"] == s) for s in range(2)] == [1999, 5]
    assert all(abs(r["quota"] - 1999 * r["_pool"] / sizes[0]) < 3 for r in got if r["source_no"] == 0)


def test_mixed_documents_hold_what_was_taken(spark):
    docs = documents(spark, clash=True)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text"))), mixing.cyclic_weights()).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["taken"]
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and r["size"] == "kept size"
    assert dict(got) == {k: n for k, n in words.items() if n}


def test_small_sources_reach_their_targets(spark):
    rows = [(1, "a", 20), (2, "b", 900), (3, "b", 400)] + [(10 + k, "c", 5) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(docs, mixing.cyclic_weights()).collect()
    for s in "abc":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.03 * own[0]["target"] + 1


def test_repeated_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(7, "a", 40)] * 3000 + [(k, "b", 40) for k in range(3000)], "doc_id long, source string, size long")
    out = mixing.mix(docs, mixing.cyclic_weights(), shard_tokens=10_000).collect()
    assert len(out) == 6000
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] and all(r["taken"] <= 120 for r in own)


def test_messy_rows_and_empty(spark):
    docs = documents(spark, clash=True).withColumn("size", mixing.word_count(F.col("text")))
    out = mixing.mix(docs, mixing.cyclic_weights())
    assert out.count() == docs.count() and set(CLASHES) <= set(out.columns)
    assert mixing.mixed_documents(empty(spark)).count() == 0
    nothing = empty(spark).select("doc_id", "source", F.lit(0).cast("long").alias("size"))
    assert mixing.mix(nothing, mixing.cyclic_weights()).count() == 0
    blank = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "doc_id long, source string, size long")
    assert [r["taken"] for r in mixing.mix(blank, mixing.cyclic_weights()).collect()] == [0, 0]
