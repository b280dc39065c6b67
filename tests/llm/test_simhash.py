import random
import re

import numpy as np
import pytest
import xxhash

from risklake.llm import simhash
from risklake.llm.components import components
from tests.llm.data import documents, empty


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashed = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_groups(fps):
    label = list(range(len(fps)))
    array = np.array(fps, np.uint64)
    for _ in range(len(fps)):
        before = list(label)
        for k in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(array ^ array[k]) <= 4)
            least = min(label[int(j)] for j in near)
            for j in near:
                label[int(j)] = min(label[int(j)], least)
        if label == before:
            return label
    return label


def test_fingerprints_and_components_match_brute_force(spark):
    docs = documents(spark, clash=True)
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    label = brute_groups(fps)
    least = {}
    for r, root in zip(rows, label, strict=True):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    expected = sorted((str(r["doc_id"]), f & (2**64 - 1), least.get(root)) for r, f, root in zip(rows, fps, label, strict=True))
    got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


def test_codewords_are_those_within_distance_four():
    low, high, errors = simhash._golay()
    assert ((errors >= 0).sum(axis=1) == 6).sum() == 1771 and ((errors >= 0).sum(axis=1) == 1).sum() == 277


@pytest.mark.parametrize("bits", range(5))
def test_near_fingerprints_share_a_key(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(-(2**63), 2**63 - 1, 3000)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in a], np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    (ka, oa), (kb, ob) = simhash.fuzzy_keys(a), simhash.fuzzy_keys(b)
    keys = {}
    for k, o in zip(ka.tolist(), oa.tolist(), strict=True):
        keys.setdefault(o, set()).add(k)
    for k, o in zip(kb.tolist(), ob.tolist(), strict=True):
        keys.setdefault(("b", o), set()).add(k)
    assert all(keys[x] & keys[("b", y)] for x, y in zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("block", [3, 7, 2048])
def test_links_of_a_dense_group_in_blocks(spark, block):
    """One key with many fingerprints: cut into blocks, the groups stay those of all pairs."""
    rng = random.Random(block)
    fps = sorted({rng.getrandbits(6) | (rng.randrange(4) << 9) * (rng.random() < 0.7) | 0x1234_0000_0000_0000 for _ in range(120)} | {rng.getrandbits(63) for _ in range(40)})
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block)
    root = {r["node"]: r["root"] for r in components(found).collect()}
    label = brute_groups(fps)
    assert [root.get(f, f) for f in fps] == [fps[k] for k in label]


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = documents(spark, clash=True)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(g for g in groups if g is not None) and 4 in ids and 5 not in ids and ids.count(6) == 1


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.deduplicate(empty(spark)).count() == 0


def test_the_same_row_stays_however_the_table_is_dealt_out(spark):
    said = "some words that all six rows of this document say alike and nothing else at all"
    rows = [(1, said, "en", f"s{k}", k) for k in range(6)] + [(1, said, "en", "s3", 3), (2, said + " more", "en", "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {tuple(map(tuple, simhash.deduplicate(docs.orderBy(*order).repartition(n)).filter("doc_id = 1").collect())) for n, order in ((1, ["source"]), (5, ["n_chars"]), (3, ["lang"]), (2, ["doc_id"]))}
    assert len(kept) == 1 and len(next(iter(kept))) == 1
