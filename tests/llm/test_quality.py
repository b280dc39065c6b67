import re
from collections import Counter

from risklake.llm import quality
from tests.llm.data import documents, empty


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_match_brute_force(spark):
    docs = documents(spark, clash=True)
    got = sorted((str(r["doc_id"]), *(r[m] for m in quality.MEASURES)) for r in quality.measured(docs).collect())
    assert got == sorted((str(r["doc_id"]), *brute(r["text"])) for r in docs.collect())


def test_policies_and_ablation(spark):
    entries = quality.ledger(documents(spark)).cache()
    rows = entries.collect()
    policy = quality.POLICIES[2]
    kept = entries.filter(quality.passes(policy)).count()
    by_hand = sum(r["failures"] & policy.fatal == 0 and bin(r["failures"] & policy.counted).count("1") <= policy.tolerated for r in rows)
    assert kept == by_hand and 0 < kept < len(rows)
    ablated = {r["rule"]: r for r in quality.ablation(entries, policy).collect()}
    assert set(ablated) == {name for name, _ in quality.RULES}
    assert ablated["few_words"]["failing"] == sum(r["n_words"] < 10 for r in rows)
    assert all(r["kept_without"] >= kept for r in ablated.values())
    assert quality.mask("few_words", "symbols") == 5


def test_a_stored_ledger_serves_every_policy(spark, tmp_path):
    entries = quality.ledger(documents(spark))
    quality.save_ledger(entries, str(tmp_path / "ledger"))
    stored = quality.load_ledger(spark, str(tmp_path / "ledger"))
    assert "text" not in stored.columns
    later = {**quality.POLICIES, 3: quality.Policy(3, fatal=quality.mask("few_words"), counted=quality.mask("symbols", "repeated_words"), tolerated=1)}
    kept = {v: sorted((str(r["doc_id"]), r["kept"]) for r in quality.verdicts(stored, later).filter(f"version = {v}").collect()) for v in later}
    for version, policy in later.items():
        by_hand = [(str(r["doc_id"]), r["failures"] & policy.fatal == 0 and (not policy.counted or bin(r["failures"] & policy.counted).count("1") <= policy.tolerated)) for r in entries.collect()]
        assert kept[version] == sorted(by_hand)
    assert sorted(map(tuple, quality.ablation(stored, later[3]).collect())) == sorted(map(tuple, quality.ablation(entries, later[3]).collect()))


def test_empty(spark):
    assert quality.ledger(empty(spark)).count() == 0
    assert all(r["failing"] == 0 for r in quality.ablation(quality.ledger(empty(spark)), quality.POLICIES[1]).collect())
