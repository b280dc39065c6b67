"""The index of required literals against all rules on all lines."""

import re

import pytest

from risklake.operators import rules
from risklake.operators.ruleindex import Slots, candidates, matches, required


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\beval\s*\(", [{"eval"}]),
        (r"(?:foo|barr)\s*=", [{"foo", "barr"}]),
        (r"[eE]xec(Sync)?\(", [{"exec"}]),
        (r"\w+\d", []),
        (r"(?:ab|\d+)x", []),
        (r"from\s+\"vm2", [{"from"}, {"\"vm2"}]),
        (r"(abc)+d{2,}efgh", [{"efgh"}, {"abc"}]),
        (r"(?=secret)token", [{"token"}]),
        (r"\p{L}+ token", []),
    ],
)
def test_required_literals(pattern, want):
    got = required(pattern)
    assert all(any(s <= g or s == g for g in map(set, got)) for s in want) and bool(got) == bool(want)


PATTERNS = [(r"\beval\s*\(",), (r"foo|bar",), (r"\d{4}",), (r"password\s*=\s*\"[^\"]+", r"pwd="), (r"from\s+\"vm2",), (r"^$",), (r"É+cole",)]
LINES = ["eval (x)", "EVAL(", "evaluate", "a foo", "", None, "in 2024 foo eval(", "password = \"x", "PWD=1", "from \"vm2\"", "vm2 from", "École", "fromage \"vm", "x" * 5000 + "eval("]


def test_matches_equal_every_rule_on_every_line(spark):
    slots = Slots.of(PATTERNS)
    assert slots.always == (2, 5)
    lines = spark.createDataFrame([(k, line) for k, line in enumerate(LINES)], "slot_id int, line string").repartition(3)
    got = sorted((r.slot_id, r.slot) for r in matches(lines, slots).collect())
    want = sorted((k, n) for k, line in enumerate(LINES) if line is not None for n, ps in enumerate(PATTERNS) if any(re.search(p, line, re.IGNORECASE) for p in ps))
    assert got == want


def test_candidates_follow_the_lines_and_not_the_rules(spark):
    few = rules.FAMILIES[0].rules()
    every = [r for f in rules.FAMILIES for r in f.rules()]
    assert len(every) + len(rules.PACK) >= 2000 and len({r.id for r in every}) == len(every)
    lines = spark.createDataFrame([(k, f"const v{k} = plain text of no rule {k}") for k in range(500)] + [(900, "exec(a, req.body)")], "n int, line string")
    for pack in (few, every):
        assert [(r.n, pack[r.slot].id) for r in candidates(lines, Slots.of([r.patterns for r in pack])).collect()] == [(900, "flow-exec-req.body")]


def test_context_exclude_and_cap(spark):
    rule = rules.Rule("near", "c", "high", (r"fetch\(",), (r"safe",), (r"router\.",))
    lines = [("a", n, "fetch(x)") for n in range(1, 60)] + [("a", 62, "router.get"), ("a", 63, "fetch(safe)"), ("b", 1, "fetch(x)"), ("c", 1, "router.x"), ("c", 31, "fetch(x)"), ("c", 32, "fetch(y)")]
    table = spark.createDataFrame(lines, "path string, line_no int, line string")
    got = sorted((r.path, r.line_no) for r in rules.pack_scan(table, ["path"], (rule,)).collect())
    assert got == [("a", n) for n in range(33, 53)] + [("c", 31)]


def test_catalogue_of_families_is_loaded_from_its_table(spark, tmp_path):
    rules.family_catalog(spark).write.parquet(str(tmp_path / "rules"))
    loaded = rules.load_rules(spark.read.parquet(str(tmp_path / "rules")), "module")
    assert len(loaded) == len(rules.FAMILIES[3].rules()) and loaded[0].cwe == ("CWE-1104",)


def test_words_end_at_letters_beyond_ascii(spark):
    """As in the rules' SQL; before, an accented letter was part of the word beside it."""
    rule = rules.Rule("cipher", "c", "high", (r"(?-i:\b(DES|RC4)\b)", r"x\\board"), (r"\bsafe\b",))
    texts = ["DESÈ", "ÀDES", "DES", "DESK", "un des", "DES éSAFEé", "DES unsafe", r"x\board"]
    table = spark.createDataFrame([("a", n, line) for n, line in enumerate(texts)], "path string, line_no int, line string")
    assert sorted(r.line_no for r in rules.pack_scan(table, ["path"], (rule,)).collect()) == [0, 1, 2, 6, 7]
