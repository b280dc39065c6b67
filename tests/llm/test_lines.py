import random

import numpy as np
import pytest

from risklake.llm import lines
from tests.llm.data import documents, empty

DOC = "doc_id long, text string"


def kept(spark, rows, **options):
    return {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(spark.createDataFrame(rows, DOC), **options).collect()}


def test_common_block_leaves_the_later_document(spark):
    block = "alpha one two three four\nbeta five six seven eight\ngamma nine ten"
    rows = [(1, f"first own line\n{block}\nend of one"), (2, f"{block}\nsecond own line"), (3, "third\n" + block.split("\n")[0]), (4, None), (5, "")]
    assert kept(spark, rows) == {1: rows[0][1], 2: "second own line", 3: rows[2][1], 4: None, 5: ""}


def test_moved_lines_are_not_aligned_across(spark):
    a, b, c, d = (f"line {x} with several words in it to be long enough" for x in "abcd")
    got = kept(spark, [(1, "\n".join([a, b, c, d])), (2, "\n".join([c, d, a, b]))], min_chars=10**6)
    assert got[2] in ("\n".join([a, b]), "\n".join([c, d]))


def test_frequent_passages_go_too(spark):
    block = "shared passage line one here\nshared passage line two here"
    rows = [(k, f"own line {k}\n{block}") for k in range(200)]
    got = kept(spark, rows)
    assert got[0] == rows[0][1] and all(got[k] == f"own line {k}" for k in range(1, 200))


def test_anchors_are_the_longest_increasing_sequence():
    a, b = np.array([1, 2, 3, 4, 5, 9, 9]), np.array([3, 1, 2, 5, 4, 9])
    path = lines._anchors(a, b, np.arange(7), np.arange(6))
    assert len(path) == 3 and all(x < y for x, y in zip(path, path[1:], strict=False)) and all(a[i] == b[j] for i, j in path)


def test_messy_rows_and_empty(spark):
    docs = documents(spark, clash=True)
    out = lines.deduplicate_lines(docs).collect()
    assert len(out) == docs.count()
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by_id[5]["n_deleted"] == 400 and by_id[5]["text"] == "" and by_id[4]["n_deleted"] == 0 and by_id[9]["n_deleted"] == 6 and by_id[1]["text"] is None
    assert [r["n_deleted"] for r in out if r["doc_id"] == 6] == [0, 0]
    assert lines.deduplicate_lines(empty(spark)).count() == 0


def test_overlaps_are_found_whoever_has_the_lines_first(spark):
    a, b, c = (f"line {x} with several words in it to be long enough" for x in "abc")
    rows = [(1, f"own one\n{a}"), (2, f"{b}\nown two"), (3, f"own\n{c}\nthree"), (5, f"five\n{a}\n{b}\n{c}"), (9, f"{a}\n{b}\n{c}\nnine")]
    assert kept(spark, rows, min_chars=10**6) == {**dict(rows), 9: "nine"}
    five = "\n".join(f"long line number {k} of the five that are shared here" for k in range(5))
    rows = [(1, f"one\n{five}\nbetween\n{five}"), (5, f"five\n{five}"), (9, f"{five}\nnine")]
    assert kept(spark, rows, min_chars=10**6)[9] == "nine"


def brute_deletions(rows, min_block, min_chars):
    """Places of a document's lines in a run of min_block lines, or in a line of min_chars, that an earlier document has."""
    out, before_runs, before_lines = {}, set(), set()
    for k, text in sorted(rows):
        said = text.split("\n")
        runs = [tuple(said[i : i + min_block]) for i in range(len(said) - min_block + 1)]
        gone = {i + j for i, run in enumerate(runs) if run in before_runs for j in range(min_block)}
        gone |= {i for i, line in enumerate(said) if len(line) >= min_chars and line in before_lines}
        out[k] = "\n".join(line for i, line in enumerate(said) if i not in gone)
        before_runs |= set(runs)
        before_lines |= set(said)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_deletions_match_brute_force(spark, seed):
    """Documents of whole blocks and parts of blocks in one order: no lines are missed and none are lost that no earlier document has."""
    rng = random.Random(seed)
    pool = [[f"block {b} line {i} says something " + "x" * rng.choice([0, 5, 70]) for i in range(rng.randrange(2, 7))] for b in range(12)]
    rows = []
    for k in range(70):
        said = [f"own line {k}"]
        blocks = rng.sample(range(12), rng.randrange(0, 5))
        # From the third seed on, blocks repeat within documents.
        for b in sorted(blocks + [b for b in blocks if seed > 2 and rng.random() < 0.5]):
            first = rng.randrange(0, 2) if rng.random() < 0.4 else 0
            said += pool[b][first : len(pool[b]) - (rng.randrange(0, 2) if rng.random() < 0.4 else 0)] + [f"own {k} after {b}"] * rng.randrange(0, 2)
        rows.append((k, "\n".join(said)))
    assert kept(spark, rows) == brute_deletions(rows, 2, 80)


def test_an_exact_copy_behind_partial_sources_ends_empty(spark):
    said = [f"line {k} of the copied text" for k in range(8)]
    text = "\n".join(said)
    rows = [(1, "own one\n" + "\n".join(said[::2])), (2, "own two\n" + "\n".join(said[1::2])), (3, text), (4, text), (5, "own five\n" + text + "\nown end")]
    got = kept(spark, rows, min_chars=10**6)
    assert got == {1: rows[0][1], 2: rows[1][1], 3: text, 4: "", 5: "own five\nown end"}


def test_repeated_lines_fill_the_blocks_around_them(spark):
    text = "\n".join(["start of it", "x x", "x x", "x x", "y y", "x x", "y y", "x x", "y y", "x x", "x x", "the middle", "x x", "y y", "x x", "y y"])
    rows = [(1, text), (2, text), (3, f"own three\n{text}\nown end"), (4, "x x\nx x"), (5, "x x\nx x")]
    got = kept(spark, rows, min_chars=10**6)
    assert got == {1: text, 2: "", 3: "own three\nown end", 4: "", 5: ""}


def test_a_long_line_counts_however_many_documents_have_it(spark):
    line = "z" * 100
    for n in (40, 92):
        rows = [(k, f"own line {k}\n{line}\nand own end {k}") for k in range(n)]
        got = kept(spark, rows)
        assert got[0] == rows[0][1] and all(got[k] == f"own line {k}\nand own end {k}" for k in range(1, n))


def test_blocks_that_repeat_on_either_side_go(spark):
    five = "\n".join(f"line number {k} of five" for k in range(5))
    rows = [(1, f"one\n{five}\nbetween\n{five}"), (9, f"{five}\nnine")]
    assert kept(spark, rows) == {1: rows[0][1], 9: "nine"}
    rows = [(1, f"one\n{five}"), (9, f"{five}\nnine\n{five}")]
    assert kept(spark, rows) == {1: rows[0][1], 9: "nine"}
    rows = [(1, f"{five}\none\n{five}"), (9, f"{five}\nnine\n{five}\nand\n{five}\nmore\n{five}\nend")]
    assert kept(spark, rows) == {1: rows[0][1], 9: "nine\nand\nmore\nend"}
