import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from risklake.llm.alignment import FIRST, SECOND, TOKENIZERS, PieceTokens, _byte_letters, _loaded, align, links, scores, shared_cuts
from tests.llm import data

A = Tokenizer.from_file(f"{TOKENIZERS}/{FIRST}")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{SECOND}")
LETTERS = _byte_letters()


def tokens(text):
    """Ids and bytes by the libraries alone, whole texts; None where the bytes are not the text's."""
    if not text:
        return None
    e = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(LETTERS[c] for c in said)) for i, said in zip(e.ids, e.tokens, strict=True)]
    pieces = [(i, B.id_to_piece(i)) for i in B.encode(text)]
    b = [(i, bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in pieces]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def groups_of(a, b):
    ends_a, ends_b = (np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b))
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        out.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
        i, j = k, m
    return out


def brute(rows):
    held, found = Counter(), []
    for doc_id, text in rows:
        both = tokens(text)
        groups = groups_of(*both) if both else []
        linked = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(linked.keys())
        found.append((doc_id, groups, linked))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, groups, linked in found:
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        best = sum(n for k, n in linked.items() if held[k] == most[k[0]])
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), sum(linked.values()), best, sum(n * held[k] for k, n in linked.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(map(repr, out))


MESSY = ["<|endoftext|> and </s> <s> <unk>", "▁ literal", "a▁b", "two  spaces   three", "line\n next\n\n  more\t tab \t", " leading", "  leading", "trailing ", "trailing  ", "\n", " ", "é" * 300, "日本語のテキスト" * 40, "😀😀 👨‍👩‍👧 x", "x" * 30_000, "ab" * 12_000 + " " + "\n" * 500, "a\x00b \x00", " nbsp   　wide ", "it's we'll I'D 123 12a", "word  sep\x85 next\x0b v"]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("common", [1 << 19, 5, 0])
def test_equals_brute_force_with_and_without_common_pairs(spark, common):
    rows = [(r[0], r[1]) for r in data.rows()] + [(100 + k, t) for k, t in enumerate(MESSY)]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, pairs string, row int").repartition(3)
    got = scores(align(docs), len(PieceTokens(f"{TOKENIZERS}/{SECOND}").entries), common)
    assert sorted(repr(tuple(r)) for r in got.select(*COLUMNS).collect()) == brute(rows)


def test_no_documents(spark):
    assert scores(align(data.empty(spark)), 32_000).collect() == []


def test_pieces_give_the_tokens_of_whole_texts():
    pair, rng = _loaded(TOKENIZERS, FIRST, SECOND), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "a", "Word", "é", "日", "😀", "1", "23", "'s", "'", ".", ",,", "_", "-", "<s>", "́", "ß", "\x00", "\x1f", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(4000)] + MESSY
    for text, (a, b) in zip(texts, pair.tokens(texts), strict=True):
        assert np.frombuffer(a, np.int32).tolist() == A.encode(" " + text, add_special_tokens=False).ids, text
        assert np.frombuffer(b, np.int32).tolist() == B.encode(text) or "▁" in text, text


def test_quick_encoder_has_the_classes_of_the_exact_one():
    pair = _loaded(TOKENIZERS, FIRST, SECOND)
    points = [c for c in range(0x33480) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    texts = ["".join(f" a{chr(c)}1{chr(c)} {chr(c)}." for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    wrong = [t for t, x in zip(texts, A.encode_batch(texts, add_special_tokens=False), strict=True) if pair.first.quick.encode_ordinary(t) != x.ids]
    assert not wrong, [hex(ord(t[2])) for t in wrong]


def test_shared_cuts_on_random_ends():
    rng = np.random.default_rng(1)
    for _ in range(300):
        ends = [np.unique(np.append(rng.integers(1, 200, rng.integers(0, 80)), 200)) for _ in range(2)]
        full = [np.array([0]), np.array([len(ends[0]) - 1]), np.array([0]), np.array([len(ends[1]) - 1])]
        cut_a, cut_b = shared_cuts(*ends, *full)
        both = np.intersect1d(*ends)
        assert ends[0][cut_a].tolist() == ends[1][cut_b].tolist() == both.tolist()


def test_wide_groups_are_counted_by_distinct_ids():
    rng = np.random.default_rng(2)
    sizes = [np.array([40, 1, 300, 2]), np.array([30, 1, 200, 3])]
    a, b = rng.integers(0, 9, 343).astype(np.int32), rng.integers(0, 7, 234).astype(np.int32)
    who, pairs, times = links(a, b, *sizes, np.array([0, 0, 1, 1]), 7)
    want, i, j = Counter(), 0, 0
    for g, (n, m) in enumerate(zip(*map(list, sizes), strict=True)):
        want.update((g // 2, int(x) * 7 + int(y)) for x in a[i : i + n] for y in b[j : j + m])
        i, j = i + n, j + m
    assert dict(zip(zip(who.tolist(), pairs.tolist(), strict=True), times.tolist(), strict=True)) == want
