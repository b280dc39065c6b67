import random
import zlib
from collections import Counter

import pytest

from risklake.llm.spelling import near_pairs, thinned, variants, vocabulary
from tests.llm import data


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(counts, ratio=10):
    out, forms = [], {}
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, others in found.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, counts[w], len(found[w]), forms[w], counts.get(forms[w]), root))
    return sorted(map(repr, out))


def words(rng, n, letters, least, most):
    found = {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most + 1))) for _ in range(n)}
    for w in sorted(found)[:: 2]:
        k = rng.randrange(len(w))
        found |= {w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]} | ({w[:k] + w[k + 1 :]} if len(w) > least else set())
    return sorted(found)


@pytest.mark.parametrize(("letters", "least", "most", "stretch"), [("ab", 7, 11, 20_000), ("ab", 7, 9, 40), ("abcéÿ", 7, 12, 17), ("aé", 4, 7, 3), ("ab", 30, 60, 25)])
def test_pairs_equal_brute_force_however_ranges_are_cut(spark, letters, least, most, stretch):
    rng = random.Random(most + stretch)
    vocab = words(rng, 150, letters, least, most)
    table = spark.createDataFrame([(w, rng.choice([2, 5, 50, 600])) for w in vocab], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in near_pairs(table, least, stretch).collect()]
    assert Counter(got) == Counter((a, b) for i, a in enumerate(vocab) for b in vocab[i + 1 :] if near(a, b))


def test_forms_roots_and_ties(spark):
    counts = {"letters": 2000, "lettars": 150, "lettarz": 9, "lexters": 2000, "letterss": 200, "unrelated": 4, "lettersss": 20, "letterssss": 2}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(repr(tuple(r)) for r in variants(table).select("word", "n", "n_near", "form", "form_n", "root").collect()) == brute(counts)


def spelled(doc_id, word):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
    return low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low


def test_whole_query_on_messy_rows(spark):
    import re

    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["Mühlhausen", "mühlhausen", "constant", "konstant", "Constants", "ÀÉÎõøÿ×÷", "short", "constantinople"]) + rng.choice(["", ",", "1", "Ā"]) for _ in range(60)), "en", "s", 1) for k in range(40)]
    rows += data.rows() + [(None, "Constants constants constant", None, None, None), (70, "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000 + " " + "x" * 5001, "en", "a", 1)]
    said = Counter()
    for doc_id, text, *_ in rows:
        said.update(w for w in (spelled(doc_id, m) for m in re.findall("[A-Za-zÀ-ÿ]+", text or "")) if len(w) >= 7)
    docs = spark.createDataFrame(rows, data.DOCUMENT).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = variants(vocabulary(docs, thinned(F.col("doc_id"), F.col("word"))))
    assert sorted(repr(tuple(r)) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == brute({w: n for w, n in said.items() if n >= 2})


def test_no_documents(spark):
    assert variants(vocabulary(data.empty(spark))).collect() == []
