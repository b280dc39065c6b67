import math
import random

import pytest
from pyspark.sql import functions as F

from risklake.llm.topk import scaled, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score string, qid int"


def brute(rows, k):
    kept = [(r[0], [math.floor(1024 * x) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, (q, a) in enumerate(kept):
        if q is None or q % 100:
            continue
        met = [(-sum(x * y for x, y in zip(a, b, strict=False)), v is None, v) for j, (v, b) in enumerate(kept) if j != i]
        out += [(q, n, v, -s) for n, (s, _, v) in enumerate(sorted(met, key=lambda m: (m[0], m[1], m[2] or 0))[:k], 1)]
    return sorted(map(repr, out))


def ask(spark, rows, k=10, **options):
    table = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA).repartition(3)
    got = top_k(scaled(table), F.col("vec_id") % 100 == 0, k, **options)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(repr(tuple(r)) for r in got.collect())


def eighths(rng, n):
    return [rng.randrange(-16, 17) / 8 for _ in range(n)]


@pytest.mark.parametrize(("groups", "depth"), [(2, 4), (3, 1), (1, 1), (9, 2)])
def test_equals_brute_force_with_ties_copies_and_messy_rows(spark, groups, depth):
    rng = random.Random(groups)
    rows = [(k, eighths(rng, 6)) for k in range(301)]
    rows += [(1000 + k, rows[7][1]) for k in range(40)] + [(500, rows[7][1])] * 3 + [(None, rows[7][1]), (None, eighths(rng, 6))]
    rows += [(600, None), (700, [1.0, None]), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (1100, []), (1200, [2.0]), (1300, eighths(rng, 6)), (1300, eighths(rng, 6)), (1301, [-0.0001] * 6)]
    assert ask(spark, rows, 5, groups=groups, depth=depth) == brute(rows, 5)


def test_few_rows_and_none(spark):
    assert ask(spark, [(100, [1.0, 2.0]), (3, [0.5, 0.5])]) == brute([(100, [1.0, 2.0]), (3, [0.5, 0.5])], 10)
    assert ask(spark, [(100, [1.0])]) == [] and ask(spark, []) == []


def test_scores_beyond_doubles_are_exact_and_beyond_longs_an_error(spark):
    rows = [(k, [float(2**21 + k), float(k)]) for k in range(0, 40, 4)] + [(100, [float(2**21 + 1), 3.0])]
    assert ask(spark, rows, 3) == brute(rows, 3)
    with pytest.raises(Exception, match="long"):
        ask(spark, [(100, [1e18, 1.0]), (101, [1e18, 1.0])])
