"""Exact top-k search by inner product: three-phase uniform threshold.

A vector's components are cut into m groups, each with a score list of its own per query: the inner products over that
group alone. A total is the sum of a vector's m local scores.

1. Each list gives its `depth` highest local scores. The totals of the vectors so found are computed, and the k-th highest
   of them is a cutoff t that no vector of the true top k is below.
2. The cutoff goes out with the queries. A vector whose local scores are all below t / m has a total below t, so each list
   gives just its entries of t / m or more. Totals known in full raise the cutoff; a vector whose known scores, with less
   than t / m for each list that did not give it, stay below the cutoff is dropped.
3. The totals of the vectors that remain are computed from whole vectors.

Lists are never made whole. Vectors and queries are packed into blocks; a task multiplies a block of the one with a block of
the other and keeps what its phase asks for. The stated queries meet all vectors in blocks; nothing is broadcast by hand or
sent to the driver, apart from the length of the longest vector.

Copies. Equal vectors are one class, searched once, with the k + 1 smallest ids of its rows, which is all that a top k can
name: ties go to the smaller id, and a query's own row is the one left out. The k + 1 best classes (by score, then smallest
id) hold the top k rows, so the phases look for k + 1 classes.

Cases. A vector that is null, or has a null, NaN or infinite component, takes no part. A shorter vector is as if filled up with
zeros. A null id is a candidate, after all others among ties, and never a query. Rows that repeat an id are rows of their own: each
is a query if its id is one, and its copies are candidates. Fewer than k candidates: all are returned. A total that a long
cannot hold is an error. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklake.llm.common import settle, settle_as_table, table

#: Groups of components, local scores that a list gives first for each of the k, rows of a block, queries multiplied at a time.
GROUPS = 2
DEPTH = 4
BLOCK = 4096
QUERY_BLOCK = 1024
SLICE = 256
#: Query blocks whose best scores a task keeps at a time, and a cutoff below any score.
HELD = 16
LOW = -(1 << 62)


def _pack(width: int, groups: int, rows: int):
    """Rows id, v, cutoff -> blocks of at most so many rows for each group of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("v")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                whole = np.zeros((part.num_rows, groups * -(-width // groups)), np.int64)
                column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                whole[np.repeat(np.arange(part.num_rows), sizes), column] = lists.flatten().to_numpy(zero_copy_only=False)
                ids, cutoffs = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("id", "cutoff"))
                cut = np.hsplit(whole, groups)
                made = [pa.array(list(range(groups)), pa.int32()), pa.array([ids] * groups, pa.binary()), pa.array([cutoffs] * groups, pa.binary()), pa.array([np.ascontiguousarray(x).tobytes() for x in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["part", "ids", "cutoffs", "block"])

    return run


def blocks(vectors: DataFrame, width: int, groups: int, rows: int) -> DataFrame:
    """vectors(id, v, cutoff) -> part (group of components), ids, cutoffs, block: packed longs."""
    return vectors.select("id", "v", "cutoff").mapInArrow(_pack(width, groups, rows), "part int, ids binary, cutoffs binary, block binary")


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with those of q, exact: as doubles where no sum can pass 2**53, else as longs."""
    bound = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    if bound < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if bound >= 1 << 63:
        raise OverflowError("an inner product may not fit a long")
    return x @ q.T


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Query block, its first query, its ids and cutoffs, the vectors' ids and the scores (vectors by queries), a slice at a time."""
    for batch in batches:
        names = ("q_ids", "q_cutoffs", "q_block", "ids", "block")
        for row in zip(*(batch.column(c) for c in names), strict=True):
            q_ids, cutoffs, q_block, ids, block = (np.frombuffer(v.as_py(), np.int64) for v in row)
            q, x = q_block.reshape(len(q_ids), -1), block.reshape(len(ids), -1)
            for at in range(0, len(q_ids), SLICE):
                upto = at + SLICE
                yield q_ids[at:upto], cutoffs[at:upto], ids, products(x, q[at:upto])


def _highest(part: int, depth: int):
    """For each query the depth highest local scores of what a task has seen of this list."""

    def rows(q_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        many = scores.shape[0]
        return pa.RecordBatch.from_arrays([pa.array(np.tile(q_ids, many)), pa.array(np.full(many * len(q_ids), part, np.int32)), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["qid", "part", "cid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for q_ids, _, ids, scores in _tiles(batches):
            key = q_ids.tobytes()
            named = np.broadcast_to(ids[:, None], scores.shape)
            if scores.shape[0] > depth:
                best = np.argpartition(scores, scores.shape[0] - depth, axis=0)[-depth:]
                scores, named = np.take_along_axis(scores, best, 0), np.take_along_axis(named, best, 0)
            if key in held:
                scores, named = np.concatenate([held[key][1], scores]), np.concatenate([held[key][2], named])
                if scores.shape[0] > depth:
                    best = np.argpartition(scores, scores.shape[0] - depth, axis=0)[-depth:]
                    scores, named = np.take_along_axis(scores, best, 0), np.take_along_axis(named, best, 0)
            held[key] = (q_ids, scores, np.ascontiguousarray(named))
            if len(held) > HELD * QUERY_BLOCK // SLICE:
                yield rows(*held.pop(next(iter(held))))
        for found in held.values():
            yield rows(*found)

    return run


def _sufficient(part: int, groups: int):
    """Local scores of a query's cutoff divided by the number of lists, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, cutoffs, ids, scores in _tiles(batches):
            # The least s with groups * s >= cutoff.
            row, column = np.nonzero(scores >= -(-cutoffs // groups)[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[column]), pa.array(np.full(len(row), part, np.int32)), pa.array(ids[row]), pa.array(scores[row, column])], names=["qid", "part", "cid", "score"])

    return run


LISTED = "qid long, part int, cid long, score long"


def _lists(packed: DataFrame, queries: DataFrame, groups: int, phase) -> DataFrame:
    """What each group's list gives in a phase: qid, part, cid, score."""
    ask = queries.select("part", F.col("ids").alias("q_ids"), F.col("cutoffs").alias("q_cutoffs"), F.col("block").alias("q_block"))
    found = None
    for part in range(groups):
        tiles = ask.filter(F.col("part") == part).drop("part").crossJoin(packed.filter(F.col("part") == part).select("ids", "block"))
        one = tiles.mapInArrow(phase(part), LISTED)
        found = one if found is None else found.unionByName(one)
    return found


def totals(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(qid, cid) -> with total, from whole vectors."""
    ours, theirs = classes.select(F.col("cid").alias("qid"), F.col("v").alias("_q")), classes.select("cid", F.col("v").alias("_x"))
    terms = F.zip_with("_q", "_x", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long")))
    return pairs.join(theirs, "cid").join(ours, "qid").withColumn("total", F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + x)).drop("_q", "_x")


def _kth(known: DataFrame, k: int) -> DataFrame:
    """known(qid, total) -> qid, least: the k-th highest total, if there are so many."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("total")))
    return known.select("qid", "total", place.alias("_place")).filter(F.col("_place") <= k).filter(F.col("_place") == k).select("qid", F.col("total").alias("least"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, groups: int = GROUPS, depth: int = DEPTH) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score for each row that is_query holds for. Vectors hold long components."""
    fit = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    rows = vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"), F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"), F.col("embedding").alias("v"))
    named = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"))
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("vec_id").asc_nulls_last()))
    least = rows.select("vec_id", "a", "b", "v", nth.alias("nth")).filter(F.col("nth") <= k + 1)
    least = least.groupBy("a", "b").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(named)).alias("ids"))
    classes = settle_as_table(least.select(F.monotonically_increasing_id().alias("cid"), "a", "b", "v", F.col("ids.id").alias("ids")), "classes")
    width = classes.agg(F.max(F.size("v"))).first()[0]
    asked = rows.filter(F.col("asks") & F.col("vec_id").isNotNull()).groupBy("vec_id", "a", "b").agg(F.count("*").alias("times"))
    asked = settle(asked.join(classes.select("a", "b", F.col("cid").alias("qid")), ["a", "b"]).select("qid", F.col("vec_id").alias("query_id"), "times"))
    width = max(width or 0, 1)
    groups = min(groups, width)

    no_cutoff = F.lit(LOW).cast("long").alias("cutoff")
    packed = settle_as_table(blocks(classes.select(F.col("cid").alias("id"), "v", no_cutoff), width, groups, BLOCK), "vectors")
    asking = settle_as_table(classes.join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select("cid", "v"), "queries")
    ask = blocks(asking.select(F.col("cid").alias("id"), "v", no_cutoff), width, groups, QUERY_BLOCK)

    first = _lists(packed, ask, groups, lambda part: _highest(part, depth * (k + 1)))
    place = F.row_number().over(Window.partitionBy("qid", "part").orderBy(F.desc("score"), "cid"))
    first = first.select("qid", "part", "cid", "score", place.alias("_place")).filter(F.col("_place") <= depth * (k + 1)).select("qid", "cid").distinct()
    cutoffs = settle(_kth(totals(first, classes), k + 1))

    cutoff = F.coalesce("least", F.lit(LOW)).cast("long")
    ask = blocks(asking.join(cutoffs.withColumnRenamed("qid", "cid"), "cid", "left").select(F.col("cid").alias("id"), "v", cutoff.alias("cutoff")), width, groups, QUERY_BLOCK)
    shares = _lists(packed, ask, groups, lambda part: _sufficient(part, groups)).groupBy("qid", "cid").agg(F.sum("score").alias("total"), F.count("*").alias("lists"))
    shares = settle(shares.join(cutoffs, "qid", "left").withColumn("least", cutoff))
    known = shares.filter(F.col("lists") == groups).select("qid", "cid", "total")
    better = _kth(known, k + 1).withColumnRenamed("least", "raised")
    unseen = F.lit(groups) - F.col("lists")
    highest = F.col("total") + unseen * F.expr(f"(least - 1) div {groups}")
    still = shares.filter(F.col("lists") < groups).join(better, "qid", "left").filter(highest >= F.greatest("least", F.coalesce("raised", "least")))
    scored = known.unionByName(totals(still.select("qid", "cid"), classes).select("qid", "cid", "total"))

    best = Window.partitionBy("qid").orderBy(F.desc("total"), F.get("ids", F.lit(0)).asc_nulls_last(), "cid")
    chosen = scored.join(classes.select("cid", "ids"), "cid").withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= k + 1)
    # A query is left out once among the rows of its own class.
    met = chosen.join(asked, "qid").withColumn("own", F.when(F.col("qid") == F.col("cid"), F.array_position("ids", F.col("query_id"))))
    met = met.select("qid", "query_id", "times", "total", "own", F.posexplode("ids").alias("at", "vec_id")).filter(~F.coalesce(F.col("own") == F.col("at") + 1, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("qid", "query_id", "times").orderBy(F.desc("total"), F.col("vec_id").asc_nulls_last()))
    met = met.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return met.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("total").alias("score"))


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, embedding with each component x as floor(scale * x), a long; null where x is null or not finite."""
    whole = F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.floor(x.cast("double") * float(scale))))
    return vectors.select("vec_id", whole.alias("embedding"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, 1 + greatest(len(q.e), len(c.e))), lambda i: coalesce(q.e[i] * c.e[i], 0))), 0) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scores)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
"""
