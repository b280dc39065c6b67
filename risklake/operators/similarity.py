"""MinHash signatures, clone pairs and groups, Merkle roots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.sources.lineage import cut

PERMUTATIONS = 64
#: The permutations' modulus, a prime above 2 ** 32; fixed.
PRIME = 4_294_967_311
#: Signatures of one band that a task compares with each other; more are cut into blocks.
BLOCK = 2048


#: Token hashes that a task keeps.
KEPT_TOKENS = 1_000_000


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows tokens (distinct), id, ... -> id, ..., signature; rows without tokens go."""
    kept: dict[str, int] = {}
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("tokens")), 0))
        lists = batch.column("tokens")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(sizes):
            continue
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(kept) > KEPT_TOKENS:
            kept.clear()
        for w in words:
            if w not in kept:
                kept[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
        hashes = np.fromiter((kept[w] for w in words), np.int64, len(words))
        # Each permutation is worked out once for each distinct token of the batch.
        at, starts = coded.indices.to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        made = np.empty((len(sizes), PERMUTATIONS), np.int64)
        for i in range(PERMUTATIONS):
            made[:, i] = np.minimum.reduceat(((hashes * (i * 12345 + 67890) + (i * 54321 + 9876)) % PRIME)[at], starts)
        rest = batch.drop_columns(["tokens"])
        signature = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * PERMUTATIONS, pa.int32()), pa.array(made.ravel()))
        yield pa.RecordBatch.from_arrays([*rest.columns, signature], names=[*rest.schema.names, "signature"])


def signatures(docs: DataFrame, tokens: Column, *others: str) -> DataFrame:
    """docs(id, ...), a row per document -> id, signature, and the other columns that are named: the smallest value of each permutation over the
    distinct tokens' hashes; documents without tokens have none. Factors stay below 2 ** 53. No row leaves its task: the minima come from each
    row's own tokens. Nothing is pushed down through it: ask for some documents before, not after."""
    listed = docs.select(F.array_distinct(tokens).alias("tokens"), "id", *others)
    made = listed.mapInArrow(_minima, T.StructType([*listed.schema.fields[1:], T.StructField("signature", T.ArrayType(T.LongType()))]))
    return made.select("id", "signature", *others)


def _sketch(word: int) -> Column:
    """The lowest four bits of 16 of a signature's places, in a long."""
    bits = [F.shiftleft(F.get("signature", F.lit(16 * word + k)).bitwiseAND(F.lit(15).cast("long")), 4 * k) for k in range(16)]
    return reduce(Column.bitwiseOR, bits)


def _unlike(a: Column, b: Column) -> Column:
    """Places of two sketch words that differ."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111_1111_1111_1111)))


def clone_pairs(sigs: DataFrame, threshold: float = 0.7, block: int = BLOCK) -> DataFrame:
    """Pairs of distinct signatures with at least `threshold` equal places. A pair may differ in as many places as the rest, so one
    of that many bands and one more is equal in both: the fewest and widest bands that miss no pair. Equal signatures
    are one node: they pair through their first id, not with each other. A band with more than `block` signatures is cut into
    blocks by a hash of the id, and each two blocks meet under a key of their own, so no task has all of a band's pairs. Four bits of
    every place travel with a band: equal places have equal bits, so pairs with too many unlike ones are no candidates."""
    sigs = cut(sigs)
    distinct = sigs.groupBy("signature").agg(F.min("id").alias("id"))
    n = int(round(PERMUTATIONS * (1 - threshold), 6)) + 1
    ends = [PERMUTATIONS * k // n for k in range(n + 1)]
    keys = [F.xxhash64(F.slice("signature", a + 1, b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    words = [f"_s{k}" for k in range(PERMUTATIONS // 16)]
    bands = distinct.select("id", *[_sketch(k).alias(w) for k, w in enumerate(words)], F.posexplode(F.array(*keys)).alias("band", "key"))
    keyed = bands.select("id", *words, F.xxhash64("band", "key").alias("key"))
    shared = keyed.groupBy("key").agg(F.ceil(F.count("*") / block).alias("_blocks"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    dealt = keyed.join(shared, "key").withColumn("_own", F.pmod(F.xxhash64("id"), "_blocks")).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = cut(dealt.select("id", F.xxhash64("key", F.least("_own", "_with"), F.greatest("_own", "_with")).alias("key"), "_own", (F.col("_own") == F.col("_with")).alias("_inner"), *words))
    others = dealt.select(F.col("id").alias("other"), "key", F.col("_own").alias("_other"), *[F.col(w).alias(f"_o{w}") for w in words])
    unlike = reduce(Column.__add__, (_unlike(F.col(w), F.col(f"_o{w}")) for w in words))
    near = (F.col("id") < F.col("other")) & (F.col("_inner") | (F.col("_own") != F.col("_other"))) & (unlike < n)
    met = dealt.join(others, "key").filter(near).select("id", "other").distinct()
    joined = met.join(distinct.withColumnRenamed("signature", "_a"), "id").join(distinct.select(F.col("id").alias("other"), F.col("signature").alias("_b")), "other")
    same = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
    near = joined.select("id", "other", (same / PERMUTATIONS).alias("similarity")).filter(F.col("similarity") >= threshold)
    copies = sigs.join(distinct.select(F.col("id").alias("_first"), "signature"), "signature").filter("id <> _first").select(F.col("_first").alias("id"), F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    kind = F.when(F.col("similarity") >= 0.95, "identical").when(F.col("similarity") >= 0.85, "near-clone").when(F.col("similarity") >= 0.65, "type-3").otherwise("type-4")
    return near.unionByName(copies).withColumn("kind", kind)


def clone_groups(pairs: DataFrame) -> DataFrame:
    """Connected groups of pairs: every id with the smallest one it can reach. Alternating star contractions until nothing changes;
    rounds grow with the logarithm of the longest chain."""
    edges = cut(pairs.filter("id <> other").select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("root")).distinct())
    total = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("id"), F.col("id").alias("root")))
        least = both.groupBy("id").agg(F.least(F.min("root"), F.min("id")).alias("_least"))
        large = both.join(least, "id").filter("root > id").select(F.col("root").alias("id"), F.col("_least").alias("root")).distinct()
        least = large.groupBy("id").agg(F.min("root").alias("_least"))
        small = large.join(least, "id").filter("root <> _least").select(F.col("root").alias("id"), F.col("_least").alias("root"))
        edges = cut(small.unionByName(least.select("id", F.col("_least").alias("root"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first()
        if now == total:
            break
        total = now
    return edges.unionByName(edges.select(F.col("root").alias("id"), "root").distinct())


def merkle_roots(lines: DataFrame, max_levels: int = 60) -> DataFrame:
    """lines(repo_id, path, line_no, line): per repository the root over all lines with text, in order of path and number; an odd last
    node pairs with itself. A level is one aggregate by position div 2, so the loop runs log2 of the longest repository."""
    bare = F.trim(F.regexp_replace("line", r"\s+", " "))
    leaves = lines.withColumn("_bare", bare).filter(F.col("_bare") != "")
    hashed = leaves.select("repo_id", "path", "line_no", F.sha2(F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(":"), F.col("_bare")), 256).alias("hash"))
    per_path = hashed.groupBy("repo_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "hash"))), lambda x: x["hash"]).alias("hashes"))
    w = F.sum(F.size("hashes"))
    start = F.coalesce(w.over(Window.partitionBy("repo_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = cut(per_path.withColumn("_start", start).select("repo_id", F.posexplode("hashes").alias("_k", "hash"), "_start").select("repo_id", (F.col("_start") + F.col("_k")).alias("pos"), "hash"))
    count = level.groupBy("repo_id").agg(F.count("*").alias("leaves"))
    for _ in range(max_levels):
        if level.filter("pos > 0").isEmpty():
            break
        up = level.groupBy("repo_id", F.floor(F.col("pos") / 2).alias("pos")).agg(F.min_by("hash", "pos").alias("_l"), F.max_by("hash", "pos").alias("_r"))
        sizes = level.groupBy("repo_id").agg(F.count("*").alias("_size"))
        level = cut(up.join(sizes, "repo_id").select("repo_id", "pos", F.when(F.col("_size") == 1, F.col("_l")).otherwise(F.sha2(F.concat("_l", "_r"), 256)).alias("hash")))
    return level.join(count, "repo_id").select("repo_id", F.col("hash").alias("root"), "leaves")


def shape_hash(nodes: DataFrame) -> DataFrame:
    """nodes(repo, id, type, degree): hash of the sorted type:degree words."""
    words = F.array_sort(F.collect_list(F.concat("type", F.lit(":"), F.col("degree").cast("string"))))
    return nodes.groupBy("repo").agg(F.substring(F.sha2(F.array_join(words, "|"), 256), 1, 16).alias("shape"))
