r"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes of the text's 4-word shingles. Two
fingerprints link at 4 or fewer differing bits.

Candidates. The fingerprint is cut into three segments (22, 21, 21 bits). With 4 errors or fewer, either some segment has
none, and the two share that segment, or two segments have exactly one error each. A segment, padded to the 23 bits of
the perfect Golay code, is decoded to the codewords within distance 4: one (its nearest) or six. If two segments differ
in one bit, the nearest codeword of each is among those of the other. So a fingerprint gets the pairs (codewords of
one segment, nearest of the other) and (nearest, codewords), for each two segments.
Pigeonholes make the keys selective: beside a segment without errors the other 42 or 43 bits have at most 4, so one of five
pieces of them is equal; beside two segments with one error each, the third has at most 2, so one of three pieces is. A key is
a segment or a pair of codewords, and such a piece: about 110 keys of 29 to 32 bits, and any linked pair meets at one of them.

Equal fingerprints are grouped before; only distinct ones get keys. Rows with one key stand together after a shuffle and
sort, and a task finds the linked groups of each key's fingerprints by comparing them in blocks: it emits a link from
each member to its group's smallest, never all pairs. A key with more than BLOCK fingerprints is cut into blocks, and its
pairs of blocks are dealt out to tasks in a second step, so no fingerprint is left uncompared.

Cases. A text of fewer than 4 words is one shingle; without words (or null) its fingerprint is zero and links like any
other. Rows that repeat whole get the same result. Null ids count only where a group has no other. An empty table gives
no rows. Other columns are not read by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.common import row_key, settle, table
from risklake.llm.components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the binary Golay code of length 23.
GOLAY = 0b110001110101
BLOCK = 2048
HASHES_AT_ONCE = 65_536


def fingerprint(text: str | None) -> int:
    """Signed 64-bit integer with the fingerprint's bits. bytes.lower() and bytes.split() know only ASCII, as the word pattern does."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        hashed = [digest(b" ".join(words), SEED)]
    else:
        hashed = [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(SHINGLE)), strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashed), HASHES_AT_ONCE):
        block = np.frombuffer(b"".join(hashed[at : at + HASHES_AT_ONCE]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashed))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash (of the whole text), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = pa.array((fingerprint(x.as_py()) for x in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and each syndrome's error patterns: the nearest codeword's first, -1 for none."""

    def syndrome(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GOLAY << (k - 11)
        return v

    low = np.array([syndrome(v) for v in range(1 << 12)], np.int64)
    high = np.array([syndrome(v << 12) for v in range(1 << 11)], np.int64)
    errors = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            errors[low[e & 0xFFF] ^ high[e >> 12]].append(e)
    table_of = np.full((1 << 11, 6), -1, np.int64)
    for s, found in enumerate(errors):
        table_of[s, : len(found)] = found
    return low, high, table_of


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each segment, the nearest first; -1 for none."""
    low, high, errors = _golay()
    found = errors[low[segment & 0xFFF] ^ high[segment >> 12]]
    return np.where(found >= 0, (segment[:, None] ^ found) >> 11, -1)


def _bits(u: np.ndarray, at: int, width: int) -> np.ndarray:
    return ((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _pieces(value: np.ndarray, width: int, n: int) -> list[np.ndarray]:
    """value, of width bits, cut into n pieces."""
    cuts = [width * k // n for k in range(n + 1)]
    return [_bits(value.view(np.uint64), a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the fingerprint of each."""
    u = fps.view(np.uint64)
    parts = [_bits(u, at, width) for at, width in SEGMENTS]
    widths = [width for _, width in SEGMENTS]
    keys, owners, kind = [], [], 0
    for k, part in enumerate(parts):
        i, j = (x for x in range(3) if x != k)
        for piece in _pieces(parts[i] | parts[j] << widths[i], widths[i] + widths[j], MAX_BITS + 1):
            keys.append(kind << 40 | piece << 24 | part)
            owners.append(fps)
            kind += 1
    coded = [codewords(part) for part in parts]
    for a, b in combinations(range(3), 2):
        third = 3 - a - b
        pieces = _pieces(parts[third], widths[third], MAX_BITS - 1)
        for one in range(6):
            sides = [(coded[a][:, one], coded[b][:, 0])] + [(coded[a][:, 0], coded[b][:, one])] * (one > 0)
            for x, y in sides:
                real = (x >= 0) & (y >= 0)
                for n, piece in enumerate(pieces):
                    keys.append((kind + n) << 40 | piece[real] << 24 | x[real] << 12 | y[real])
                    owners.append(fps[real])
        kind += len(pieces)
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps = fuzzy_keys(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _groups(fps: np.ndarray) -> np.ndarray:
    """For each of a key's fingerprints, sorted, the smallest it can reach over links within the key."""
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= MAX_BITS
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return fps[label]
        label = least


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest) of all whole runs of equal keys; rows are sorted by key and fp."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    two = starts[sizes == 2]
    close = two[np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= MAX_BITS]
    a, b = [fps[close + 1]], [fps[close]]
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = np.unique(fps[at : at + n])
        roots = _groups(own)
        linked = roots != own
        a.append(own[linked])
        b.append(roots[linked])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _scan(limit: int):
    """Rows sorted by key and fp -> links (a, b, nulls) and, for keys of more than `limit` fingerprints, their blocks (fp, null, key, block)."""
    names = ["a", "b", "key", "block"]

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _links(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.int64)
        over, block = None, 0
        for batch in batches:
            held_keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
            held = np.concatenate([held, batch.column(1).to_numpy()])
            while len(held_keys):
                n = int(np.searchsorted(held_keys, held_keys[0], side="right"))
                if over == held_keys[0] or n > limit:  # a key of many fingerprints, in full blocks
                    if n < limit and n == len(held_keys):
                        break
                    over, block = (over, block) if over == held_keys[0] else (held_keys[0], 0)
                    cut = min(n, limit)
                    yield links(held_keys[:cut], held[:cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(held[:cut]), pa.nulls(cut, pa.int64()), pa.array(held_keys[:cut]), pa.array(np.full(cut, block, np.int32))], names=names
                    )
                    block += 1
                else:  # whole keys: all but the last, which may go on, up to the next key of many
                    starts = np.flatnonzero(np.concatenate([[True], held_keys[1:] != held_keys[:-1]]))
                    many = np.flatnonzero(np.diff(np.append(starts, len(held_keys))) > limit)
                    cut = int(starts[many[0]]) if len(many) else int(starts[-1])
                    if not cut:
                        break
                    yield links(held_keys[:cut], held[:cut])
                held_keys, held = held_keys[cut:], held[cut:]
        if len(held_keys):
            yield links(held_keys, held)
            if over == held_keys[0]:
                n = int(np.searchsorted(held_keys, over, side="right"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held[:n]), pa.nulls(n, pa.int64()), pa.array(held_keys[:n]), pa.array(np.full(n, block, np.int32))], names=names
                )

    return run


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """distinct(fp) -> a, b: links whose components are those of all pairs at MAX_BITS or fewer bits."""
    schema = "a long, b long, key long, block int"
    found = settle(_keyed(distinct).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_scan(block), schema))
    near = found.filter(F.col("key").isNull()).select("a", "b")
    many = found.filter(F.col("key").isNotNull()).select("key", "block", F.col("a").alias("fp"))
    if many.isEmpty():
        return near
    blocks = many.groupBy("key").agg((F.max("block") + 1).alias("n"))
    met = many.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).filter(F.col("other") != F.col("block"))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    across = met.select(pair.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_scan(1 << 30), schema)
    return near.unionByName(across.select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, fp, root (the smallest fingerprint in reach) and component_id (the smallest doc_id in reach)."""
    own = settle(fingerprints(docs))
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least)).select(F.col("node").alias("fp"), "root")
    classes = settle(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # A table of its own, so that the join's shuffles feed nothing but the join and Spark can split a root of many fingerprints.
    ids = settle(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = classes.select("fp", "root").join(ids, "root")
    return own.join(named, "fp")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group: the one whose doc_id is the group's smallest stays. Of several rows with that doc_id,
    the smallest text hash stays, and of those with the same text the row with the smallest 128-bit hash over all columns: the same row however
    the table is dealt out."""
    found = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = found.groupBy("doc_id", "root").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash").distinct()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*row_key(docs)).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    same = keyed["doc_id"].eqNullSafe(stay["doc_id"]) & (keyed["text_hash"] == stay["text_hash"])
    return keyed.join(stay, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("doc", "key").alias("doc")).select("doc.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
