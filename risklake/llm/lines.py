"""Line deduplication by pairwise patience alignment.

1. Exact copies of a text are settled first, by its hash: the first document (smallest doc_id) keeps it, all lines of the others go.
2. Lines with a word, and runs of `min_block` of them, are hashed to keys. For each key a grouped aggregate finds its holder, the first
   document that has it, and the places of the key there.
3. A later document is paired with the holder of each of its keys. A key leads to one holder however many documents share it, so the
   number of pairs follows the input and no threshold of rarity is needed; and whatever block a later document shares with any earlier
   one, each of its runs has a holder that has the whole run.
4. Copies of a key in a document are numbered. The first copy is aligned with the holder's first, the second with its second, and so on;
   where the holder has no more, the later document's other copies start again with the holder's first, in an alignment of their own.
5. Each pair is aligned with patience diff over its numbered keys, which are unique on both sides: the longest increasing sequence of
   these anchors is kept, and each grows up and down over equal neighbours.
   Runs of copies that are left are aligned anew, or go with a block that reaches into them.
6. Aligned blocks of `min_block` lines, or of `min_chars` characters, are deleted from the later document; a line that has as many
   characters is such a block by itself, in whatever order it stands. A line's holder never loses
   that line to a document after it.
7. Copies that are numbered otherwise on both sides fill the blocks: where shared lines are left beside a block, both documents are
   compared line by line from the block on.

Skew. A frequent key's rows are reduced before they are shuffled (partial aggregates), and the join that brings each
key its holder is one that Spark splits where a key is skewed. Of the holder's places a row gets as many as it has itself. One later
document's keys are held at a time.

Cases. A null or empty text has no lines with words and is never changed. Lines without a word are never compared nor
deleted on their own. A block that stands several times in the earlier or in the later document goes from the later one wherever it
stands; a document's own repeats stay if no earlier document has them. Blocks in another order than the earlier document's are not all
aligned: the longest increasing sequence is. Documents are told apart by a 64-bit hash of doc_id and text; rows that repeat whole are one
document and get the same result; a null doc_id comes first. An empty table gives no rows. Lines, runs and texts are compared
by hashes of 128 bits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.llm.common import settle, settle_as_table, table
from risklake.llm.wordhash import mix

MIN_BLOCK = 2
MIN_CHARS = 80
#: Lines that a task turns to keys at a time, and odd numbers to chain the hashes of a run's lines.
GROUP_LINES = 200_000
CHAINS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F))


def said_lines() -> Column:
    """Array of the text's lines with a word: place (from 0), line and check (hashes), chars."""
    placed = F.transform(F.split("text", "\n", -1), lambda line, k: F.struct(k.alias("place"), line.alias("line"), line.rlike(r"[^\x20\x09-\x0D]").alias("said")))
    hashed = lambda x: F.struct(x["place"].alias("place"), F.xxhash64(x["line"]).alias("line"), F.xxhash64(F.lit(1), x["line"]).alias("check"), F.length(x["line"]).alias("chars"))
    return F.transform(F.filter(placed, lambda x: x["said"]), hashed)


def _keys(min_block: int, names: list[str]):
    """Rows doc_id, dkey, lines -> a row per distinct line (kind 0) and run of min_block lines (kind 1): its key and check, and rank, place and
    chars of the first line at each of its places."""

    def group(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = batch.column("lines").flatten()
        hashes = [pc.struct_field(flat, c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("line", "check")]
        place, chars = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("place", "chars"))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for kind, width in enumerate([1, min_block] if min_block > 1 else [1]):
            at = np.flatnonzero(rank + width <= sizes[owner])
            if not len(at):
                continue
            keys = [h[at] for h in hashes]
            for k in range(1, width):
                keys = [mix(key * chain + h[at + k]) for key, chain, h in zip(keys, CHAINS, hashes, strict=True)]
            order = np.lexsort((keys[1], keys[0], owner[at]))
            at, keys = at[order], [key[order] for key in keys]
            new = np.ones(len(at), bool)
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (owner[at][1:] != owner[at][:-1])
            first = np.flatnonzero(new)
            rows, offsets = pa.array(owner[at[first]]), pa.array(np.append(first, len(at)), pa.int32())
            listed = [pa.ListArray.from_arrays(offsets, pa.array(v[at].astype(np.int32))) for v in (rank, place, chars)]
            made = [pa.array(keys[0][first].view(np.int64)), pa.array(keys[1][first].view(np.int64)), pa.array(np.full(len(first), kind, np.int8)), batch.column("doc_id").take(rows), batch.column("dkey").take(rows), *listed]
            yield pa.RecordBatch.from_arrays(made, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("lines")).to_numpy(zero_copy_only=False).astype(np.int64)
            total, first = np.cumsum(sizes), 0
            while first < len(sizes):
                upto = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + GROUP_LINES, side="right")))
                yield from group(batch.slice(first, upto - first), sizes[first:upto])
                first = upto

    return run


def _anchors(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Longest sequence, increasing on both sides, of places whose line is unique in a and in b. a, b: shared lines' hashes in
    order; x, y: their ranks."""
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    both, ka, kb = np.intersect1d(ua[ca == 1], ub[cb == 1], return_indices=True)
    at = sorted(zip(ia[ca == 1][ka].tolist(), ib[cb == 1][kb].tolist(), strict=True))
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(at)
    for k, (_, j) in enumerate(at):
        p = bisect_left(tails, j)
        tails[p : p + 1] = [j]
        ends[p : p + 1] = [k]
        back[k] = ends[p - 1] if p else -1
    path, k = [], ends[-1] if ends else -1
    while k >= 0:
        path.append(at[k])
        k = back[k]
    return path[::-1]


def aligned_blocks(keys: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """Aligned common blocks of a pair: rank in the first document, rank in the later one, lines. Each of keys stands for size lines,
    once in the first document (at x) and in the later one at y. Blocks grow from the anchors and never cross the next one."""
    by_x, by_y = np.lexsort((size, x)), np.lexsort((size, y))
    by_x = by_x[np.sort(np.unique(keys[by_x], return_index=True)[1])]
    path = [by_y[j] for _, j in _anchors(keys[by_x], keys[by_y], x[by_x], y[by_y])]
    points = {(p + k, q + k) for p, q, n in zip(x.tolist(), y.tolist(), size.tolist(), strict=True) for k in range(n)}
    seeds: list[tuple[int, int, int]] = []
    for p, q, n in zip(x[path].tolist(), y[path].tolist(), size[path].tolist(), strict=True):
        skip = 0
        if seeds:
            u, v, m = seeds[-1]
            if p - q == u - v and q <= v + m:
                seeds[-1] = (u, v, max(m, q + n - v))
                continue
            skip = max(0, u + m - p, v + m - q)
        if skip < n:
            seeds.append((p + skip, q + skip, n - skip))
    blocks: list[tuple[int, int, int]] = []
    for k, (p, q, n) in enumerate(seeds):
        u, v, m = blocks[-1] if blocks else (0, 0, 0)
        while p > u + m and q > v + m and (p - 1, q - 1) in points:
            p, q, n = p - 1, q - 1, n + 1
        end_p, end_q = seeds[k + 1][:2] if k + 1 < len(seeds) else (np.inf, np.inf)
        while p + n < end_p and q + n < end_q and (p + n, q + n) in points:
            n += 1
        if blocks and p - q == u - v and q == v + m:
            blocks[-1] = (u, v, m + n)
        else:
            blocks.append((p, q, n))
    return blocks


GONE = T.StructType(
    [
        T.StructField("later", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("lines", T.ArrayType(T.LongType())),
        T.StructField("checks", T.ArrayType(T.LongType())),
        T.StructField("places", T.ArrayType(T.IntegerType())),
    ]
)


def _align(min_block: int, min_chars: int):
    """Rows sorted by later -> GONE. Without first: places of the lines to delete. With first: lines left beside a block, from it
    away, with their places; they go as far as they equal those of first from rank x on, in direction step."""

    def document(keys: dict[str, np.ndarray], own: list[np.ndarray], theirs: list[np.ndarray]) -> Iterator[tuple]:
        """keys: a row per key; own: rank, place and chars of all its places, one after another, with their number; theirs: the holder's."""
        (n_own, rank, place, chars), (n_theirs, x) = own, theirs
        row = np.repeat(np.arange(len(n_own)), n_own)
        copy = np.arange(len(row)) - np.repeat(np.cumsum(n_own) - n_own, n_own)
        single = np.flatnonzero(keys["kind"][row] == 0)
        single = single[np.argsort(rank[single], kind="stable")]
        line_rank, line, check, line_place, line_chars = rank[single], keys["key"][row][single], keys["check"][row][single], place[single], chars[single]
        gone = np.zeros(len(single), bool)
        turn, nth = np.divmod(copy, np.maximum(n_theirs[row], 1))
        at = x[np.minimum((np.cumsum(n_theirs) - n_theirs)[row] + nth, len(x) - 1)]
        # A key for each copy, unique on both sides.
        label = mix(keys["key"][row].view(np.uint64) ^ mix(copy.astype(np.uint64) + keys["kind"][row].astype(np.uint64) * np.uint64(1 << 40)))
        size = np.where(keys["kind"][row] == 0, 1, min_block)
        order = np.lexsort((turn, keys["first"][row]))
        first, turn = keys["first"][row][order], turn[order]
        cuts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (turn[1:] != turn[:-1])))
        kept = []
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            part = order[i:j]
            blocks = aligned_blocks(label[part], at[part], rank[part], size[part]) if len(part) > 1 else [(int(at[part[0]]), int(rank[part[0]]), int(size[part[0]]))]
            for _, q, n in blocks:
                k = int(np.searchsorted(line_rank, q))
                if n >= min_block or line_chars[k : k + n].sum() >= min_chars:
                    gone[k : k + n] = True
            kept.append((int(first[i]), blocks))
        # A long line is a block of its own wherever it stands. Runs that are left around copies: those that an aligned block reaches into go with it, the others are aligned anew.
        runs = np.flatnonzero(keys["kind"][row] == 1)
        index = np.searchsorted(line_rank, rank[runs][:, None] + np.arange(min_block)[None, :])
        copied = ((n_own > 1) | (keys["held"] > 1))[row][single]
        gone |= line_chars >= min_chars
        while len(runs):
            touched = gone[index].any(1)
            gone[index[touched]] = True
            runs, index = runs[~touched], index[~touched]
            if touched.any():
                continue
            again = copied[index].any(1)
            runs, index = runs[again], index[again]
            for one in np.unique(keys["first"][row[runs]]).tolist():
                part = runs[keys["first"][row[runs]] == one]
                blocks = aligned_blocks(label[part], at[part], rank[part], size[part])
                for _, q, n in blocks:
                    k = int(np.searchsorted(line_rank, q))
                    gone[k : k + n] = True
                kept.append((one, blocks))
        yield None, 0, 0, line[:0], check[:0], line_place[gone]
        if gone.all():
            return
        for one, blocks in kept:
            for k, (p, q, n) in enumerate(blocks):
                if n < min_block:
                    continue
                start = int(np.searchsorted(line_rank, q))
                up, down = start, start + n
                while down < len(line_rank) and not gone[down] and line_rank[down] == q + down - start and (k + 1 == len(blocks) or p + down - start < blocks[k + 1][0]):
                    down += 1
                while up > 0 and not gone[up - 1] and line_rank[up - 1] == q + up - 1 - start and p + up - 1 - start >= (blocks[k - 1][0] + blocks[k - 1][2] if k else 0):
                    up -= 1
                if down > start + n:
                    yield one, p + n, 1, line[start + n : down], check[start + n : down], line_place[start + n : down]
                if up < start:
                    yield one, p - 1, -1, line[up:start][::-1], check[up:start][::-1], line_place[up:start][::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(rows: pa.Table) -> pa.RecordBatch:
            keys = {c: rows.column(c).to_numpy() for c in ("later", "first", "kind", "key", "check", "held")}
            listed = {c: rows.column(c).combine_chunks() for c in ("rank", "place", "chars", "x")}
            sizes = {c: pc.list_value_length(listed[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "x")}
            flat = {c: v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c, v in listed.items()}
            ends = {c: np.append(0, np.cumsum(n)) for c, n in sizes.items()}
            cuts = [*np.flatnonzero(np.diff(keys["later"], prepend=keys["later"][:1] - 1)).tolist(), rows.num_rows]
            made = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                o, t = slice(*ends["rank"][[i, j]]), slice(*ends["x"][[i, j]])
                own, theirs = [sizes["rank"][i:j], *(flat[c][o] for c in ("rank", "place", "chars"))], [sizes["x"][i:j], flat["x"][t]]
                made += [(keys["later"][i], *found) for found in document({c: v[i:j] for c, v in keys.items()}, own, theirs)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([row[k] for row in made], kind) for k, kind in enumerate(kinds)], names=GONE.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            later = rows.column("later").to_numpy()
            last = np.flatnonzero(later != later[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            held = rows.slice(cut)
            if cut:
                yield work(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield work(held)

    return run


def deletions(docs: DataFrame, min_block: int = MIN_BLOCK, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs(doc_id, text) -> dkey, places (of the lines to delete; null for an exact copy, whose lines go all)."""
    keyed = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("dkey"), F.xxhash64("text").alias("tkey"), F.xxhash64(F.lit(1), "text").alias("tcheck"), "text")
    once = settle(keyed.select("tkey", "tcheck", "doc_id", "dkey").distinct())
    kept = settle(once.groupBy("tkey", "tcheck").agg(F.min(F.struct("doc_id", "dkey")).alias("keeper")).select(F.col("keeper.dkey").alias("dkey")))
    texts = keyed.select("doc_id", "dkey", said_lines().alias("lines")).filter(F.size("lines") > 0)
    # Rows that repeat whole are one document.
    texts = texts.join(kept.hint("shuffle_hash"), "dkey").select("doc_id", "dkey", "lines")
    texts = settle_as_table(texts.dropDuplicates(["dkey"]), "lines")

    names = ["key", "check", "kind", "doc_id", "dkey", "rank", "place", "chars"]
    types = [T.LongType(), T.LongType(), T.ByteType(), docs.schema["doc_id"].dataType, T.LongType(), *[T.ArrayType(T.IntegerType())] * 3]
    rows = texts.mapInArrow(_keys(min_block, names), T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))
    shared = rows.groupBy("key", "check").agg(F.min(F.struct("doc_id", "dkey", "rank")).alias("holder"), (F.min("dkey") != F.max("dkey")).alias("met"))
    # A table of its own, so that the join's shuffles feed nothing but the join and Spark can split a frequent key.
    shared = settle(shared.filter("met").drop("met"))
    met = rows.join(shared, ["key", "check"]).filter(F.col("holder.dkey") != F.col("dkey"))
    theirs = F.slice("holder.rank", F.lit(1), F.size("rank"))
    pairs = met.select(F.col("dkey").alias("later"), F.col("holder.dkey").alias("first"), theirs.alias("x"), F.size("holder.rank").alias("held"), "kind", "rank", "key", "check", "place", "chars").repartition("later").sortWithinPartitions("later")
    found = settle_as_table(pairs.mapInArrow(_align(min_block, min_chars), GONE), "blocks")

    gone = found.filter(F.col("first").isNull() & (F.size("places") > 0)).select("later", "places")
    beside = found.filter(F.col("first").isNotNull())
    if not beside.isEmpty():
        theirs = texts.select(F.col("dkey").alias("first"), F.col("lines.line").alias("_lines"), F.col("lines.check").alias("_checks"))
        place = lambda k: F.col("x") + F.col("step") * k
        same = F.transform("lines", lambda line, k: F.get("_lines", place(k)).eqNullSafe(line) & F.get("_checks", place(k)).eqNullSafe(F.get("checks", k)))
        until = F.array_position(same, False).cast("int")
        fills = beside.join(theirs, "first").select("later", "places", F.when(until == 0, F.size("places")).otherwise(until - 1).alias("n"))
        gone = gone.unionByName(fills.filter("n > 0").select("later", F.slice("places", 1, F.col("n")).alias("places")))
    gone = gone.groupBy(F.col("later").alias("dkey")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    copies = once.join(kept, "dkey", "left_anti").select("dkey", F.lit(None).cast("array<int>").alias("places"))
    return gone.unionByName(copies)


def deduplicate_lines(docs: DataFrame, **options: int) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with the deleted lines cut out of text, and n_lines and n_deleted."""
    columns = [c for c in docs.columns if c not in {"n_lines", "n_deleted"}]
    gone = deletions(docs.select("doc_id", "text"), **options).withColumn("found", F.lit(True)).hint("shuffle_hash")
    others = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"])
    joined = docs.select(others.alias("doc"), "text", F.xxhash64("doc_id", "text").alias("dkey")).join(gone, "dkey", "left")
    # An exact copy is one block of all its lines.
    block = F.when(F.col("found") & F.col("places").isNull(), said_lines())
    total = F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    whole = F.when((F.size(block) >= options.get("min_block", MIN_BLOCK)) | (total >= options.get("min_chars", MIN_CHARS)), block["place"])
    at = F.col("at")
    # Places are sorted and walked along with the lines: between two deleted places a slice of lines stays.
    edges = F.concat(F.array(F.lit(-1)), at, F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.slice(F.col("lines"), F.get(edges, k) + 2, F.get(edges, k + 1) - F.get(edges, k) - 1)))
    with_lines = joined.withColumn("lines", F.split("text", "\n", -1)).withColumn("at", F.coalesce("places", whole, F.array().cast("array<int>")))
    text = F.when(F.size(at) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    n_lines = F.coalesce(F.when(F.size("lines") >= 0, F.size("lines")), F.lit(0)).cast("long")
    made = [text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in columns]
    return with_lines.select(*made, n_lines.alias("n_lines"), F.size(at).cast("long").alias("n_deleted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
