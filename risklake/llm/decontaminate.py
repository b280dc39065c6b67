"""Benchmark decontamination by a broadcast set of test n-grams.

The benchmark's word windows are hashed into sets, which every task has; tasks roll the same hashes over the whole
training texts, look them up and compare the words of each hit, so a hash collision is no hit. The benchmark is cut into
parts of at most `part_bytes` of text: each part is a broadcast of proven size and a pass of its own over the rows in
the same tasks, without a shuffle. A benchmark of more than `broadcast_bytes` in all is not broadcast: its windows meet the
documents' windows in a join by hash, behind a bitmap of fixed size, and the words of each hit are compared as well.
Both ways give the same rows. The benchmark's size, its parts or the bitmap are computed when the plan is made.

Cases. A null or empty text has no words and no hits; an item without words has no windows. An item of fewer than 10
words is one window. Items that share a window all count; an item_id given more than once counts once. A null item_id is
called "null". Rows that repeat whole are scanned each. An empty benchmark hits nothing. Columns of the documents that
bear one of the output's names are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.llm.common import aside, back_again, fresh, settle_as_table, table
from risklake.llm.wordhash import Words, alphanumeric_table, text_groups, window_hashes

WINDOW = 10
PART_BYTES = 4_000_000
#: Text that a task scans at a time: some fifty times as much memory.
SCAN_BYTES = 1_000_000
FILTER_BITS = 22
#: All parts together; beyond it the windows are joined.
BROADCAST_BYTES = 64_000_000
#: Words of 64 bits in the bitmap of a joined benchmark's hashes.
BITMAP_WORDS = 1 << 20

SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start_word", "end_word", "start_char", "end_char")])
ADDED = ("n_words", "spans", "items")


class Index:
    """Windows of a part of the benchmark, by number of words: sorted hashes, and for each the words and items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items = [name for name, _ in items]
        found: dict[int, dict[int, list[tuple[int, bytes]]]] = defaultdict(lambda: defaultdict(list))
        for first, _, words in text_groups(pa.array([text for _, text in items], pa.large_string()), alphanumeric_table()):
            hashes = words.hashes()
            for k in range(len(words.docs) - 1):
                a, b = words.docs[k], words.docs[k + 1]
                n = min(window, b - a)
                for at, h in enumerate(window_hashes(hashes[a:b], n).tolist() if n else ()):
                    found[n][h].append((first + k, words.joined(a + at, a + at + n)))
        self.lengths, self.near = {}, {}
        for n, by_hash in found.items():
            keys = np.array(sorted(by_hash), np.uint64)
            self.lengths[int(n)] = (keys, [by_hash[h] for h in keys.tolist()])

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """First words, numbers of words and items of all verified hits."""
        starts, sizes, items = [], [], []
        hashes, owner = words.hashes(), words.owner()
        for n, (keys, windows) in self.lengths.items():
            rolled = window_hashes(hashes, n)
            if not len(rolled):
                continue
            if n not in self.near:
                # Made where it is used, once for all texts of a task's process.
                self.near[n] = np.zeros(1 << FILTER_BITS, bool)
                self.near[n][(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            places = np.flatnonzero(self.near[n][(rolled >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            places = places[owner[places] == owner[places + n - 1]]
            found = np.minimum(np.searchsorted(keys, rolled[places]), len(keys) - 1)
            same = keys[found] == rolled[places]
            for place, k in zip(places[same].tolist(), found[same].tolist(), strict=True):
                said = words.joined(place, place + n)
                for item, window in windows[k]:
                    if window == said:
                        starts.append(place)
                        sizes.append(n)
                        items.append(item)
        return np.array(starts, np.int64), np.array(sizes, np.int64), items


def _spans(words: Words, doc: int, starts: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """Merged spans of one document's hits, in words and code points of the document, the end not included."""
    order = np.argsort(starts, kind="stable")
    merged: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), (starts + sizes)[order].tolist(), strict=True):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    base, origin = int(words.docs[doc]), int(words.origin[doc])
    lead = (words.raw[origin : words.origin[doc + 1]] & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    return [
        {
            "start_word": a - base,
            "end_word": b - base,
            "start_char": int(chars[words.starts[a] - origin]),
            "end_char": int(chars[words.ends[b - 1] - origin]),
        }
        for a, b in merged
    ]


def _scan(docs: DataFrame, part) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names: number of words, and the part's spans and items."""
    names = [fresh(name, docs) for name in ("_n_words", "_spans", "_items")]
    added = [T.StructField(name, kind) for name, kind in zip(names, (T.LongType(), T.ArrayType(SPAN), T.ArrayType(T.StringType())), strict=True)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tokens = part.value, alphanumeric_table()
        spans_type = pa.list_(pa.struct([(f.name, pa.int32()) for f in SPAN.fields]))
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[list] = [[] for _ in range(batch.num_rows)]
            for first, last, words in text_groups(batch.column(batch.schema.get_field_index("text")), tokens, SCAN_BYTES):
                n_words[first:last] = np.diff(words.docs)
                starts, sizes, named = index.hits(words)
                docs_hit = np.searchsorted(words.docs, starts, side="right") - 1
                for doc in np.unique(docs_hit).tolist():
                    own = np.flatnonzero(docs_hit == doc)
                    spans[first + doc] = _spans(words, doc, starts[own], sizes[own])
                    items[first + doc] = sorted({index.items[named[k]] for k in own.tolist()})
            columns = [pa.array(n_words), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *added])), names


def benchmark_parts(benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> list:
    """Broadcast indexes of at most part_bytes of text each (or one item). The items pass the driver one by one."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).toLocalIterator()
    parts, held, size = [], [], 0
    for name, text in rows:
        if held and size + len(text) * 4 > part_bytes:
            parts.append(sc.broadcast(Index(held, window)))
            held, size = [], 0
        held.append((name, text))
        size += len(text) * 4
    parts.append(sc.broadcast(Index(held, window)))
    return parts


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs(text, ...) -> docs with n_words, spans (hit words; spans of different parts may overlap) and items (distinct)."""
    scanned = docs.drop(*ADDED)
    if (benchmark.agg(F.sum(F.length("text").cast("long") * 4)).first()[0] or 0) > broadcast_bytes:
        return _annotate_joined(scanned, benchmark, window)
    columns = [F.col(f"`{c}`") for c in scanned.columns]
    found = []
    for part in benchmark_parts(benchmark, window, part_bytes):
        scanned, names = _scan(scanned, part)
        found.append(names)
    n_words, spans, items = zip(*found, strict=True)
    return scanned.select(
        *columns,
        F.col(n_words[0]).alias("n_words"),
        F.sort_array(F.flatten(F.array(*spans))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.array(*items)))).alias("items"),
    )


def _item_windows(window: int):
    """(item, text) -> n, hash, said, item: the items' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for first, _, words in text_groups(batch.column(1), alphanumeric_table()):
                hashes = words.hashes()
                for k in range(len(words.docs) - 1):
                    a, b = int(words.docs[k]), int(words.docs[k + 1])
                    n = min(window, b - a)
                    found = window_hashes(hashes[a:b], n).view(np.int64).tolist() if n else []
                    rows += [(n, h, words.joined(a + at, a + at + n), names[first + k]) for at, h in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.string()])], names=["n", "hash", "said", "item"])

    return run


def _text_windows(bitmap, lengths: list[int]):
    """(t1, t2, text) -> n, hash, t1, t2, start: the texts' windows whose hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            for first, _, words in text_groups(batch.column(2), alphanumeric_table()):
                hashes, owner = words.hashes(), words.owner()
                for n in lengths:
                    rolled = window_hashes(hashes, n)
                    near = bits[(rolled >> np.uint64(44)).astype(np.int64)] >> ((rolled >> np.uint64(38)) & np.uint64(63)) & np.uint64(1)
                    at = np.flatnonzero(near)
                    at = at[owner[at] == owner[at + n - 1]]
                    row = owner[at]
                    made = [np.full(len(at), n, np.int32), rolled[at].view(np.int64), keys[0][first + row], keys[1][first + row], (at - words.docs[row]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, made)), names=["n", "hash", "t1", "t2", "start"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text, hits) -> t1, t2, spans, items: what is left of the hits when their words are compared."""
    kind = pa.list_(pa.struct([(f.name, pa.int32()) for f in SPAN.fields]))
    for batch in batches:
        spans, items = [], []
        for k in range(batch.num_rows):
            _, _, words = next(text_groups(batch.column(2).slice(k, 1), alphanumeric_table()))
            real = [h for h in batch.column(3)[k].as_py() if words.joined(h["start"], h["start"] + h["n"]) == h["said"]]
            spans.append(_spans(words, 0, np.array([h["start"] for h in real], np.int64), np.array([h["n"] for h in real], np.int64)))
            items.append(sorted({h["item"] for h in real}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["t1", "t2", "spans", "items"])


def _annotate_joined(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The same for a benchmark of any size: windows of distinct texts and of items are joined by hash, and words compared."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    windows = settle_as_table(items.mapInArrow(_item_windows(window), "n int, hash long, said binary, item string").distinct(), "windows")
    # At most `window` lengths, and at most BITMAP_WORDS rows of two numbers.
    lengths = sorted(r["n"] for r in windows.select("n").distinct().toLocalIterator())
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(hash, 38) & 63 AS INT))")
    words = windows.groupBy(F.shiftrightunsigned("hash", 44).alias("word")).agg(F.bit_or(bit).alias("bits"))
    bitmap = np.zeros(BITMAP_WORDS, np.uint64)
    for row in words.toLocalIterator():
        bitmap[row["word"]] = np.uint64(row["bits"] & (2**64 - 1))
    key = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    texts = settle_as_table(docs.filter(F.col("text").isNotNull()).select(*key, "text").dropDuplicates(["t1", "t2"]), "texts")
    places = texts.mapInArrow(_text_windows(spark.sparkContext.broadcast(bitmap), lengths), "n int, hash long, t1 long, t2 long, start int")
    hits = places.join(windows, ["n", "hash"]).groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n", "said", "item")).alias("hits"))
    added = T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
    found = texts.join(hits, ["t1", "t2"]).select("t1", "t2", "text", "hits").mapInArrow(_verified, added)
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.regexp_count(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long").alias("n_words")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key, n_words)
    joined = whole.join(found, ["t1", "t2"], "left")
    return joined.select("doc.*", "n_words", F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(spans: Column) -> Column:
    """Words under the spans, which are sorted and may overlap."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(state: Column, span: Column) -> Column:
        fresh = F.greatest(span["end_word"] - F.greatest(span["start_word"], state["end"]), F.lit(0))
        return F.struct(F.greatest(state["end"], span["end_word"]).alias("end"), (state["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, add, lambda state: state["n"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans' characters."""
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("kept"))

    def cut(state: Column, span: Column) -> Column:
        between = F.substring(text, state["end"] + 1, F.greatest(span["start_char"] - state["end"], F.lit(0)))
        return F.struct(F.greatest(state["end"], span["end_char"]).alias("end"), F.concat(state["kept"], between).alias("kept"))

    return F.aggregate(spans, start, cut, lambda state: F.concat(state["kept"], F.substring(text, state["end"] + 1, F.length(text))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without the documents that have a hit (remove="documents"), or with the hit spans cut out (remove="spans")."""
    found = annotate(aside(docs, ADDED), benchmark, window)
    if remove == "documents":
        return back_again(found.filter(F.size("spans") == 0), docs, ADDED)
    if remove != "spans":
        raise ValueError(f"remove: {remove}")
    cut = F.when(F.size("spans") > 0, without_spans(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return back_again(found.withColumn("text", cut), docs, ADDED)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower_text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents)
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower_text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM benchmark)
), windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[p : p + least(10, len(words)) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM b WHERE len(words) > 0)
), places AS (
  SELECT doc_id, p, n, array_to_string(words[p : p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)
), hits AS (
  SELECT doc_id, item_id, p, places.n FROM places JOIN windows ON places.n = windows.n AND places.gram = windows.gram
), per_word AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM hits) GROUP BY doc_id
), per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_word ON d.doc_id = per_word.doc_id LEFT JOIN per_item ON d.doc_id = per_item.doc_id
"""
