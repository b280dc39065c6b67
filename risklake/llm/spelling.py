"""Spelling variants: near words (one edit apart) of a vocabulary, by dynamic programming down its sorted list.

1. The vocabulary is sorted several times over: once by the words and once by the words reversed, and each word is filed under its
   own length and under one less, the length of the shorter word of a pair (`l`). Of two words one edit apart, either the first half (l // 2)
   is equal or the rest at the end is, so one of the lists has both in one range of words that share that half.
2. A task scans a stretch of a sorted list. A word is compared with those after it in its range: rows of the edit matrix, three
   cells wide, are kept by depth; the next word starts from the row at its longest common prefix with the one before. Once no cell of a
   row is one or less, all words that share the prefix so far are skipped. All words of a stretch are scanned side by side in numpy.
3. A range that is cut, between two tasks or because it is long, is left in pieces. Pieces of a range meet in a join; two whose own
   shared prefixes are more than two edits apart are left out, any others are scanned against each other.
4. A pair is reported by one list alone: that of its shorter length, by first half if that is equal, else by end.

A task holds a stretch of at most `STRETCH` words (fewer if they are long), however many words share a half. Forms are found by a
grouped minimum, roots by pointer doubling: n grows tenfold with each form, so chains are short.

Cases. A null or empty text has no words. A null doc_id is written as an empty string in the checksum. Rows that repeat whole all count. Among
near words of equal n the smallest in code-point order is the form. Words of any length are compared whole. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.common import settle_as_table, table

LETTERS = r"A-Za-zÀ-ÿ"
MIN_CHARS = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 10
#: Words, and cells of the edit matrix's rows, that a task scans at a time.
STRETCH = 20_000
CELLS = 4_000_000


def vocabulary(docs: DataFrame, spelled: Column | None = None, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """docs(doc_id, text) -> word, n. Words are maximal runs of letters with A-Z in lower case; spelled: an expression over doc_id and word
    that changes a word before it is counted."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0)))
    found = docs.select("doc_id", runs.alias("word")).withColumn("word", F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = found.select((F.col("word") if spelled is None else spelled).alias("word")).filter(F.length("word") >= min_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points (all below 256) for each text, filled up with zeros, three more than the longest has; and the lengths."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("latin-1"), np.uint8)
    rows = np.zeros((len(sizes), int(sizes.max(initial=0)) + 3), np.uint8)
    rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return rows, sizes


def shared_prefixes(rows: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Length of the prefix that each word shares with the one before; zero where begins holds."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        same = (rows[1:] == rows[:-1]) & (rows[1:] != 0)
        out[1:] = np.where(same.all(1), sizes[1:], np.argmin(same, 1))
    out[begins] = 0
    return out


def scan(rows: np.ndarray, sizes: np.ndarray, lcp: np.ndarray, own: np.ndarray, first: np.ndarray, end: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (own, place) one edit apart or equal: each own word against the places from first to end - 1 of the sorted list. depth: length of a
    prefix that it shares with the word at first and, down to the range's half, with all."""
    width = rows.shape[1]
    skip = np.full((len(rows) + 1, width), len(rows), np.int32)
    for d in range(1, width):
        breaks = np.append(np.flatnonzero(lcp < d), len(rows))
        skip[:-1, d] = breaks[np.searchsorted(breaks, np.arange(len(rows)), side="right")]
    matrix = np.empty((len(own), width, 3), np.uint8)
    matrix[:] = (1, 0, 1)
    lane = np.flatnonzero(first < end)
    place, depth, end = first[lane], depth[lane].copy(), end[lane]
    left, right = [], []
    while len(lane):
        word, letter, row = own[lane], rows[place, depth], matrix[lane, depth]
        a = np.minimum(row[:, 1] + 1, row[:, 0] + (rows[word, depth - 1] != letter))
        b = np.minimum(np.minimum(row[:, 2], a) + 1, row[:, 1] + (rows[word, depth] != letter))
        c = np.minimum(b + 1, row[:, 2] + (rows[word, depth + 1] != letter))
        depth = depth + 1
        matrix[lane, depth, 0], matrix[lane, depth, 1], matrix[lane, depth, 2] = np.minimum(a, 2), np.minimum(b, 2), np.minimum(c, 2)
        alive = np.minimum(np.minimum(a, b), c) <= 1
        whole = alive & (depth == sizes[place])
        more = sizes[word] - depth
        near = np.flatnonzero(whole & (np.where(more == 0, b, np.where(more == 1, c, np.where(more == -1, a, 2))) <= 1))
        left.append(word[near])
        right.append(place[near])
        moved = np.flatnonzero(whole | ~alive)
        to = np.where(whole[moved], place[moved] + 1, skip[place[moved], depth[moved]])
        place[moved] = to
        depth[moved] = lcp[np.minimum(to, len(lcp) - 1)]
        if (to >= end[moved]).any():
            on = place < end
            lane, place, depth, end = lane[on], place[on], depth[on], end[on]
    return np.concatenate(left or [own[:0]]), np.concatenate(right or [own[:0]])


def _reported(rows: np.ndarray, sizes: np.ndarray, l: int, side: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:  # noqa: E741
    """Whether the list of l and side is the one that reports a pair."""
    yes = np.minimum(sizes[a], sizes[b]) == l
    if side:
        equal = np.ones(len(a), bool)
        for k in range(1, l // 2 + 1):
            equal &= rows[a, sizes[a] - k] == rows[b, sizes[b] - k]
        yes &= ~equal
    return yes


FOUND = "l int, side int, a string, a_n long, b string, b_n long, piece long, half string, texts array<string>, ns array<long>"
FOUND_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _found(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(FOUND_NAMES, FOUND_TYPES, strict=True)], names=FOUND_NAMES)


def _pairs(l: int, side: int, texts: pa.Array, ns: pa.Array, rows: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:  # noqa: E741
    kept = _reported(rows, sizes, l, side, a, b)
    a, b = pa.array(a[kept]), pa.array(b[kept])
    return _found(l=pa.array(np.full(len(a), l, np.int32)), side=pa.array(np.full(len(a), side, np.int32)), a=texts.take(a), a_n=ns.take(a), b=texts.take(b), b_n=ns.take(b))


def _room(l: int, stretch: int) -> int:  # noqa: E741
    return max(1, min(stretch, max(16, CELLS // (l + 4))))


def _half(l: int, side: int) -> int:  # noqa: E741
    return l - l // 2 if side else l // 2


def _stretches(stretch: int):
    """Sorted rows l, side, text, n -> the pairs within each range of each stretch, and the pieces of ranges that may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        task = pieces = 0
        open_range = None  # the last range of which a piece has left, with its l and side

        def work(part: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_range, pieces
            l, side = part.column("l")[0].as_py(), part.column("side")[0].as_py()
            texts, ns = part.column("text").combine_chunks(), part.column("n").combine_chunks()
            rows, sizes = letters(texts)
            half = _half(l, side)
            begins = np.ones(len(rows), bool)
            begins[1:] = (rows[1:, :half] != rows[:-1, :half]).any(1)
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(rows))
            lcp = shared_prefixes(rows, sizes, begins)
            own = np.arange(len(rows))
            first = own + 1
            depth = np.maximum(lcp[np.minimum(first, len(rows) - 1)], half)
            yield _pairs(l, side, texts, ns, rows, sizes, *scan(rows, sizes, lcp, own, first, np.repeat(ends, ends - starts), depth))
            opened = set()
            if open_range is None or open_range == (l, side, rows[0, :half].tobytes()):
                opened.add(0)
            if last:
                opened.add(len(starts) - 1)
                open_range = (l, side, rows[starts[-1], :half].tobytes())
            else:
                open_range = (-1, side, b"")
            for k in sorted(opened):
                at, n = int(starts[k]), int(ends[k] - starts[k])
                key = rows[at, :half].tobytes().decode("latin-1")
                yield _found(l=pa.array([l]), side=pa.array([side]), piece=pa.array([(task << 33) + pieces]), half=pa.array([key]), texts=pa.array([texts.slice(at, n).to_pylist()]), ns=pa.array([ns.slice(at, n).to_pylist()]))
                pieces += 1

        def cut(end_of_rows: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            while held is not None and held.num_rows:
                l, side = held.column("l")[0].as_py(), held.column("side")[0].as_py()
                same = np.flatnonzero((held.column("l").to_numpy() != l) | (held.column("side").to_numpy() != side))
                many = int(same[0]) if len(same) else held.num_rows
                room = _room(l, stretch)
                if many <= room and not len(same) and not end_of_rows:
                    return
                upto, last = many, end_of_rows and many == held.num_rows
                if many > room:
                    # Back to where a range begins, if one does.
                    key = pc.utf8_slice_codeunits(held.column("text").slice(0, room + 1).combine_chunks(), 0, _half(l, side))
                    new = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, room)).to_numpy(zero_copy_only=False))
                    upto, last = (int(new[-1]) + 1, False) if len(new) else (room, True)
                yield from work(held.slice(0, upto), last)
                held = held.slice(upto)

        for batch in batches:
            if batch.num_rows:
                task = batch.column("task")[0].as_py()
                rows = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, rows]) if held is not None and held.num_rows else rows
                yield from cut(False)
        yield from cut(True)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows l, side, texts, ns, other_texts, other_ns -> the pairs between the two pieces."""
    for batch in batches:
        for k in range(batch.num_rows):
            l, side = batch.column("l")[k].as_py(), batch.column("side")[k].as_py()
            ours, theirs = batch.column("other_texts")[k].values, batch.column("texts")[k].values
            texts, ns = pa.concat_arrays([theirs, ours]), pa.concat_arrays([batch.column("ns")[k].values, batch.column("other_ns")[k].values])
            rows, sizes = letters(texts)
            own = np.arange(len(theirs), len(texts))
            lcp = shared_prefixes(rows, sizes, np.array([0, len(theirs)])[: 1 if not len(ours) else 2])
            place = np.zeros(len(own), np.int64)
            yield _pairs(l, side, texts, ns, rows, sizes, *scan(rows, sizes, lcp, own, place, np.full(len(own), len(theirs)), np.full(len(own), _half(l, side))))


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, stretch: int = STRETCH) -> DataFrame:
    """words(word, n), distinct, of at least min_chars code points below 256 -> a, a_n, b, b_n: each pair one edit apart, once."""
    size = F.length("word")
    lengths = F.explode(F.filter(F.array(size - 1, size), lambda x: x >= min_chars))
    filed = words.select("word", "n", lengths.alias("l")).select("word", "n", "l", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    filed = filed.select("l", "side", F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word")).alias("text"), "n")
    listed = filed.repartitionByRange("l", "side", "text").sortWithinPartitions("l", "side", "text").withColumn("task", F.spark_partition_id().cast("long"))
    found = settle_as_table(listed.mapInArrow(_stretches(stretch), FOUND), "stretches")
    prefix = F.expr("substring(texts[0], 1, aggregate(sequence(1, length(texts[0])), 0, (m, k) -> if(m = k - 1 AND substring(texts[0], k, 1) = substring(texts[size(texts) - 1], k, 1), k, m)))")
    pieces = found.filter(F.col("piece").isNotNull()).select("l", "side", "half", "piece", "texts", "ns", prefix.alias("prefix"))
    others = pieces.select("l", "side", "half", F.col("piece").alias("other"), F.col("texts").alias("other_texts"), F.col("ns").alias("other_ns"), F.col("prefix").alias("other_prefix"))
    known = F.least(F.length("prefix"), F.length("other_prefix"))
    close = F.levenshtein(F.substring("prefix", F.lit(1), known), F.substring("other_prefix", F.lit(1), known), 2) >= 0
    met = pieces.join(others, ["l", "side", "half"]).filter((F.col("piece") < F.col("other")) & close)
    across = met.select("l", "side", "texts", "ns", "other_texts", "other_ns").mapInArrow(_across, FOUND)
    pairs = found.filter(F.col("a").isNotNull()).unionByName(across)
    forward = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
    return pairs.select(forward("a"), "a_n", forward("b"), "b_n")


def variants(words: DataFrame, min_chars: int = MIN_CHARS, ratio: int = FORM_RATIO, stretch: int = STRETCH) -> DataFrame:
    """words(word, n) -> word, n, n_near, form, form_n, root."""
    pairs = near_pairs(words, min_chars, stretch)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fit = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fit, F.col("best.other")).alias("form"), F.when(fit, -F.col("best.less")).alias("form_n"))
    formed = settle_as_table(formed, "forms")
    links = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle_as_table(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return formed.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def thinned(doc_id: Column, word: Column, every: int = 31) -> Column:
    """word, without one of its code points where every divides the checksum of doc_id and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(settle_as_table(vocabulary(docs, thinned(F.col("doc_id"), F.col("word"))), "vocabulary"))


#: CRC32 goes byte by byte over distinct documents' words; near words share what is left of them without one code point.
OP12_SQL = """
WITH RECURSIVE said AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM documents),
counted AS (SELECT doc_id, word, count(*) AS times, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word) AS bytes FROM said WHERE length(word) >= 7 GROUP BY ALL),
bits AS (SELECT range AS code, range AS c, 0 AS step FROM range(256) UNION ALL
  SELECT code, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
codes AS (SELECT code, c FROM bits WHERE step = 8),
sums AS (SELECT bytes, CAST(4294967295 AS BIGINT) AS crc, 0 AS at FROM (SELECT DISTINCT bytes FROM counted) UNION ALL
  SELECT s.bytes, xor(s.crc >> 8, k.c), s.at + 1 FROM sums s JOIN codes k ON k.code = xor(s.crc & 255, CAST('0x' || substr(s.bytes, 2 * s.at + 1, 2) AS BIGINT)) WHERE 2 * s.at < length(s.bytes)),
hashed AS (SELECT c.word, c.times, xor(s.crc, 4294967295) AS h FROM counted c JOIN sums s ON s.bytes = c.bytes AND 2 * s.at = length(c.bytes)),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
best AS (SELECT p.word, min(p.other) AS other FROM pairs p JOIN near m ON m.word = p.word AND m.top = p.other_n GROUP BY p.word),
formed AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.top >= 10 * w.n THEN b.other END AS form, CASE WHEN m.top >= 10 * w.n THEN m.top END AS form_n
  FROM words w LEFT JOIN near m ON m.word = w.word LEFT JOIN best b ON b.word = w.word),
walks AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT w.word, f.word, f.form FROM walks w JOIN formed f ON f.word = w.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root FROM formed f JOIN walks w ON w.word = f.word AND w.next IS NULL
"""
