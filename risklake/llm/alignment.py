"""Cross-tokenizer alignment: divide and conquer at shared cuts.

Two tokenizers cut the same bytes into tokens. Byte offsets at which a token of both ends are cuts; between two cuts lies a group.

1. Tokens. A text is cut before each space that follows a character other than white space: there both tokenizers begin a token whatever
   stands before or after (held against whole texts in the tests), so each distinct piece is encoded once per task and kept.
2. Groups. An interval of tokens is divided at a common end near its middle: ends of the first tokenizer, from the middle outwards, are
   looked up by bisection among those of the second. Both halves are divided in turn; an interval without a common end is a
   group. All intervals of some documents are divided side by side in numpy, level by level.
3. Links. Each token of a group is linked with each of the other side. A document's distinct id pairs and how often it links them are
   stored; a grouped count gives the number of documents of each pair, and the highest count of each first id.
4. Each document's links are looked up among the `common` most frequent pairs, which are broadcast (a bound on its size, 17 bytes a pair).
   Links of all other pairs are joined with the counts.

Bounds. A task works on `GROUP_BYTES` of text at a time, or one text. A group of many tokens is counted by its distinct ids and not link by
link. The kept pieces are forgotten when they pass `KEPT`.

Cases. A text that is null or empty, or that either tokenizer does not give back byte for byte, has no tokens: zeros and an empty
string. Strings of special tokens are plain text. Rows that repeat are documents of their own; a null doc_id stays null. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.common import settle_as_table, table

TOKENIZERS = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
GROUP_BYTES = 2_000_000
KEPT = 300_000
#: Pairs of ids that are broadcast: at most 9 MB.
COMMON = 1 << 19
#: Groups with more links than this are counted by distinct ids; links that are unfolded at a time.
WIDE = 256
#: A piece without an end of so many characters goes to the slower encoder, whose pattern has no limit.
LONG_PIECE = 20_000


class ByteTokens:
    """A byte-level BPE file. Its own library defines the ids; a quicker one that reads merges as ranks is used where both are the same."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, merges = said["model"]["vocab"], said["model"]["merges"]
        letter = _byte_letters()
        spelled = {i: bytes(letter[c] for c in entry) for entry, i in vocab.items()}
        added = {x["id"]: x["content"].encode() for x in said["added_tokens"]}
        self.entries = [spelled.get(i, added.get(i, b"")) for i in range(max([*spelled, *added]) + 1)]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        pre = said["pre_tokenizer"] or {}
        same = said["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and made == sorted(made) and len(set(made)) == len(made) == len(vocab) - 256
        self.quick = None
        if same:
            import tiktoken

            # Fixed value: the published pattern of the byte-level pre-tokenizer.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in spelled.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [x.ids for x in self.exact.encode_batch(texts, add_special_tokens=False)]
        return [self.quick.encode_ordinary(t) if len(t) < LONG_PIECE else self.exact.encode(t, add_special_tokens=False).ids for t in texts]


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level files write each byte: printable bytes as themselves, all others from U+0100 on in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in shown):
        letters[chr(0x100 + k)] = b
    return letters


class PieceTokens:
    """A sentence-piece file; a space is put before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.entries = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        # No token may reach over the place before a space at which texts are cut.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Entries:
    """Bytes of a tokenizer's entries, and how many each has."""

    def __init__(self, entries: list[bytes]):
        self.bytes = pa.array(entries, pa.binary())
        self.sizes = np.array([len(e) for e in entries], np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all these tokens, one after another."""
        found = self.bytes.take(pa.array(ids))
        data = found.buffers()[2]
        return np.frombuffer(data, np.uint8)[: int(self.sizes[ids].sum())] if data is not None else np.empty(0, np.uint8)


class Pair:
    """Both tokenizers, and the tokens of pieces met so far."""

    def __init__(self, folder: str, first: str, second: str):
        self.first, self.second = ByteTokens(os.path.join(folder, first)), PieceTokens(os.path.join(folder, second))
        self.a, self.b = Entries(self.first.entries), Entries(self.second.entries)
        self.kept: dict[str, tuple[bytes, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        """Parts of the text, each to be read with a space before it."""
        if not self.second.cuts:
            return [text]
        parts = [p[1:] for p in re.split(r"(?<=\S)(?= )", " " + text)] if re.search(r"\s |^ ", text) else text.split(" ")
        # The second tokenizer gives an empty text no space: a last one stays with what is before it.
        return [*parts[:-2], parts[-2] + " "] if len(parts) > 1 and not parts[-1] else parts

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text the ids of both tokenizers, packed as 32-bit integers."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        cut = [self.pieces(t) for t in texts]
        new = list({p for ps in cut for p in ps if p not in self.kept})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for p, x, y in zip(part, self.first.encode([" " + p for p in part]), self.second.encode(part), strict=True):
                self.kept[p] = (np.array(x, np.int32).tobytes(), np.array(y, np.int32).tobytes())
        out = []
        for ps in cut:
            found = [self.kept[p] for p in ps]
            out.append((b"".join([x for x, _ in found]), b"".join([y for _, y in found])))
        return out


@lru_cache(maxsize=2)
def _loaded(folder: str, first: str, second: str) -> Pair:
    return Pair(folder, first, second)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, last_a: np.ndarray, first_b: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divide each interval (tokens first to last of both sides, which end together) at shared ends: the last tokens of all groups, sorted."""
    leaf_a, leaf_b = [last_a[:0]], [last_b[:0]]
    while len(first_a):
        one = (first_a == last_a) | (first_b == last_b)
        leaf_a.append(last_a[one])
        leaf_b.append(last_b[one])
        first_a, last_a, first_b, last_b = (x[~one] for x in (first_a, last_a, first_b, last_b))
        middle = (np.where(first_a > 0, ends_a[first_a - 1], 0) + ends_a[last_a]) // 2
        centre = np.clip(np.searchsorted(ends_a, middle), first_a, last_a - 1)
        cut_a, cut_b = np.full(len(centre), -1), np.full(len(centre), -1)
        open_, step = np.arange(len(centre)), 0
        while len(open_):
            # Ends at the middle, one after, one before, two after, ...
            probe = centre[open_] + ((step + 1) // 2 if step % 2 else -(step // 2))
            inside = (probe >= first_a[open_]) & (probe < last_a[open_])
            at, probe = open_[inside], probe[inside]
            met = np.searchsorted(ends_b, ends_a[probe])
            hit = ends_b[met] == ends_a[probe]
            cut_a[at[hit]], cut_b[at[hit]] = probe[hit], met[hit]
            step += 1
            far = np.maximum(centre[open_] - first_a[open_], last_a[open_] - 1 - centre[open_])
            open_ = open_[(cut_a[open_] < 0) & ((step + 1) // 2 <= far)]
        none = cut_a < 0
        leaf_a.append(last_a[none])
        leaf_b.append(last_b[none])
        first_a, last_a, first_b, last_b, cut_a, cut_b = (x[~none] for x in (first_a, last_a, first_b, last_b, cut_a, cut_b))
        first_a, last_a = np.stack([first_a, cut_a + 1], 1).ravel(), np.stack([cut_a, last_a], 1).ravel()
        first_b, last_b = np.stack([first_b, cut_b + 1], 1).ravel(), np.stack([cut_b, last_b], 1).ravel()
    return np.sort(np.concatenate(leaf_a)), np.sort(np.concatenate(leaf_b))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each stands."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values)))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def links(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, owner: np.ndarray, n_second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, id pair (first id * n_second + second id) and how often the owner links it, sorted by both. a, b: ids; sizes: tokens of each group."""
    begin_a, begin_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    many = sizes_a * sizes_b
    narrow = np.flatnonzero(many <= WIDE)
    n = many[narrow]
    group = np.repeat(narrow, n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    i, j = np.divmod(k, sizes_b[group])
    keys = (owner[group] << 34) | (a[begin_a[group] + i].astype(np.int64) * n_second + b[begin_b[group] + j])
    keys, times = _runs(np.sort(keys))
    wide_keys, wide_times = [], []
    for g in np.flatnonzero(many > WIDE).tolist():
        x, nx = _runs(np.sort(a[begin_a[g] : begin_a[g] + sizes_a[g]].astype(np.int64)))
        y, ny = _runs(np.sort(b[begin_b[g] : begin_b[g] + sizes_b[g]].astype(np.int64)))
        wide_keys.append((owner[g] << 34) | (x[:, None] * n_second + y[None, :]).ravel())
        wide_times.append((nx[:, None] * ny[None, :]).ravel())
    if wide_keys:
        keys, times = _summed(np.concatenate([keys, *wide_keys]), np.concatenate([times, *wide_times]))
    return keys >> 34, keys & ((1 << 34) - 1), times


def _joined(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each group's ids in decimal, comma-joined."""
    said = pa.array(ids).cast(pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), said), ",")


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
ALIGNED_TYPES = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _aligned(folder: str, first: str, second: str):
    """Rows doc_id, text -> ALIGNED."""

    def some(pair: Pair, texts: list[str | None]) -> list[pa.Array]:
        rows = [k for k, t in enumerate(texts) if t]
        said = [texts[k] for k in rows]
        ids = pair.tokens(said)
        whole = [(" " + t).encode() for t in said]
        n_bytes = np.array([len(w) for w in whole], np.int64)

        def side(which: int, entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ids of all texts, tokens of each, and whether a text's tokens give its bytes back."""
            flat = np.frombuffer(b"".join([x[which] for x in ids]), np.int32)
            n = np.array([len(x[which]) // 4 for x in ids], np.int64)
            ends = np.append(0, np.cumsum(entries.sizes[flat]))
            last = np.cumsum(n)
            size = ends[last] - ends[last - n]
            good = size == n_bytes
            data = entries.joined(flat)
            original = np.frombuffer(b"".join(whole), np.uint8)
            if not (good.all() and np.array_equal(data, original)):
                at, begin = ends[last - n], np.cumsum(n_bytes) - n_bytes
                for k in np.flatnonzero(good).tolist():
                    good[k] = data[at[k] : at[k] + size[k]].tobytes() == whole[k]
            return flat, n, good

        a, n_a, good_a = side(0, pair.a)
        b, n_b, good_b = side(1, pair.b)
        good = good_a & good_b
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            rows, n_a, n_b = [r for r, g in zip(rows, good.tolist(), strict=True) if g], n_a[good], n_b[good]
        ends_a, ends_b = np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b])
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        cut_a, cut_b = shared_cuts(ends_a, ends_b, last_a - n_a, last_a - 1, last_b - n_b, last_b - 1)
        sizes_a, sizes_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        owner = np.searchsorted(last_a, cut_a, side="right")
        n_groups = np.bincount(owner, minlength=len(rows))
        n_links = np.zeros(len(rows), np.int64)
        np.add.at(n_links, owner, sizes_a * sizes_b)
        groups = pc.binary_join_element_wise(_joined(a, sizes_a), _joined(b, sizes_b), "|")
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_groups)), pa.int32()), groups)
        digests = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in pc.binary_join(lists, ";")]
        who, pairs, times = links(a, b, sizes_a, sizes_b, owner, len(pair.second.entries))

        full = np.zeros((4, len(texts)), np.int64)
        full[:, rows] = [n_a, n_b, n_groups, n_links]
        shas = np.full(len(texts), "", object)
        shas[rows] = digests
        many = np.zeros(len(texts), np.int64)
        many[rows] = np.bincount(who, minlength=len(rows))
        offsets = pa.array(np.append(0, np.cumsum(many)), pa.int32())
        return [*map(pa.array, full), pa.array(shas, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair = _loaded(folder, first, second)
        for batch in batches:
            texts = batch.column("text")
            total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + GROUP_BYTES, side="right")))
                made = some(pair, texts.slice(at, upto - at).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, upto - at), *made], schema=pa.schema([(c.split()[0], t) for c, t in zip(ALIGNED.split(", "), ALIGNED_TYPES, strict=True)]))
                at = upto

    return run


def align(docs: DataFrame, folder: str = TOKENIZERS, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct id pairs, first id times the second
    vocabulary's size plus second id), times (how often each is linked)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(folder, first, second), ALIGNED)


def pair_counts(aligned: DataFrame, n_second: int) -> DataFrame:
    """pair, docs (how many documents link it), best (whether no pair of its first id has more)."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counted = settle_as_table(counted.select("pair", F.expr(f"pair div {n_second}").alias("a"), "docs"), "counts")
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"


def _scored(common):
    """Rows of ALIGNED with row -> the sums over common pairs, and the pairs that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = common.value
        for batch in batches:
            lists = batch.column("pairs")
            many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            owner = np.repeat(np.arange(len(many)), many)
            sums, n_best = np.zeros(len(many), np.int64), np.zeros(len(many), np.int64)
            if hit.any():
                np.add.at(sums, owner[hit], times[hit] * docs[at[hit]])
                np.add.at(n_best, owner[hit], times[hit] * best[at[hit]])
            left = pa.array(np.append(0, np.cumsum(np.bincount(owner[~hit], minlength=len(many)))), pa.int32())
            made = [*(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), pa.array(n_best), pa.array(sums)]
            made += [pa.ListArray.from_arrays(left, pa.array(v[~hit])) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def scores(aligned: DataFrame, n_second: int, common: int = COMMON) -> DataFrame:
    """aligned -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. aligned is read more than once."""
    spark = aligned.sparkSession
    counts = settle_as_table(pair_counts(aligned, n_second), "pair_counts")
    top = counts.orderBy(F.desc("docs"), "pair").limit(common).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "docs", "best")))
    done = settle_as_table(aligned.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scored(sent), SCORED), "scored")
    rest = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("docs")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a)
    return done.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")


def op13(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    aligned = settle_as_table(align(table(spark, sf_dir, "documents").select("doc_id", "text"), folder), "aligned")
    return scores(aligned, len(PieceTokens(os.path.join(folder, SECOND)).entries))
