r"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed against reference blocks of the documents before it; a factor of WINDOW words or more, equal word by
word to an earlier place (smaller doc_id, or the same document and an earlier start), is a duplicate span.

1. Index. A window's block is the smallest-hashed BLOCK-word piece in it, so equal windows have equal blocks wherever
   they stand; about two blocks for every window length are kept per document. A shuffle by block names for each holder an
   earlier one, its reference (the first of all, or the first within the same batch of rows).
2. Parse. The references' words around the blocks, in chunks of CHUNK words, meet the documents that refer to them. From
   left to right, each block that no factor holds yet is extended over equal words in both directions: a factor (start,
   length, reference, start there).
3. Factor boundaries. A window that lies in no factor, though its block is shared, may have its whole sequence at another place
   than its block's reference, as where one reference ends and another goes on. Those windows only are looked up whole, by
   128-bit hashes; one found at an earlier place is a factor of WINDOW words. The first place of a sequence lies in no factor
   (a factor has an earlier place), so it is always among the windows that are looked up, and no repeat is lost.
   Sequences that repeat within a document are found there.

Skew. A batch of documents sends one row for each block or window it holds, however often; the batch's other holders refer to
its first one. So a passage that a third of all documents share is a row per batch, and so are the requests for its
chunks. Exact copies are settled by text hashes and never parsed. Tasks read their sorted rows in a stream and hold one
run's first row; what one document collects (blocks, chunks, factors) is bounded by its own length.

Cases. A null text has no words. A document of fewer than WINDOW words loses none. Rows that repeat whole are one
document and get the same result; different texts under one doc_id are ordered by a hash of the text. A null doc_id
comes before all others. An empty table gives no rows. Other columns are kept by `remove_repeats` and not read otherwise.
Whole texts are compared by two 64-bit hashes and their length; documents are told apart by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.llm.common import settle, settle_as_table, table
from risklake.llm.wordhash import BYTE_BASE_2, WORD_BASE_2, Words, ascii_space_table, text_groups, window_hashes

WINDOW = 20
BLOCK = 6
#: Words of a reference that are sent together.
CHUNK = 64


def _slide(pick: np.ufunc, values: np.ndarray, n: int) -> np.ndarray:
    """Smallest (np.minimum) or largest (np.maximum) of each n values in a row."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _hashed(texts: pa.Array) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of documents: first row, words, word hashes, hashes of all pieces, and for each window its block: the smallest of its pieces."""
    for first, _, words in text_groups(texts, ascii_space_table()):
        if len(words) >= WINDOW:
            hashes = words.hashes()
            pieces = window_hashes(hashes, BLOCK)
            yield first, words, hashes, pieces, _slide(np.minimum, pieces, WINDOW - BLOCK + 1)


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of documents: of each place that is the block of some window its row, start in the document and hash."""
    for first, words, _, pieces, blocks in _hashed(texts):
        owner = words.owner()
        inside = owner[: len(blocks)] == owner[WINDOW - 1 :]
        n = WINDOW - BLOCK + 1
        room = np.zeros(n - 1, np.uint64)
        over = _slide(np.maximum, np.concatenate([room, np.where(inside, blocks, np.uint64(0)), room]), n)
        at = np.flatnonzero(over == pieces)
        yield owner[at] + first, at - words.docs[owner[at]], pieces[at]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Mask of the first row of each run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _ranks(ids: pa.Array, dkeys: pa.Array) -> np.ndarray:
    """Each row's place in the documents' order."""
    rank = np.empty(len(ids), np.int64)
    order = pc.sort_indices(pa.table({"id": ids, "dkey": dkeys}), sort_keys=[("id", "ascending"), ("dkey", "ascending")], null_placement="at_start")
    rank[order.to_numpy()] = np.arange(len(ids))
    return rank


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


BLOCK_NAMES = ["route", "block", "doc_id", "dkey", "start", "times", "ref", "ref_start"]


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dkey, text) -> BLOCK_NAMES. The batch's first holder of a block goes to the block's task; the other holders have
    that one for their reference and go to their own. times: 2 if the block is shared already, 0 for the others."""
    for batch in batches:
        ids, dkeys = batch.column(0), batch.column(1).to_numpy()
        found = [*_blocks(batch.column(2)), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        row, start, block = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, _ranks(ids, batch.column(1))[row], block))
        row, start, block = row[order], start[order], block[order].view(np.int64)
        new = _first_of(block)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(block)))
        head = starts[np.cumsum(new) - 1] if len(block) else starts
        other = ~new & _first_of(block, dkeys[row]) & (dkeys[row] != dkeys[row[head]])
        times = np.where(sizes > 1, 2, 1).astype(np.int8)
        keep = np.concatenate([starts, np.flatnonzero(other)])
        known = np.arange(len(keep)) >= len(starts)
        own = dkeys[row[keep]]
        yield _batch(
            BLOCK_NAMES,
            np.where(known, own, block[keep]),
            block[keep],
            ids.take(pa.array(row[keep])),
            own,
            start[keep].astype(np.int32),
            np.concatenate([times, np.zeros(other.sum(), np.int8)]),
            pa.array(dkeys[row[head[keep]]], mask=~known),
            pa.array(start[head[keep]].astype(np.int32), mask=~known),
        )


def _shared_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and document -> dkey, block, ref, ref_start of all holders of shared blocks; the first holder has no reference."""
    held = None
    for batch in batches:
        block, dkey, start, times = (batch.column(k).to_numpy() for k in (1, 3, 4, 5))
        known = times == 0
        passed = pa.array(known)
        out = [_batch(["dkey", "block", "ref", "ref_start"], *(batch.column(k).filter(passed) for k in (3, 1, 6, 7)))]
        block, dkey, start, times = (x[~known] for x in (block, dkey, start, times))
        done = np.zeros(len(block), bool)
        if held is not None:
            block, dkey, start, times, done = (np.concatenate([[h], x]) for h, x in zip(held, (block, dkey, start, times, done), strict=True))
        if len(block):
            new = _first_of(block)
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            shared = np.add.reduceat(times.astype(np.int64), starts) > 1
            emit = np.flatnonzero(shared[run] & ~done)
            head = starts[run[emit]]
            same = dkey[emit] == dkey[head]
            out.append(_batch(["dkey", "block", "ref", "ref_start"], dkey[emit], block[emit], pa.array(dkey[head], mask=same), pa.array(start[head].astype(np.int32), mask=same)))
            last = starts[-1]
            held = (block[last], dkey[last], start[last], np.int8(2 if shared[-1] else 1), shared[-1])
        yield from out


def _unpacked(column: pa.Array) -> list[bytes]:
    unzip = zstandard.ZstdDecompressor()
    return [unzip.decompress(x) if x else b"" for x in column.to_pylist()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dkey, text) -> the words joined by one space, compressed: what the shuffle by document carries."""
    for batch in batches:
        squeeze = zstandard.ZstdCompressor(level=1)
        z = [squeeze.compress(b" ".join((x or "").encode("utf-8", "surrogatepass").split())) for x in batch.column(2).to_pylist()]
        yield _batch(["doc_id", "dkey", "z"], batch.column(0), batch.column(1), pa.array(z, pa.binary()))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dkey, z, chunks) -> ref, chunk, words: the chunks asked for, their words joined by one space."""
    for batch in batches:
        refs, numbers, said = [], [], []
        for dkey, text, wanted in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split(b" ")
            for c in wanted:
                if c * CHUNK < len(words):
                    refs.append(dkey)
                    numbers.append(c)
                    said.append(b" ".join(words[c * CHUNK : (c + 1) * CHUNK]))
        yield _batch(["ref", "chunk", "words"], pa.array(refs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(said, pa.binary()))


def greedy_factors(words: list[bytes], anchors: list[tuple[int, int, int]], said: dict[int, dict[int, list[bytes]]]) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, ref, ref_start) of a document. anchors: place, ref and place there, by place; said: chunks of each ref.

    A factor may begin in the last WINDOW - 1 words of the one before, so that windows over the boundary lie in it."""
    found, end = [], 0
    for place, ref, at in anchors:
        have = said.get(ref)
        if have is None or place + BLOCK <= end:
            continue
        i, j = place, at
        while (part := have.get(j // CHUNK)) is not None:
            theirs = part[j % CHUNK :]
            mine = words[i : i + len(theirs)]
            same = len(theirs) if mine == theirs else next((k for k, (x, y) in enumerate(zip(mine, theirs, strict=False)) if x != y), len(mine))
            i, j = i + same, j + same
            if same < len(theirs) or j % CHUNK:
                break
        a, b, least = place, at, max(0, end - WINDOW + 1)
        while a > least and b > 0 and (part := have.get((b - 1) // CHUNK)) is not None and part[(b - 1) % CHUNK] == words[a - 1]:
            a, b = a - 1, b - 1
        if i - a >= WINDOW:
            found.append((a, i - a, ref, b))
            end = i
    return found


FOUND_NAMES = ["route", "window", "window2", "doc_id", "dkey", "start", "length", "ref", "ref_start"]


def _factor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dkey, z, blocks, chunks) -> FOUND_NAMES: each document's factors, and its windows that lie in none though their block is
    shared. Of a window in several of the batch's documents only the first document's row goes to the window's task; the
    others have that one for their reference. Rows with a reference go to their document."""
    for batch in batches:
        by_name = dict(zip(batch.schema.names, batch.columns, strict=True))
        ids, dkeys, texts = by_name["doc_id"], by_name["dkey"].to_numpy(), _unpacked(by_name["z"])
        lists = by_name["blocks"]
        sizes = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten()
        block = pc.struct_field(flat, "block").to_numpy().view(np.uint64)
        has_ref = pc.struct_field(flat, "ref").is_valid().to_numpy(zero_copy_only=False)
        ref, ref_start = (pc.struct_field(flat, c).fill_null(0).to_numpy() for c in ("ref", "ref_start"))
        row = np.repeat(np.arange(len(dkeys)), sizes)
        order = np.lexsort((block, row))
        block, has_ref, ref, ref_start = block[order], has_ref[order], ref[order], ref_start[order]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        chunks = by_name["chunks"]
        sent = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(chunks), 0).to_numpy())])
        chunks = chunks.flatten()
        chunk_ref, chunk_no = (pc.struct_field(chunks, c).to_numpy() for c in ("ref", "chunk"))
        chunk_words = pc.struct_field(chunks, "words")
        factors: list[tuple[int, int, int, int, int]] = []
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))]
        for first, words, hashes, pieces, blocks in _hashed(pa.array(texts, pa.large_binary())):
            whole = window_hashes(hashes, WINDOW)
            whole2 = window_hashes(words.hashes(BYTE_BASE_2), WINDOW, WORD_BASE_2)
            for k in range(len(words.docs) - 1):
                a, b = int(words.docs[k]), int(words.docs[k + 1])
                own = slice(edges[first + k], edges[first + k + 1])
                if b - a < WINDOW or own.start == own.stop:
                    continue
                known = block[own]
                free = np.ones(b - a - WINDOW + 1, bool)
                x, y = int(sent[first + k]), int(sent[first + k + 1])
                if x < y:
                    here = pieces[a : b - BLOCK + 1]
                    at = np.minimum(np.searchsorted(known, here), len(known) - 1)
                    places = np.flatnonzero((known[at] == here) & has_ref[own][at])
                    at = at[places]
                    said: dict[int, dict[int, list[bytes]]] = defaultdict(dict)
                    for r, c, z in zip(chunk_ref[x:y].tolist(), chunk_no[x:y].tolist(), chunk_words[x:y].to_pylist(), strict=True):
                        said[r][c] = z.split(b" ")
                    anchors = list(zip(places.tolist(), ref[own][at].tolist(), ref_start[own][at].tolist(), strict=True))
                    for start, length, *where in greedy_factors(texts[first + k].split(b" "), anchors, said):
                        factors.append((first + k, start, length, *where))
                        free[start : start + length - WINDOW + 1] = False
                over = blocks[a : b - WINDOW + 1]
                at = np.minimum(np.searchsorted(known, over), len(known) - 1)
                left = np.flatnonzero(free & (known[at] == over))
                keys, keys2 = whole[a + left], whole2[a + left]
                order = np.lexsort((left, keys2, keys))
                once = order[_first_of(keys[order], keys2[order])]
                found.append((np.full(len(once), first + k), left[once], keys[once], keys2[once]))
        row, start, window, window2 = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((_ranks(ids, by_name["dkey"])[row], window2, window))
        row, start, window, window2 = row[order], start[order], window[order].view(np.int64), window2[order].view(np.int64)
        new = _first_of(window, window2)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(row) else row
        known = ~new & (dkeys[row] != dkeys[row[head]])
        keep = np.flatnonzero(new | known)
        yield _batch(
            FOUND_NAMES,
            np.where(known, dkeys[row], window)[keep],
            window[keep],
            window2[keep],
            ids.take(pa.array(row[keep])),
            dkeys[row[keep]],
            start[keep].astype(np.int32),
            np.full(len(keep), WINDOW, np.int32),
            pa.array(dkeys[row[head]][keep], mask=~known[keep]),
            pa.array(start[head][keep].astype(np.int32), mask=~known[keep]),
        )
        if factors:
            row, start, length, ref, ref_start = (np.array(x) for x in zip(*factors, strict=True))
            none = pa.nulls(len(row), pa.int64())
            yield _batch(FOUND_NAMES, dkeys[row], none, none, ids.take(pa.array(row)), dkeys[row], start.astype(np.int32), length.astype(np.int32), ref, ref_start.astype(np.int32))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window and document -> dkey, start, length, ref, ref_start: the factors, and the windows that a document before has."""
    names = FOUND_NAMES[4:]
    held = None
    for batch in batches:
        settled = batch.column(7).is_valid()
        yield _batch(names, *(batch.column(k).filter(settled) for k in range(4, 9)))
        open_rows = pc.invert(settled)
        window, window2, dkey, start = (batch.column(k).filter(open_rows).to_numpy() for k in (1, 2, 4, 5))
        if held is not None:
            window, window2, dkey, start = (np.concatenate([[h], x]) for h, x in zip(held, (window, window2, dkey, start), strict=True))
        if len(window):
            new = _first_of(window, window2)
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = np.flatnonzero(dkey != dkey[head])
            where = head[later]
            yield _batch(names, dkey[later], start[later].astype(np.int32), np.full(len(later), WINDOW, np.int32), dkey[where], start[where].astype(np.int32))
            held = tuple(x[head[-1]] for x in (window, window2, dkey, start))


def _covered(n: int, factors: np.ndarray, words: Words) -> np.ndarray:
    """Mask of a document's words under its factors (rows of start, length) and under windows that it repeats."""
    windows = window_hashes(words.hashes(), WINDOW)
    _, first, same = np.unique(windows, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[same] != np.arange(len(windows)))
    if len(again):
        second = window_hashes(words.hashes(BYTE_BASE_2), WINDOW, WORD_BASE_2)
        order = np.lexsort((np.arange(len(windows)), second, windows))
        again = order[~_first_of(windows[order], second[order])]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    np.add.at(edges, factors[:, 0], 1)
    np.add.at(edges, factors[:, 0] + factors[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
    """Each row's words and the mask of those removed (None: none)."""
    by_name = dict(zip(batch.schema.names, batch.columns, strict=True))
    copies = by_name["is_copy"].to_pylist()
    for text, found, copy in zip(_unpacked(by_name["z"]), by_name["found"], copies, strict=True):
        words = text.split(b" ") if text else []
        if len(words) < WINDOW or not (found.is_valid or copy):
            yield words, None
        elif copy:
            yield words, np.ones(len(words), bool)
        else:
            factors = np.stack([pc.struct_field(found.values, c).to_numpy() for c in ("start", "length")], axis=1).astype(np.int64)
            yield words, _covered(len(words), factors, next(text_groups(pa.array([text], pa.large_binary()), ascii_space_table()))[2])


def _kept(words: list[bytes], removed: np.ndarray | None) -> list[bytes]:
    return words if removed is None else [w for w, gone in zip(words, removed.tolist(), strict=True) if not gone]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, shas = [], [], []
        for words, removed in _parsed(batch):
            n.append(len(words))
            gone.append(0 if removed is None else int(removed.sum()))
            shas.append(hashlib.sha256(b" ".join(_kept(words, removed))).hexdigest())
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        yield _batch(["doc_id", "n_words", "n_removed", "kept_sha256"], ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string()))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans, texts = [], []
        for words, removed in _parsed(batch):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))) if removed is not None else np.empty(0, np.int64)
            spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            texts.append(b" ".join(_kept(words, removed)).decode("utf-8", "surrogatepass"))
        ids, dkeys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "dkey"))
        yield _batch(["doc_id", "dkey", "spans", "kept_text"], ids, dkeys, pa.array(spans, kind), pa.array(texts, pa.string()))


def _fields(names: list[str], doc_id: T.DataType) -> T.StructType:
    kinds = {"doc_id": doc_id, "start": T.IntegerType(), "length": T.IntegerType(), "ref_start": T.IntegerType(), "times": T.ByteType(), "z": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds.get(n, T.LongType())) for n in names])


def _searched(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, text) -> packed documents; dkeys of exact copies; parsed documents' shared blocks; factors found in them."""
    kind = docs.schema["doc_id"].dataType
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dkey"), "text")
    packed = keyed.mapInArrow(_packed, _fields(["doc_id", "dkey", "z"], kind))

    text_key = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("n")]
    texts = keyed.select("doc_id", "dkey", *text_key)
    first = texts.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("times")).filter(F.col("times") > 1)
    # A table of its own, so that the join's shuffles feed nothing but the join and Spark can split a key with many copies.
    copies = texts.join(settle(first), ["h1", "h2", "n"]).filter(F.struct("doc_id") > F.col("first")).select("dkey").distinct()

    rows = keyed.mapInArrow(_block_rows, _fields(BLOCK_NAMES, kind)).repartition("route")
    shared = rows.sortWithinPartitions("block", "doc_id", "dkey").mapInArrow(_shared_blocks, _fields(["dkey", "block", "ref", "ref_start"], kind))
    control = settle_as_table(shared.join(copies, "dkey", "left_anti"), "blocks")

    around = [F.floor(at / CHUNK).cast("int") for at in (F.greatest(F.col("ref_start") - (WINDOW - BLOCK), F.lit(0)), F.col("ref_start") + WINDOW - 1)]
    needs = control.filter(F.col("ref").isNotNull()).select("dkey", "ref", F.explode(F.sequence(*around)).alias("chunk")).distinct()
    wanted = needs.groupBy("ref", "chunk").agg(F.lit(1)).groupBy("ref").agg(F.collect_list("chunk").alias("chunks"))
    slices = packed.join(wanted.hint("shuffle_hash"), packed["dkey"] == wanted["ref"]).select("dkey", "z", "chunks").mapInArrow(_chunk_rows, "ref long, chunk int, words binary")
    # Rows that repeat whole give their chunks once. A table, so that the join has shuffles of its own.
    slices = settle_as_table(slices.dropDuplicates(["ref", "chunk"]), "chunks")
    met = needs.join(slices, ["ref", "chunk"]).groupBy("dkey").agg(F.collect_list(F.struct("ref", "chunk", "words")).alias("chunks"))

    lists = control.groupBy("dkey").agg(F.collect_list(F.struct("block", "ref", "ref_start")).alias("blocks"))
    held = packed.join(lists.hint("shuffle_hash"), "dkey").join(met.hint("shuffle_hash"), "dkey", "left").select("doc_id", "dkey", "z", "blocks", "chunks")
    found = held.mapInArrow(_factor_rows, _fields(FOUND_NAMES, kind))
    later = found.repartition("route").sortWithinPartitions("window", "window2", "doc_id", "dkey").mapInArrow(_later, _fields(FOUND_NAMES[4:], kind))
    return packed, copies, control, later


def factors(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> dkey, start, length, ref, ref_start: the words [start, start + length) of document dkey (hash of doc_id and
    text) are those from ref_start on of the earlier document ref. Windows looked up side by side are one factor.
    Exact copies, and what a document repeats of itself, have none."""
    found = _searched(docs)[3].distinct().withColumn("shift", F.col("ref_start") - F.col("start"))
    line = Window.partitionBy("dkey", "ref", "shift").orderBy("start", "length")
    before = F.max(F.col("start") + F.col("length")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("part", F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.max(F.col("start") + F.col("length")) - F.min("start")
    made = found.groupBy("dkey", "ref", "shift", "part").agg(F.min("start").alias("start"), length.alias("length"), F.min("ref_start").alias("ref_start"))
    return made.select("dkey", "start", "length", "ref", "ref_start")


def _marked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, dkey, z, found (factors; null if the document was not parsed), is_copy."""
    packed, copies, control, later = _searched(docs)
    # A block that a document repeats makes it parsed even if no other document shares it, so its own repeats are found too.
    nothing = [F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length")]
    marks = later.select("dkey", "start", "length", F.lit(False).alias("copy"))
    marks = marks.unionByName(control.select("dkey").distinct().select("dkey", *nothing, F.lit(False).alias("copy")))
    marks = marks.unionByName(copies.select("dkey", *nothing, F.lit(True).alias("copy")))
    found = F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "length")))
    marks = marks.groupBy("dkey").agg(found.alias("found"), F.max("copy").alias("is_copy"))
    return packed.join(marks.hint("shuffle_hash"), "dkey", "left").select("doc_id", "dkey", "z", "found", F.coalesce("is_copy", F.lit(False)).alias("is_copy"))


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, dkey, spans (structs of start and end in words, the end not included), kept_text (the other words, joined by one space)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _marked(docs).mapInArrow(_spans, f"doc_id {kind}, dkey long, spans array<struct<start:int,end:int>>, kept_text string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the duplicate spans cut out of text; texts without any stay as they are."""
    found = duplicate_spans(docs.select("doc_id", "text")).filter(F.size("spans") > 0).dropDuplicates(["dkey"]).select("dkey", "kept_text")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("doc_id", "text").alias("dkey"))
    text = F.coalesce("kept_text", F.col("doc")["text"]).alias("text")
    joined = whole.join(found.hint("shuffle_hash"), "dkey", "left")
    return joined.select(*[text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _marked(docs).mapInArrow(_digests, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(words[p : p + 19], ' ') AS said FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM d WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY said ORDER BY doc_id, p) AS place FROM windows) WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS w FROM later
), lists AS (
  SELECT doc_id, list(w ORDER BY w) AS gone FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""
