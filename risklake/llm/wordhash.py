"""Word boundaries and 64-bit word hashes of whole Arrow batches in numpy, inside Spark tasks.

A word's hash depends on its normalised bytes alone. A window's hash depends on its words' hashes in order. Bytes are
hashed a few MB at a time, cut at word starts, so memory follows the batch and not a square or a multiple of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2_000_000
GROUP_BYTES = 4_000_000
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
#: Bases of a second hash, for equality by 128 bits.
BYTE_BASE_2 = 0xA0761D6478BD642F
WORD_BASE_2 = 0xE7037ED1A0B428DB


def ascii_space_table() -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged; separators are 0, and the byte 0, which is a word byte there, becomes 255 (never in UTF-8)."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def alphanumeric_table() -> np.ndarray:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z: digits, a-z and all beyond ASCII."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    table[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
    return table


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64; base is odd."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, b, np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers, dtype=np.uint64))
    return both[0], both[1]


def _room(n: int) -> int:
    """Sizes in powers of two, so that few tables of powers are made."""
    return 1 << max(16, int(n).bit_length())


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a group of documents: data (normalised bytes), starts and ends (byte offsets in data), docs (offsets of
    each document's first word, one more at the end) and origin (byte offset of each document)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.raw, self.origin = data, offsets
        self.data = table[data]
        inside = self.data != 0
        if len(inside):
            before, after = np.empty_like(inside), np.empty_like(inside)
            before[1:], before[0] = inside[:-1], False
            after[:-1], after[-1] = inside[1:], False
            cuts = offsets[1:-1]
            before[cuts[cuts < len(inside)]] = False
            after[cuts[cuts > 0] - 1] = False
            self.starts = np.flatnonzero(inside & ~before)
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        self.docs = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, base: int = BYTE_BASE) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + CHUNK_BYTES, side="right")))
            first, last = self.starts[at], self.ends[upto - 1]
            up, down = _powers(base, _room(last - first))
            total = np.zeros(last - first + 1, np.uint64)
            np.cumsum(self.data[first:last].astype(np.uint64) * up[: last - first], dtype=np.uint64, out=total[1:])
            a, b = self.starts[at:upto] - first, self.ends[at:upto] - first
            out[at:upto] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
            at = upto
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, first: int, last: int) -> bytes:
        """Words first to last - 1, one separator between two."""
        return b"\0".join(self.word(i) for i in range(first, last))

    def owner(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))


def window_hashes(hashes: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of the n words from each place on; len(hashes) - n + 1 of them, or none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    up, down = _powers(base, _room(len(hashes) + 1))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64, out=total[1:])
    last = len(hashes) - n + 1
    return mix((total[n:] - total[:last]) * down[:last] + np.uint64(n))


def text_groups(texts: pa.Array, table: np.ndarray, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Slices of a batch's texts of about group_bytes, as first row, last row + 1 and their Words; nulls are empty."""
    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        texts = pc.fill_null(texts, b"")
    else:
        texts = pc.fill_null(texts.cast(pa.large_string()) if not pa.types.is_string(texts.type) else texts, "")
    kind = np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + group_bytes, side="right")) - 1)
        yield at, upto, Words(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at], table)
        at = upto
