"""Words and hashes of many texts at once, by numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; the arrays take some 50 times as much.
SLICE_BYTES = 1_500_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for groups of rows with about SLICE_BYTES; null counts as empty.

    A longer text is a group of its own, so that it stays whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def lower_table(separators: bytes) -> np.ndarray:
    """For each byte: 0 for the separators, else the byte with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: Words split by [\x20\x09-\x0D]; NUL is moved to a byte that UTF-8 never uses, as 0 marks separators.
SPACE_WORDS = lower_table(b"\x20\x09\x0a\x0b\x0c\x0d")
SPACE_WORDS[0] = 0xFF
#: Words of 0-9, a-z (after lower-casing) and all that isn't ASCII.
ALNUM_WORDS = lower_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Words:
    """codes: bytes by the table; starts, ends: of each word; first: the index of each text's first word, and the number of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.codes = table[data]
        n = len(self.codes)
        inside = self.codes != 0
        begins, closes = inside.copy(), np.zeros(n + 1, bool)
        begins[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < n]
        begins[edges] = inside[edges]
        closes[1:n] = inside[:-1] & ~inside[1:]
        if n:
            closes[n] = inside[-1]
        cut = edges[edges > 0]
        closes[cut] = inside[cut - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(closes)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.codes, self.starts, self.ends)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) joined by one space."""
        return b" ".join(x for x in self.codes[self.starts[a] : self.ends[b - 1]].tobytes().split(b"\0") if x) if b > a else b""


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span, from prefix sums."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words in a row, across texts too: callers drop those."""
    if len(words) < k:
        return np.zeros(0, U64)
    total = np.full(len(words) - k + 1, k, U64)
    for j in range(k):
        total = total * U64(_BASE) + words[j : j + len(total)]
    return mix(total)
