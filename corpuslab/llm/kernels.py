"""Vectorised byte and word kernels over Arrow string arrays.

Texts are never joined across rows in meaning: every kernel keeps the row of
each word and masks windows that would cross a row. Work goes in chunks of a
few MB, so that memory is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64


def tidy() -> None:
    """Give freed memory back; a worker lives on between tasks beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over batches, tidied up after."""

    def wrapped(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(frames)
        finally:
            tidy()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that low bits depend on high ones."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // 65536) * 65536
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


BYTES, GRAMS, GRAMS2 = Powers(0x2545F4914F6CDD1D), Powers(0xC2B2AE3D27D4EB4F), Powers(0x165667B19E3779F9)
TABLE = mix64(np.arange(1, 257, dtype=U64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i+1]]; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of rows i..j: byte starts, ends, rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int):
        self.lo = int(offsets[i])
        self.bytes = data[self.lo : int(offsets[j])]
        self.bounds = offsets[i : j + 1] - self.lo
        solid = ~SPACE[self.bytes]
        n = len(solid)
        first = np.zeros(n + 1, dtype=bool)
        first[self.bounds] = True
        before = np.empty(n + 1, dtype=bool)
        before[0], before[1:] = False, solid
        after = np.empty(n + 1, dtype=bool)
        after[n], after[:n] = False, solid
        self.starts = np.flatnonzero(after & (~before | first))
        self.ends = np.flatnonzero(before & (~after | first))
        self.first = np.searchsorted(self.starts, self.bounds)  # of each row, and the end
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(j - i), self.counts)

    def hashes(self, bytes_: np.ndarray | None = None) -> np.ndarray:
        b = self.bytes if bytes_ is None else bytes_
        up, down = BYTES.upto(len(b) + 1)
        total = np.zeros(len(b) + 1, U64)
        np.cumsum(TABLE[b] * up[: len(b)], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix64(h + (self.ends - self.starts).astype(U64) * U64(0xA0761D6478BD642F))


def gram_hashes(symbols: np.ndarray, k: int, powers: Powers = GRAMS) -> np.ndarray:
    """Hashes of all windows of k symbols (uint64), rows not regarded."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers.upto(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(symbols * up[:n], out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[: n - k + 1])


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the windows of k symbols that start at 0..n-k lie within one row.

    ``first`` holds the first symbol of each row and, last, the end of all.
    """
    m = max(0, n - k + 1)
    step = np.zeros(n + 2, np.int32)
    cut = first[1:-1]
    np.add.at(step, np.maximum(cut - k + 1, 0), 1)
    np.add.at(step, cut, -1)
    return np.cumsum(step)[:m] == 0


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each i, the leftmost position of the least of h[i:i+w].

    Running minima from both sides of blocks of w. The low 8 bits of a value
    give way to its place in the block, so that ties go to the left.
    """
    n = len(h)
    blocks = -(-n // w)
    place = np.arange(blocks * w, dtype=U64) % U64(w)
    v = np.full(blocks * w, np.iinfo(U64).max, U64)
    v[:n] = h
    v = (v & ~U64(255)) | place
    v = v.reshape(blocks, w)
    head = np.minimum.accumulate(v, axis=1).ravel()
    tail = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    i = np.arange(m)
    left, right = tail[:m], head[w - 1 : w - 1 + m]
    take = (left >> U64(8)) <= (right >> U64(8))
    block = np.where(take, i // w, (i + w - 1) // w)
    return block * w + (np.where(take, left, right) & U64(255)).astype(np.int64)


class SuperWindows:
    """All windows of ``length`` symbols, grouped by their anchor.

    A window's anchor is its leftmost least gram of ``gram`` symbols, so equal
    windows have equal anchors at equal offsets. Consecutive windows of a row
    with the same anchor make one superwindow: ``n`` windows from symbol
    ``start`` on, ``length + n - 1`` symbols in all.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, length: int, gram: int):
        total = len(symbols)
        self.start = self.n = self.row = np.zeros(0, np.int64)
        self.anchor = self.whole = np.zeros(0, U64)
        at = np.flatnonzero(inside(first, length, total)) if total >= length else np.zeros(0, np.int64)
        if not len(at):
            return
        grams = gram_hashes(symbols, gram)
        low = window_minima(grams, length - gram + 1)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(low) != 0)
        head = np.flatnonzero(new)
        q, n, a = at[head], np.diff(np.append(head, len(at))), low[head]
        up, down = GRAMS2.upto(total + 1)
        run = np.zeros(total + 1, U64)
        np.cumsum(symbols * up[:total], out=run[1:])
        text = (run[q + n + length - 1] - run[q]) * down[q]
        self.anchor = grams[a]
        self.whole = mix64(text + n.astype(U64) * U64(0xD1B54A32D192ED03) + (a - q).astype(U64) * U64(0xABC98388FB8FAC03))
        self.row = np.searchsorted(first, q, side="right") - 1
        self.start, self.n = q - first[self.row], n
