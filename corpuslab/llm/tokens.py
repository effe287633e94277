"""Token ids by the ``tokenizers`` library, with a table of units already met.

A byte-level tokenizer cuts a text by a fixed word pattern and encodes every
pre-token alone. At some places of a text a pre-token must end whatever stands
further off: where white space begins, around a lone line break, and between
ASCII letters, digits and other signs. A text is cut at these places, by whole
arrays of bytes at a time; a unit that is not known yet goes to the library
once, and its ids are kept. Where the bytes leave a doubt (signs outside ASCII,
runs of white space) no cut is made, so units may be longer than a pre-token
but never shorter. Texts that hold a special token go to the library whole, and
so do all texts where the file's pre-tokenizer is another one.

Much of a call's cost is by text, so new units go one behind the other as one
text where such a place lies between them; the bytes that each id stands for
tell their ids apart again.

The table holds at most ``UNITS`` units of at most 15 bytes, in flat arrays of
about 60 bytes a unit. When it is full, the half that was met least recently
goes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from corpuslab.llm import kernels as K

UNITS = 1 << 20  # half of the slots
#: Bytes that are encoded at a time.
CHUNK = 1 << 19
#: New units that go to the library as one text.
JOINED = 64
U64 = np.uint64

LETTER, DIGIT, SIGN, QUOTE, BLANK, BREAK, ODD = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, ODD, np.uint8)
    out[0x21:0x7F] = SIGN
    out[[*range(0x30, 0x3A)]] = DIGIT
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    out[0x27], out[0x20] = QUOTE, BLANK
    out[0x09:0x0E] = BREAK
    return out


def _ends() -> np.ndarray:
    """[class before, class after]: a pre-token ends between the two, whatever stands around them."""
    out = np.zeros((7, 7), dtype=bool)
    for a in (LETTER, DIGIT, SIGN):
        out[a, [b for b in (LETTER, DIGIT, SIGN) if b != a]] = True
    out[[LETTER, DIGIT], QUOTE] = True  # a quote may begin a contraction: nothing is cut behind it
    out[np.ix_([LETTER, DIGIT, SIGN, QUOTE, ODD], [BLANK, BREAK])] = True  # ODD is looked at again
    return out


CLASS, ENDS = _classes(), _ends().ravel()
#: First bytes of white space outside ASCII.
SPACE_LEAD = np.zeros(256, dtype=bool)
SPACE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_loaded: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def cut_places(b: np.ndarray) -> np.ndarray:
    """Where units begin in ``b``, apart from the beginnings of texts."""
    n = len(b)
    kind = CLASS[b]
    latin = np.flatnonzero(b == 0xC3)  # two-byte letters, but for two signs
    latin = latin[latin < n - 1]
    latin = latin[~np.isin(b[latin + 1], (0x97, 0xB7))]
    kind[latin] = kind[latin + 1] = LETTER
    end = ENDS[kind[:-1] * np.uint8(7) + kind[1:]]
    doubt = np.flatnonzero(end & (kind[:-1] == ODD)) + 1
    if len(doubt):
        one, two, three = (b[np.maximum(doubt - k, 0)] for k in (1, 2, 3))
        space = (one < 0x80) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (SPACE_LEAD[three] & (three != 0xC2))
        end[doubt[space] - 1] = False
    lone = np.flatnonzero((kind[1:-1] == BREAK) & end[:-1]) + 1 if n > 2 else np.zeros(0, np.int64)
    after = kind[lone + 1]
    lone = lone[(after < BLANK) | ((after == ODD) & (b[lone + 1] >= 0x80) & ~SPACE_LEAD[b[lone + 1]])]
    end[lone] = True
    return np.flatnonzero(end) + 1


class Table:
    """Open addressing in arrays: 16-byte keys to runs of ids."""

    def __init__(self, most: int, dtype: np.dtype):
        self.most, self.dtype = most, dtype
        self.bits = (2 * most - 1).bit_length()
        self.time = 0
        self._empty(np.zeros(1024, dtype))

    def _empty(self, pool: np.ndarray) -> None:
        n = 1 << self.bits
        self.k0, self.k1 = np.zeros(n, U64), np.zeros(n, U64)  # k1 is never 0 where a key stands
        self.at, self.n, self.met = np.zeros(n, np.int32), np.zeros(n, np.uint8), np.zeros(n, np.int32)
        self.pool, self.used, self.count = pool, 0, 0

    def _first(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        return (K.mix64(k0 ^ K.mix64(k1)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not known."""
        slot = self._first(k0, k1)
        out = np.full(len(k0), -1, np.int64)
        todo = np.arange(len(k0))
        while len(todo):
            held = self.k1[slot]
            same = (held == k1[todo]) & (self.k0[slot] == k0[todo])
            out[todo[same]] = slot[same]
            on = np.flatnonzero(~same & (held != 0))
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        self.met[out[out >= 0]] = self.time
        return out

    def add(self, k0: np.ndarray, k1: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new keys with ``n`` ids each; at most ``room()`` of them."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        self.used += len(ids)
        self.count += len(k0)
        slot, todo = self._first(k0, k1), np.arange(len(k0))
        while len(todo):
            free = self.k1[slot] == 0
            s, t = slot[free], todo[free]
            self.k0[s], self.k1[s] = k0[t], k1[t]  # of several keys for one slot the last stays
            won = np.zeros(len(todo), dtype=bool)
            won[np.flatnonzero(free)] = (self.k0[s] == k0[t]) & (self.k1[s] == k1[t])
            s, t = slot[won], todo[won]
            self.at[s], self.n[s], self.met[s] = at[t], n[t], self.time
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def room(self, wanted: int) -> int:
        """How many keys may be added, after making room for ``wanted``."""
        if self.count + wanted > self.most and self.count > self.most // 2:
            full = np.flatnonzero(self.k1)
            keep = full[np.argpartition(-self.met[full], self.most // 2)[: self.most // 2]]
            k0, k1, n, met = self.k0[keep], self.k1[keep], self.n[keep].astype(np.int64), self.met[keep]
            ids = self.pool[ragged(self.at[keep].astype(np.int64), n)]
            self._empty(np.zeros(len(self.pool), self.dtype))
            self.add(k0, k1, n, ids)
            self.met[self.find(k0, k1)] = met
        return self.most - self.count


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _found(raw: bytes, words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Where each of ``words`` stands, overlaps too: first byte and the one behind the last."""
    for w in words:
        at = raw.find(w)
        while at >= 0:
            yield at, at + len(w)
            at = raw.find(w, at + 1)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("u2") if self.size <= 1 << 16 else np.dtype("u4")
        with open(path) as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.cuttable = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # A byte-level token has a character for each byte.
        self.width = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)
        for t in spec.get("added_tokens", []):
            self.width[t["id"]] = len(t["content"].encode())
        self.table = Table(UNITS, self.dtype)

    def _library(self, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many each has) of b[bounds[i]:bounds[i + 1]], none of them empty."""
        heads = self._heads(b, bounds)
        ids, n = self._call(b, bounds[heads])
        if len(heads) == len(bounds):
            return ids, n
        ends = np.cumsum(self.width[ids])
        after = np.searchsorted(ends, bounds[1:])
        if len(ids) and ends[-1] == len(b) and (ends[np.minimum(after, len(ids) - 1)] == bounds[1:]).all():
            return ids, np.diff(after + 1, prepend=0)
        return self._call(b, bounds)  # bytes that are no UTF-8 were replaced

    def _call(self, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) with a text of its own for each range of ``bounds``."""
        raw, at = b.tobytes(), bounds.tolist()
        texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:], strict=False)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(n.sum())), n

    def _heads(self, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which bounds part the texts of a call: all but those where a pre-token must end, and around special tokens all."""
        apart = np.ones(len(bounds), dtype=bool)
        if self.cuttable:
            mark = np.ones(len(b) + 1, dtype=bool)
            mark[cut_places(b)] = False
            apart = mark[bounds]
            apart[::JOINED] = True
            for first, stop in _found(b.tobytes(), self.special):
                lo, hi = np.searchsorted(bounds, [first, stop], side="right")
                apart[lo - 1 : hi + 1] = True
            apart[[0, -1]] = True
        return np.flatnonzero(apart)

    def _starts(self, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where units begin: at each text that is not empty, and at the cuts of those without special tokens."""
        begins = bounds[:-1][np.diff(bounds) > 0]
        if not self.cuttable:
            return begins
        mark = np.zeros(len(b) + 1, dtype=bool)
        mark[cut_places(b)] = True
        raw = b.tobytes() if self.special else b""
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(bounds, at, side="right")) - 1
                mark[bounds[row] : bounds[row + 1]] = False
                at = raw.find(s, max(at + 1, int(bounds[row + 1]) - len(s) + 1))
        mark[begins] = True
        return np.flatnonzero(mark[:-1])

    def _encode(self, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end) of b[bounds[i]:bounds[i + 1]]."""
        starts = self._starts(b, bounds)
        size = np.diff(np.append(starts, len(b)))
        table, n = self.table, np.zeros(len(starts), np.int64)
        table.time += 1
        short = np.flatnonzero(size <= 15)
        padded = np.concatenate([b, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(b) + 9,), "<u8", padded, strides=(1,))
        long = size[short].astype(U64)
        k0 = eight[starts[short]] & MASK[np.minimum(size[short], 8)]
        k1 = eight[starts[short] + 8] & MASK[np.maximum(size[short] - 8, 0)] | (long << U64(56))
        slot = table.find(k0, k1)
        new = np.flatnonzero(slot < 0)
        direct: list[np.ndarray] = [np.flatnonzero(size > 15)]
        if len(new):
            order = new[np.lexsort((k0[new], k1[new]))]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (k0[order][1:] != k0[order][:-1]) | (k1[order][1:] != k1[order][:-1])
            distinct = order[first]
            fit = min(len(distinct), table.room(len(distinct)))
            some = distinct[:fit]
            some = some[np.argsort(b[starts[short[some]]] != 0x20, kind="stable")]  # those that begin with a space can stand behind any word
            ids, got = self._library(b[ragged(starts[short[some]], size[short[some]])], np.append(0, np.cumsum(size[short[some]])))
            table.add(k0[some], k1[some], got, ids)
            slot = table.find(k0, k1)  # making room moves what was found before
            direct.append(short[slot < 0])
        known = np.flatnonzero(slot >= 0)
        at = np.zeros(len(starts), np.int64)
        at[short[known]] = table.at[slot[known]]
        n[short[known]] = table.n[slot[known]]
        rest = np.concatenate(direct)
        if len(rest):
            texts = [b[x : x + y].tobytes() for x, y in zip(starts[rest].tolist(), size[rest].tolist(), strict=True)]
            place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            ids, got = self._library(np.frombuffer(b"".join(place), np.uint8), np.cumsum([0, *map(len, place)]))
            which = np.fromiter((place[t] for t in texts), np.int64, len(texts))
            n[rest], at[rest] = got[which], table.used + (np.cumsum(got) - got)[which]
            pool = np.concatenate([table.pool[: table.used], ids])
        else:
            pool = table.pool
        after = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(n, out=after[1:])
        return pool[ragged(at, n)], after[np.searchsorted(starts, bounds)]

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, ids, bounds) for texts i..j: text i + k has ids[bounds[k]:bounds[k + 1]], ``end_id`` the last.

        Null counts as empty. Memory follows ``CHUNK`` or the longest text.
        """
        data, offsets = K.text_buffers(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))
        for i, j in K.chunks(offsets, CHUNK):
            lo = int(offsets[i])
            b, bounds = data[lo : int(offsets[j])], offsets[i : j + 1] - lo
            ids, where = self._encode(b, bounds) if len(b) else (np.zeros(0, self.dtype), np.zeros(j - i + 1, np.int64))
            if end_id is not None:
                ids = np.insert(ids, where[1:], self.dtype.type(end_id))
                where = where + np.arange(j - i + 1)
            yield i, j, ids, where
