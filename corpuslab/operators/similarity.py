"""Edit similarity: multiset overlap natively, sequence ratios in an Arrow function."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"(?U)\b\w+(?:['’-]\w+)*\b"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def overlap_ratio(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys, overlap): twice the shared tokens, counted with repeats, over all tokens of both texts.

    Rows that repeat their keys count as one pair of texts. A pair's tokens are
    sorted and folded where the pair lies, so memory follows the longest pair
    and no row a token is made.
    """
    side = lambda c, i: F.transform(F.flatten(F.transform(F.col(c), tokens)), lambda t: F.struct(t.alias("token"), F.lit(i).alias("side")))
    texts = pairs.groupBy(*keys).agg(F.collect_list(left).alias("__l"), F.collect_list(right).alias("__r"), F.count("*").alias("__n"))
    marked = F.sort_array(F.concat(side("__l", 0), side("__r", 1)))
    # (token, its number on both sides, shared tokens of all before it); the left side of a token comes first.
    start = F.struct(F.lit("").alias("token"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("shared"))

    def step(held: Column, x: Column) -> Column:
        same, of_b = held["token"] == x["token"], x["side"]
        shared = held["shared"] + F.when(same, F.lit(0)).otherwise(F.least(held["a"], held["b"]))
        a, b = (F.when(same, held[c]).otherwise(F.lit(0)) for c in ("a", "b"))
        return F.struct(x["token"].alias("token"), (a + 1 - of_b).alias("a"), (b + of_b).alias("b"), shared.alias("shared"))

    ratio = lambda held, n: F.when(n > 0, 2 * (held["shared"] + F.least(held["a"], held["b"])) / n)
    whole = F.transform(F.array(marked), lambda m: ratio(F.aggregate(m, start, step), F.size(m)))  # as a variable, sorted once
    out = texts.select(*keys, F.coalesce(F.get(whole, F.lit(0)), F.lit(0.0)).alias("overlap"), "__n")
    return out.select(*keys, "overlap", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))).alias("__n")).drop("__n")


#: Pairs of places of two texts that are laid out at a time; a larger pair goes to ``difflib``, whose memory is linear.
CELLS = 1 << 21


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, length) of all longest runs of equal characters, diagonal by diagonal."""
    if len(a) > len(b):
        j, i, n = _runs(b, a)
        return i, j, n
    m, out = len(a), np.full(2 * len(a) + len(b) - 2, -1, a.dtype)
    out[m - 1 : m - 1 + len(b)] = b
    equal = np.zeros((len(b) + m - 1, m + 1), dtype=bool)
    np.equal(np.lib.stride_tricks.sliding_window_view(out, m), a, out=equal[:, :m])
    flat = np.append(False, equal.ravel())
    edge = np.flatnonzero(flat[1:] != flat[:-1])
    row, i = np.divmod(edge[::2], m + 1)
    return i, row + i - (m - 1), edge[1::2] - edge[::2]


def _matched(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many characters of each pair ``difflib`` matches: the longest run, the leftmost of equal ones, then both sides of it likewise.

    All pairs go at once, a level of the recursion a round: each open block
    takes its best run, and the runs are cut to the blocks left and right of it.
    """
    found = [_runs(a, b) if len(a) and len(b) else (np.zeros(0, np.int64),) * 3 for a, b in pairs]
    i, j, n = (np.concatenate([f[k] for f in found]) for k in range(3))
    block = np.repeat(np.arange(len(pairs)), [len(f[0]) for f in found])
    owner, total = np.arange(len(pairs)), np.zeros(len(pairs), np.int64)
    low = (1 << 44) - 1
    while len(n):
        best = np.zeros(len(owner), np.int64)
        np.maximum.at(best, block, (n << 44) | (low - ((i << 22) | j)))
        size, place = best >> 44, low - (best & low)
        np.add.at(total, owner, size)
        bi, bj = (place >> 22)[block], (place & ((1 << 22) - 1))[block]
        left = np.minimum(n, np.minimum(bi - i, bj - j))
        skip = np.maximum(np.maximum(bi - i, bj - j) + size[block], 0)
        l, r = np.flatnonzero(left > 0), np.flatnonzero(n > skip)
        block = np.concatenate([2 * block[l], 2 * block[r] + 1])
        i, j, n = (np.concatenate(x) for x in ((i[l], i[r] + skip[r]), (j[l], j[r] + skip[r]), (left[l], n[r] - skip[r])))
        there = np.zeros(2 * len(owner), dtype=bool)
        there[block] = True
        owner, block = np.repeat(owner, 2)[there], (np.cumsum(there) - 1)[block]
    return total


def _ratios(pairs: Iterable[tuple]) -> list[float | None]:
    """The ratio of ``SequenceMatcher`` without its heuristic of each pair of texts or lists; null if one is."""
    out: list[float | None] = []
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    cells = 0

    def settle() -> None:
        for (k, a, b), n in zip(held, _matched([x[1:] for x in held]) if held else (), strict=True):
            out[k] = 2.0 * int(n) / (len(a) + len(b))
        held.clear()

    for x, y in pairs:
        if x is None or y is None:
            out.append(None)
        elif x == y or not x or not y:
            out.append(float(x == y))
        elif (size := (len(x) + len(y)) * (min(len(x), len(y)) + 1)) > CELLS:
            out.append(SequenceMatcher(None, x, y, autojunk=False).ratio())
        else:
            if cells + size > CELLS:
                settle()
                cells = 0
            number: dict = {}
            p, q = (np.fromiter((number.setdefault(c, len(number)) for c in z), np.int32, len(z)) for z in (x, y))
            kind = np.int8 if len(number) < 1 << 7 else np.int32
            held.append((len(out), p.astype(kind), q.astype(kind)))
            out.append(None)
            cells += size
    settle()
    return out


@F.arrow_udf(T.DoubleType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_ratios(zip(a.to_pylist(), b.to_pylist(), strict=True)), pa.float64())


def character_ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def word_ratio(a: Column, b: Column) -> Column:
    """Sequence ratio over tokens."""
    return _ratio(tokens(a), tokens(b))


@F.arrow_udf(T.DoubleType())
def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x: list[str] | None, y: list[str] | None, ratio: float | None) -> float | None:
        if x is None or y is None:
            return None
        if not x or not y:
            return 0.0
        return max(ratio, 2 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)))

    pairs = list(zip(a.to_pylist(), b.to_pylist(), strict=True))
    return pa.array([one(x, y, r) for (x, y), r in zip(pairs, _ratios(pairs), strict=True)], pa.float64())


def similarity(a: Column, b: Column) -> Column:
    """The larger of sequence ratio and multiset overlap; 0 where a text has no token."""
    return _similarity(tokens(a), tokens(b))


def validate_edit(original: Column, edited: Column, level: Column) -> Column:
    """The first reason that speaks against an edit, empty if none does."""
    from corpuslab.functions.text import strip, word_count

    n, m = word_count(original), word_count(edited)
    light = level == "light"
    low = F.greatest(F.lit(1), F.floor(n * F.when(light, F.lit(0.85)).otherwise(F.lit(0.65))))
    high = F.ceil(n * F.lit(1.15))
    # The sequence ratio is quadratic: pairs that the cheap bounds reject go to it as nulls.
    open_ = (edited != "") & m.between(low, high) & (strip(original) != strip(edited))
    ratio = similarity(F.when(open_, original), F.when(open_, edited))
    return (
        F.when(edited == "", "is empty")
        .when(F.lower(edited).contains("as a language model"), "mentions the generation process")
        .when(strip(original) == strip(edited), "is unchanged")
        .when(~m.between(low, high), F.format_string("has %d words; expected %d to %d", m, low, high))
        .when(light & (ratio < 0.82), "rewrites too much for light editing")
        .when(~light & (ratio > 0.97), "changes too little for moderate editing")
        .when(~light & (ratio < 0.45), "rewrites too much for moderate editing")
        .otherwise("")
    )
