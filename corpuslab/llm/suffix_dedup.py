"""Suffix-array dedup over bytes, by longest-previous-factor arrays.

A suffix array of the whole corpus would be one unsplittable object. Equal
strings of ``length`` bytes have equal anchors, so suffixes can be dealt out
by anchor and sorted apart: all places where a string may be repeated meet in
one shard, in order of document and position. A shard gets a suffix array by
prefix doubling, the common prefixes of neighbours in it, and from the previous
and next smaller positions in suffix order the longest previous factor of each
position: the longest string there that also begins earlier. The previous and
next larger positions give the mirror image, the longest string that begins
again later. Where such a factor reaches ``length``, its bytes are covered:
with ``keep="first"`` by previous factors alone, so that the first copy stays,
with ``keep="none"`` by both.

Two things are settled before. Places whose whole surroundings are equal, byte
for byte of all windows around one anchor, are copies; the first of them alone
goes to a shard, so that a shard's size follows distinct text. Anchors with
``hot_from`` or more different surroundings are settled window by window with
a hash aggregation, so that no shard grows with a hot string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm import kernels as K
from corpuslab.llm.kernels import lean
from corpuslab.llm import columns, scratch, windows

#: Bytes from which a shard takes no further anchor.
SHARD = 1 << 20
SPANS = pa.schema([("doc", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def prefix_ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(width, ranks of all suffixes by their first ``width`` bytes), widths doubling from 1 and ending with ``depth``.

    Equal prefixes get equal ranks. Suffixes shorter than a width are ranked as
    if signs below all others followed.
    """
    n = len(text)
    out = [(1, np.unique(text, return_inverse=True)[1].astype(np.uint32))]
    while out[-1][0] < depth:
        width, rank = out[-1]
        step = min(width, depth - width)
        pair = (rank.astype(np.uint64) + np.uint64(1)) << np.uint64(32)
        pair[: n - step] |= rank[step:].astype(np.uint64) + np.uint64(1)
        out.append((width + step, np.unique(pair, return_inverse=True)[1].astype(np.uint32)))
    return out


def common_prefixes(ranks: list[tuple[int, np.ndarray]], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``one`` and ``other``, the full depth at most; both must be that long."""
    depth, last = ranks[-1]
    out = np.where(last[one] == last[other], depth, 0)
    open_ = np.flatnonzero(out == 0)
    for width, rank in reversed(ranks[:-1]):
        same = rank[one[open_] + out[open_]] == rank[other[open_] + out[open_]]
        out[open_[same]] += width
    return out


def _nearest_less(values: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each entry, the least of ``shared`` on the way back to the nearest smaller value (0 if there is none).

    ``shared[i]`` stands between entries i - 1 and i. All entries look at once
    and jump as far as the one that they land on has already come. Below
    ``least`` a search ends, and what it has then is returned.
    """
    n = len(values)
    to, low = np.arange(-1, n - 1), shared.copy()
    todo = np.arange(1, n)
    while len(todo):
        todo = todo[(to[todo] >= 0) & (low[todo] >= max(least, 1))]
        todo = todo[values[to[todo]] > values[todo]]
        via = to[todo]
        low[todo], to[todo] = np.minimum(low[todo], low[via]), to[via]
    low[to < 0] = 0
    return low


def previous_factors(positions: np.ndarray, shared: np.ndarray, least: int = 0) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order.

    ``positions`` are the suffixes' positions in suffix order, ``shared[i]``
    the common prefix of suffixes i - 1 and i (``shared[0]`` is 0). The earlier
    suffix that has most in common with one stands at the nearest smaller
    position before or after it. Factors below ``least`` may come out smaller.
    """
    before = _nearest_less(positions, shared, least)
    turned = np.append(0, shared[:0:-1])
    return np.maximum(before, _nearest_less(positions[::-1], turned, least)[::-1])


def repeated_suffixes(text: np.ndarray, at: np.ndarray, length: int, keep: str) -> np.ndarray:
    """Which of the suffixes at ascending ``at`` share ``length`` bytes with an earlier one, or with ``keep="none"`` any other."""
    ranks = prefix_ranks(text, length)
    order = np.argsort(ranks[-1][1][at], kind="stable")
    shared = np.zeros(len(at), np.int64)
    shared[1:] = common_prefixes(ranks, at[order[:-1]], at[order[1:]])
    factor = previous_factors(at[order], shared, length)
    if keep == "none":  # the same with positions counted from the end: the longest factor that comes again
        factor = np.maximum(factor, previous_factors(-at[order], shared, length))
    out = np.zeros(len(at), dtype=bool)
    out[order[factor >= length]] = True
    return out


def _shard_spans(doc: np.ndarray, q: np.ndarray, n: np.ndarray, cuts: list[bytes], length: int, keep: str) -> tuple[np.ndarray, ...]:
    """Spans (doc, s, e) of runs of repeated windows; rows in order of position."""
    text = np.frombuffer(b"".join(cuts), np.uint8)
    base = np.cumsum(n + length - 1) - (n + length - 1)
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = base[own] + place
    # A copy of a place (overlapping cuts of repeated ids) is no other place.
    hit = np.flatnonzero(repeated_suffixes(text, at, length, keep))
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(own[hit]) != 0)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(hit)) - 1
    start = q[own[hit[head]]] + place[hit[head]]
    return doc[own[hit[head]]], start, q[own[hit[tail]]] + place[hit[tail]] + length


def _shards(length: int, keep: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            _, doc, q, n, cuts = zip(*held, strict=True)
            held, size = [], 0
            got = _shard_spans(np.array(doc), np.array(q, np.int64), np.array(n, np.int64), list(cuts), length, keep)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(got, SPANS.types, strict=True)], schema=SPANS)

        for frame in frames:
            for row in zip(*(frame.column(c).to_pylist() for c in range(5)), strict=True):
                if size >= SHARD and row[0] != last:
                    yield flush()
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    return run


RESULT = T.StructType([*[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])


@F.arrow_udf(RESULT)
def _keep(text: pa.Array, spans: pa.Array) -> pa.Array:
    data, offsets = K.text_buffers(text)
    out: list[list] = [[], [], [], []]
    for i, asked in enumerate(spans.to_pylist()):
        raw = data[int(offsets[i]) : int(offsets[i + 1])]
        if not asked:
            row = (len(raw), 0, 0, raw.tobytes())
        else:
            gone = windows.covered(len(raw), asked)
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            row = (len(raw), int(gone.sum()), runs, raw[~gone].tobytes())
        for c, v in zip(out, row, strict=True):
            c.append(v)
    K.tidy()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.binary())], names=RESULT.names)


def dedup_bytes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: str = "first", hot_from: int = 400
) -> DataFrame:
    """``docs`` without ``text_col``, plus ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary).

    Texts are UTF-8 bytes and matches never cross documents. A byte goes if a
    string of ``length`` bytes that covers it starts earlier too
    (``keep="first"``) or anywhere else (``keep="none"``), judged on the
    input; overlaps count. A null or empty text has no bytes. Rows with a null
    id keep everything and are no copies. Rows that repeat an id count as
    further copies with ``keep="none"``; with ``keep="first"`` they must hold
    one text and get the same result. An empty table gives an empty table.
    Columns of ``docs`` with the names above are replaced; all others stay,
    whatever their names.
    """
    first = keep == "first"
    rows = windows.texts(docs, id_col, text_col)
    gram = max(1, (length * 8) // 25)
    spans, mixed, stages = windows.levels(rows, windows.byte_symbols, length, gram, first)
    found = windows.expand(rows, mixed, windows.byte_symbols, length, first, hot_from)
    single = windows.single_spans(found, length, first)
    cuts = found.where("kind = 1").select(F.col("k1").alias("a"), "doc", "q", "n", "cut")
    cuts = cuts.repartition(scratch.parts(docs.sparkSession), "a").sortWithinPartitions("a", "doc", "q")
    near = cuts.mapInArrow(lean(_shards(length, keep)), "doc long, s int, e int")
    spans = scratch.stage(spans.unionByName(single).unionByName(near), "spans")
    scratch.discard(found, *stages)
    scratch.release(docs.sparkSession)
    asked, result = columns.fresh(docs, "spans", "result")
    out = windows.gather(docs, spans, id_col, asked).withColumn(result, _keep(columns.col(text_col).cast("string"), F.col(asked)))
    rest = columns.without(docs.columns, text_col, *RESULT.names)
    return out.select(*columns.cols(rest), *[F.col(f"{result}.{c}").alias(c) for c in RESULT.names])
