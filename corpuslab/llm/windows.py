"""Dealing out places where windows of fixed length may be repeated.

Anchors (grams that every copy of a window must share) are compared first,
then superwindows (runs of windows around one anchor); what is left are anchors
that stand in different superwindows, handed out as cuts of text or, where an
anchor has very many, as hashes of single windows.

Rows that a map task already knows to be copies are settled there, so that a
passage which a third of all documents hold reaches the shuffle once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import kernels as K
from corpuslab.llm.kernels import lean
from corpuslab.llm import columns, scratch

#: Members that a task gathers before it settles copies among them.
GATHER = 800_000
MEMBERS = pa.schema([("a", pa.int64()), ("sh", pa.int64()), ("doc", pa.int64()), ("q", pa.int32()), ("n", pa.int32()), ("gone", pa.bool_())])
MEMBERS_DDL = "a long, sh long, doc long, q int, n int, gone boolean"

#: (bytes, offsets, i, j) -> (symbols as uint64, first symbol of each row and the end)
Symbols = Callable[[np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]


def byte_symbols(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    lo = int(offsets[i])
    return K.TABLE[data[lo : int(offsets[j])]], offsets[i : j + 1] - lo


def _settle(held: list[tuple[np.ndarray, ...]], keep_first: bool) -> pa.RecordBatch:
    """One member a distinct superwindow, the earliest; the others are copies for certain."""
    a, sh, doc, q, n = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((q, doc, sh, a))
    a, sh, doc, q, n = (c[order] for c in (a, sh, doc, q, n))
    again = np.zeros(len(a), dtype=bool)
    again[1:] = (a[1:] == a[:-1]) & (sh[1:] == sh[:-1])
    if not keep_first:
        first = np.flatnonzero(~again)
        copied = first[np.append(again[1:], False)[first]]
        a, sh, doc, q, n, again = (np.append(c, c[copied]) for c in (a, sh, doc, q, n, again))
        again[len(again) - len(copied) :] = True
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip((a, sh, doc, q.astype(np.int32), n.astype(np.int32), again), MEMBERS.types, strict=True)], schema=MEMBERS
    )


def _members(symbols: Symbols, length: int, gram: int, keep_first: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for frame in frames:
            docs = frame.column(0).to_numpy(zero_copy_only=False)
            data, offsets = K.text_buffers(frame.column(1))
            for i, j in K.chunks(offsets):
                s = K.SuperWindows(*symbols(data, offsets, i, j), length, gram)
                if len(s.start):
                    held.append((s.anchor.view(np.int64), s.whole.view(np.int64), docs[i + s.row], s.start, s.n))
                    size += len(s.start)
                if size >= GATHER:
                    yield _settle(held, keep_first)
                    held, size = [], 0
        if held:
            yield _settle(held, keep_first)

    return run


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key, text = columns.col(id_col), columns.col(text_col)
    return docs.where(key.isNotNull()).select(key.cast("long").alias("doc"), text.cast("string").alias("text"))


def levels(rows: DataFrame, symbols: Symbols, length: int, gram: int, keep_first: bool) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(spans, mixed, stages to discard after them) of ``rows`` (doc, text).

    ``spans`` (doc, s, e): symbols removed because a whole superwindow is
    repeated. ``mixed`` (a, doc, q, n): superwindows whose anchor also stands
    in other ones, the first copy of each; what single windows they share is
    still open. Any window's earliest place lies in a first copy.
    """
    scratch.small_batches(rows.sparkSession)
    found = scratch.stage(rows.mapInArrow(lean(_members(symbols, length, gram, keep_first)), MEMBERS_DDL), "members")
    certain, members = found.where("gone"), found.where("not gone").drop("gone")
    repeated = members.groupBy("a").agg(F.count("*").alias("c"), F.min("sh").alias("lo"), F.max("sh").alias("hi")).where("c > 1")
    repeated = scratch.stage(repeated.select("a", (F.col("lo") != F.col("hi")).alias("mixed")), "repeated")
    live = scratch.stage(members.join(repeated, "a"), "live")
    scratch.discard(repeated)
    scratch.release(rows.sparkSession)
    first = live.groupBy("a", "sh").agg(F.min("doc").alias("d0"), F.count("*").alias("c"))
    first = scratch.stage(first.where("c > 1").select("a", "sh", "d0"), "first")
    copied = live.join(first, ["a", "sh"], "left")
    lost = copied.where("d0 is not null and doc > d0" if keep_first else "d0 is not null")
    spans = certain.select("doc", "q", "n").unionByName(lost.select("doc", "q", "n"))
    spans = spans.select("doc", F.col("q").alias("s"), (F.col("q") + F.col("n") + (length - 1)).alias("e"))
    mixed = copied.where("mixed and (d0 is null or doc = d0)").select("a", "doc", "q", "n")
    return spans, mixed, [found, live, first]


def gather(docs: DataFrame, spans: DataFrame, id_col: str, name: str) -> DataFrame:
    """``docs`` with ``name``, which no column of theirs is called: the list of (s, e) of its id, null where there is none."""
    (key,) = columns.fresh(docs, "doc_key")
    by = spans.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias(name)).select(F.col("doc").alias(key), name)
    return docs.join(by, columns.col(id_col).cast("long") == F.col(key), "left").drop(key)


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n symbols the spans cover."""
    step = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(step, np.minimum([x["s"] for x in spans], n), 1)
        np.add.at(step, np.minimum([x["e"] for x in spans], n), -1)
    return np.cumsum(step[:n]) > 0


WINDOWS = pa.schema([("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("q", pa.int32()), ("n", pa.int32()), ("cut", pa.binary()), ("gone", pa.bool_())])
WINDOWS_DDL = "kind int, k1 long, k2 long, doc long, q int, n int, cut binary, gone boolean"


def window_hashes(symbols: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows that start at ``at``."""
    out = []
    for powers in (K.GRAMS, K.GRAMS2):
        up, down = powers.upto(len(symbols) + 1)
        total = np.zeros(len(symbols) + 1, K.U64)
        np.cumsum(symbols * up[: len(symbols)], out=total[1:])
        out.append(K.mix64((total[at + length] - total[at]) * down[at]).view(np.int64))
    return out[0], out[1]


def _rows(**columns) -> pa.RecordBatch:
    n = len(columns["doc"])
    full = {"kind": np.zeros(n, np.int32), "k1": None, "k2": None, "n": np.ones(n, np.int32), "cut": None, "gone": np.zeros(n, dtype=bool)} | columns
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if full[f.name] is None else pa.array(full[f.name], f.type) for f in WINDOWS], schema=WINDOWS)


def _expand(symbols: Symbols, length: int, keep_first: bool):
    """Rows (doc, text, ranges) -> kind 0: single windows of ranges that are hot; kind 1: the others' symbols, as bytes."""

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        k1, k2, doc, q = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((q, doc, k2, k1))
        k1, k2, doc, q = (c[order] for c in (k1, k2, doc, q))
        again = np.zeros(len(k1), dtype=bool)
        again[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        if not keep_first:
            copied = np.flatnonzero(~again & np.append(again[1:], False))
            k1, k2, doc, q = (np.append(c, c[copied]) for c in (k1, k2, doc, q))
            again = np.append(again, np.ones(len(copied), dtype=bool))
        return _rows(k1=k1, k2=k2, doc=doc, q=q.astype(np.int32), gone=again)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for frame in frames:
            docs = frame.column(0).to_numpy(zero_copy_only=False)
            data, offsets = K.text_buffers(frame.column(1))
            ranges = frame.column(2)
            bounds = ranges.offsets.to_numpy()
            fields = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(ranges.type.value_type, ranges.values.flatten(), strict=True)}
            for i, j in K.chunks(offsets):
                s, first = symbols(data, offsets, i, j)
                part = slice(bounds[i], bounds[j])
                row = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                q, n, a, hot = (fields[c][part].astype(np.int64) for c in ("q", "n", "a", "hot"))
                big = np.flatnonzero(hot)
                if len(big):
                    step = np.arange(n[big].sum()) - np.repeat(np.cumsum(n[big]) - n[big], n[big])
                    place = np.repeat(q[big], n[big]) + step
                    k1, k2 = window_hashes(s, np.repeat(first[row[big]], n[big]) + place, length)
                    held.append((k1, k2, np.repeat(docs[i + row[big]], n[big]), place))
                    size += len(place)
                small = np.flatnonzero(hot == 0)
                if len(small):
                    lo = int(offsets[i])
                    at = lo + first[row[small]] + q[small]
                    cuts = [data[x : x + y].tobytes() for x, y in zip(at.tolist(), (n[small] + length - 1).tolist(), strict=True)]
                    yield _rows(kind=np.ones(len(small), np.int32), k1=a[small], doc=docs[i + row[small]], q=q[small].astype(np.int32), n=n[small].astype(np.int32), cut=cuts)
                if size >= GATHER:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    return run


def expand(rows: DataFrame, mixed: DataFrame, symbols: Symbols, length: int, keep_first: bool, hot_from: int) -> DataFrame:
    """Mixed superwindows as single windows (kind 0) or, with fewer than ``hot_from`` a anchor, as cuts of text (kind 1)."""
    mixed = scratch.stage(mixed, "mixed")
    hot = scratch.stage(mixed.groupBy("a").count().where(F.col("count") >= hot_from).select("a", F.lit(1).alias("hot")), "hot-anchors")
    marked = mixed.join(hot, "a", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    asked = marked.groupBy("doc").agg(F.collect_list(F.struct("a", "q", "n", "hot")).alias("ranges"))
    ranges = scratch.stage(asked, "asked")
    asked = rows.join(ranges, "doc").select("doc", "text", "ranges")
    out = scratch.stage(asked.mapInArrow(lean(_expand(symbols, length, keep_first)), WINDOWS_DDL), "windows")
    scratch.discard(ranges, mixed, hot)
    scratch.release(rows.sparkSession)
    return out


def single_spans(windows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of single windows (kind 0 of ``expand``) that are repeated."""
    one = windows.where("kind = 0")
    certain, members = one.where("gone"), one.where("not gone")
    first = members.groupBy("k1", "k2").agg(F.min("doc").alias("d0"), F.count("*").alias("c")).where("c > 1").select("k1", "k2", "d0")
    lost = members.join(first, ["k1", "k2"])
    if keep_first:
        lost = lost.where("doc > d0")
    out = certain.select("doc", "q").unionByName(lost.select("doc", "q"))
    return out.select("doc", F.col("q").alias("s"), (F.col("q") + length).alias("e"))
