"""Substring dedup: word windows that occurred earlier are removed, by level-wise doubling.

Windows of ``length`` words are approached over shorter ones: a quarter of the
length, twice that, and the length itself (5, 10, 20). At each level the
windows' keys are counted over the whole corpus, partly before the shuffle,
and only windows that are repeated go on to twice the length; where none
survive, the search ends.

The first level need not hold every window: each window of ``length`` words
gives the leftmost least of its quarter-length windows (by hash), the same in
each copy, so nothing that is repeated at full length is missed. The middle
level extends such a window to both sides, as far as full windows around it
reach. The last level compares all full windows that contain survivors, by 96
bits. A map task keeps only the earliest place of each of them and settles the
others at once, so a passage that a third of all documents hold reaches the
shuffle once a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm import columns, scratch, windows
from corpuslab.llm import kernels as K
from corpuslab.llm.kernels import lean

#: Full windows that a task gathers before it settles copies among them.
GATHER = 800_000
SHORT = pa.schema([("key", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("doc", pa.int64()), ("at", pa.int32()), ("q", pa.int32()), ("n", pa.int32())])
SHORT_DDL = "key long, left int, right int, doc long, at int, q int, n int"
FULL = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("doc", pa.int64()), ("q", pa.int32()), ("n", pa.int32())])
FULL_DDL = "k1 long, k2 int, doc long, q int, n int"
RUNS = pa.schema([("doc", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
RUNS_DDL = "doc long, s int, e int"


def short_windows(symbols: np.ndarray, first: np.ndarray, length: int, short: int) -> dict[str, np.ndarray]:
    """The least short window of each full window, one row for a run of full windows that share it.

    ``at`` is its first symbol, ``q`` and ``n`` the run of full windows (all
    three from the row's first symbol), ``key`` its hash. ``left`` and
    ``right`` hash the windows of twice its length that end and begin with it,
    by 32 bits beside those of ``key``; ``has_left`` and ``has_right`` tell whether a full window of the run
    contains them.
    """
    total, middle = len(symbols), 2 * short
    starts = np.flatnonzero(K.inside(first, length, total)) if total >= length else np.zeros(0, np.int64)
    if not len(starts):
        return {c: np.zeros(0, np.int64) for c in ("key", "left", "right", "at", "q", "n", "row", "has_left", "has_right")}
    hashes = K.gram_hashes(symbols, short)
    low = K.window_minima(hashes, length - short + 1)[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(low) != 0)
    head = np.flatnonzero(new)
    q, n, at = starts[head], np.diff(np.append(head, len(starts))), low[head]
    twice = K.gram_hashes(symbols, middle)
    row = np.searchsorted(first, q, side="right") - 1
    own = first[row]
    return {
        "key": hashes[at].view(np.int64),
        "left": twice[np.clip(at + short - middle, 0, len(twice) - 1)].view(np.int64) >> 32,
        "right": twice[np.clip(at, 0, len(twice) - 1)].view(np.int64) >> 32,
        "at": at - own,
        "q": q - own,
        "n": n,
        "row": row,
        "has_left": q <= at + short - middle,
        "has_right": q + n - 1 >= at + middle - length,
    }


def _short(length: int, short: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            docs = frame.column(0).to_numpy(zero_copy_only=False)
            data, offsets = K.text_buffers(frame.column(1))
            for i, j in K.chunks(offsets):
                w = K.Words(data, offsets, i, j)
                s = short_windows(w.hashes(), w.first, length, short)
                if len(s["row"]):
                    s["doc"] = docs[i + s["row"]]
                    masks = {"left": ~s["has_left"], "right": ~s["has_right"]}
                    yield pa.RecordBatch.from_arrays([pa.array(s[f.name], f.type, mask=masks.get(f.name), safe=False) for f in SHORT], schema=SHORT)

    return run


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that stand in more than one row, counted before the shuffle too."""
    return rows.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(*keys)


def surviving(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is repeated, stage to discard after them).

    The keys are written first: their counts leave the disk, and a join of two
    inputs that were only dealt out for it can split a hot key.
    """
    known = scratch.stage(repeated(rows, *keys), "repeated")
    scratch.release(rows.sparkSession)
    return rows.join(known, list(keys), "left_semi"), known


def merged(doc: np.ndarray, q: np.ndarray, n: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs (doc, s, e) of the symbols that windows q..q+n-1 cover."""
    order = np.lexsort((q, doc))
    doc, s, e = doc[order], q[order].astype(np.int64), (q + n)[order].astype(np.int64) + length - 1
    if len(doc):
        group = np.cumsum(np.append(False, doc[1:] != doc[:-1])) << 33
        reach = np.maximum.accumulate(e + group)
        new = np.append(True, (s + group)[1:] > reach[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1
        doc, s, e = doc[head], s[head], reach[tail] - group[tail]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], schema=RUNS)


def _full(length: int):
    """Rows (doc, text, ranges of windows) -> the earliest place of each full window (n = 0); runs of n others, which are copies for certain."""

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        k1, k2, doc, q = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((q, doc, k2, k1))
        k1, k2, doc, q = (c[order] for c in (k1, k2, doc, q))
        again = np.zeros(len(k1), dtype=bool)
        again[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        runs = merged(doc[again], q[again], np.ones(int(again.sum()), np.int64), length)
        kept, gone = len(k1) - int(again.sum()), runs.num_rows
        s, e = runs.column(1).to_numpy(), runs.column(2).to_numpy()
        keys = [np.append(k1[~again], K.mix64(runs.column(0).to_numpy().view(K.U64)).view(np.int64) + s), np.append(k2[~again] >> 32, np.zeros(gone, np.int64))]
        rest = [np.append(doc[~again], runs.column(0).to_numpy()), np.append(q[~again], s), np.append(np.zeros(kept, np.int64), e - s - length + 1)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip([*keys, *rest], FULL, strict=True)], schema=FULL)

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
                w = K.Words(data, offsets, i, j)
                symbols = w.hashes()
                part = slice(bounds[i], bounds[j])
                row = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                q, n = fields["q"][part].astype(np.int64), fields["n"][part].astype(np.int64)
                asked = np.zeros(len(symbols) + 1, np.int64)  # ranges of the two sides overlap
                np.add.at(asked, w.first[row] + q, 1)
                np.add.at(asked, w.first[row] + q + n, -1)
                at = np.flatnonzero(np.cumsum(asked[:-1]) > 0)
                if len(at):
                    own = np.searchsorted(w.first, at, side="right") - 1
                    k1, k2 = windows.window_hashes(symbols, at, length)
                    held.append((k1, k2, docs[i + own], at - w.first[own]))
                    size += len(at)
                if size >= GATHER:
                    yield settle(held)
                    held, size = [], 0
        if held:
            yield settle(held)

    return run


def _merge(length: int):
    """Rows (doc, q, n), a document's together and in order, to runs; a batch's last document waits for the next batch."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for frame in frames:
            if not frame.num_rows:
                continue
            now = [frame.column(c).to_numpy() for c in range(3)]
            now = now if held is None else [np.append(a, b) for a, b in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [c[cut:] for c in now]
            if cut:
                yield merged(*[c[:cut] for c in now], length)
        if held is not None:
            yield merged(*held, length)

    return run


def removed_runs(rows: DataFrame, length: int) -> DataFrame:
    """Runs (doc, s, e) of words of ``rows`` (doc, text) that windows found earlier cover."""
    spark = rows.sparkSession
    scratch.small_batches(spark)
    short = max(1, length // 4)
    middle = 2 * short if 4 * short <= length else short
    found = scratch.stage(rows.mapInArrow(lean(_short(length, short)), SHORT_DDL), "short-windows")
    kept, known = surviving(found, "key")
    live = scratch.stage(kept, "short-repeated")
    del kept
    scratch.discard(found, known)
    scratch.release(spark)
    if middle > short:
        sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("more")), F.struct(F.lit(1).alias("side"), F.col("right").alias("more"))))
        both = live.select("key", "doc", "at", "q", "n", sides.alias("x")).select("key", "x.side", "x.more", "doc", "at", "q", "n").where("more is not null")
        kept, known = surviving(both, "key", "side", "more")
        low = F.when(F.col("side") == 1, F.greatest("q", F.col("at") + (middle - length))).otherwise(F.col("q"))
        high = F.when(F.col("side") == 0, F.least(F.col("q") + F.col("n"), F.col("at") + (short - middle + 1))).otherwise(F.col("q") + F.col("n"))
        kept = kept.select("doc", low.alias("q"), (high - low).alias("n"))
    else:
        kept, known = live.select("doc", "q", "n"), None
    asked = scratch.stage(kept.groupBy("doc").agg(F.collect_list(F.struct("q", "n")).alias("ranges")), "asked")
    scratch.discard(live, *[known] * (known is not None))
    del kept
    scratch.release(spark)
    full = rows.join(asked, "doc").select("doc", "text", "ranges").mapInArrow(lean(_full(length)), FULL_DDL)
    full = scratch.stage(full, "full-windows")
    scratch.discard(asked)
    scratch.release(spark)
    # A task sends a window once, so that none has more rows here than there are tasks: one shuffle finds the earliest of each.
    place = F.rank().over(Window.partitionBy("k1", "k2", "n").orderBy("doc"))
    lost = full.withColumn("place", place).where("n > 0 or place > 1").select("doc", "q", F.greatest("n", F.lit(1)).alias("n"))
    lost = lost.repartition(scratch.parts(spark), "doc").sortWithinPartitions("doc", "q")
    runs = scratch.stage(lost.mapInArrow(lean(_merge(length)), RUNS_DDL), "runs")
    scratch.discard(full)
    del full, lost
    scratch.release(spark)
    return runs


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@F.arrow_udf(RESULT)
def _keep(text: pa.Array, spans: pa.Array) -> pa.Array:
    data, offsets = K.text_buffers(text)
    asked = spans.to_pylist()
    n_words, removed, kept = [], [], []
    for i, j in K.chunks(offsets):
        w = K.Words(data, offsets, i, j)
        raw = w.bytes.tobytes()
        for r in range(j - i):
            n, lo = int(w.counts[r]), int(w.first[r])
            words = raw[int(w.bounds[r]) : int(w.bounds[r + 1])].split()
            gone = windows.covered(n, asked[i + r])
            assert len(words) == n and lo >= 0
            n_words.append(n)
            removed.append(int(gone.sum()))
            kept.append(b" ".join(words) if not removed[-1] else b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()]))
    arrays = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    K.tidy()
    return pa.StructArray.from_arrays(arrays, names=RESULT.names)


def dedup_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the kept words, plus ``n_words`` and ``n_removed``.

    A word goes if it lies in a window of ``length`` words whose sequence also
    starts earlier: at a smaller id, or earlier in the same document. Windows
    are judged on the input. Kept words are joined by one space; a null or
    empty text becomes the empty string. Rows with a null id keep all words
    and count as nobody's earlier place. Rows that repeat an id must hold one
    text: they count as one document and get the same result. An empty table
    gives an empty table. Columns of ``docs`` named ``n_words`` or
    ``n_removed`` are replaced; all others stay, whatever their names.
    """
    spans, result = columns.fresh(docs, "spans", "result")
    runs = removed_runs(windows.texts(docs, id_col, text_col), length)
    out = windows.gather(docs, runs, id_col, spans).withColumn(result, _keep(columns.col(text_col).cast("string"), F.col(spans)))
    named = {text_col.lower(): "kept", "n_words": "n_words", "n_removed": "n_removed"}
    names = [*docs.columns, *columns.without(["n_words", "n_removed"], *docs.columns)]
    return out.select(*[F.col(f"{result}.{named[c.lower()]}").alias(c) if c.lower() in named else columns.col(c) for c in names])
