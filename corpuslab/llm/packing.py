"""Harmonic packing of documents into fixed-length sequences.

Piece lengths are reciprocals of the capacity: class k holds pieces of
floor(capacity / k) tokens, and a sequence of class k is exactly k of them.
Documents may be cut, so a document gives full sequences and then, from the
rest, the largest reciprocal that fits, again and again; a rest of at most
sqrt(capacity) is itself floor(capacity / k) for some k. Every worker fills
its own sequences with k pieces a class and keeps no more open than one
sequence a class. The pieces of the sequences left open go through the same
filling with fewer workers, round by round, and the last round joins what is
still open first-fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm import scratch, tokens
from corpuslab.llm.kernels import lean

BITS = 40
FAN_IN = 64
ARROW = pa.schema(
    [
        ("doc", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.binary()),
        ("k", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_length", pa.int64()),
    ]
)
SPARK = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "ids" else T.LongType()) for f in ARROW])


def cuts(capacity: int) -> list[list[int]]:
    """For each rest below the capacity, the lengths that it is cut into."""
    sizes = sorted({capacity // k for k in range(1, capacity + 1)})
    small = isqrt(capacity)
    out: list[list[int]] = [[]]
    for rest in range(1, capacity):
        if rest <= small:
            out.append([rest])
        else:
            first = sizes[int(np.searchsorted(sizes, rest, side="right")) - 1]
            out.append([first, *out[rest - first]])
    return out


def padded(fill: int, capacity: int) -> int:
    """Sequences are padded to the capacity, except at a power of two."""
    return fill if fill & (fill - 1) == 0 else capacity


class Filler:
    """Open sequences of one worker, one a class."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next, self.open = capacity, worker << BITS, {}
        self.rows: list[tuple] = []

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.close(held)
            self.open[k] = []

    def close(self, pieces: list[tuple]) -> None:
        at, length = 0, padded(sum(p[2] for p in pieces), self.capacity)
        for p in pieces:
            self.rows.append((*p, self.capacity // p[2], self.next, at, length))
            at += p[2]
        self.next += 1

    def leave_open(self) -> None:
        for k, held in self.open.items():
            self.rows.extend((*p, k, None, None, None) for p in held)

    def first_fit(self) -> None:
        """Join the open pieces, longest first, into as few sequences as that gives."""
        bins: list[list[tuple]] = []
        room: list[int] = []
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: (-p[2], p[0] if p[0] is not None else -1, p[1])):
            i = next((i for i, r in enumerate(room) if r >= p[2]), None)
            if i is None:
                bins.append([])
                room.append(self.capacity)
                i = len(bins) - 1
            bins[i].append(p)
            room[i] -= p[2]
        for b in bins:
            self.close(b)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _worker() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _first_round(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rest, filler = tokens.encoder(vocabulary), cuts(capacity), Filler(capacity, _worker())
        for frame in frames:
            docs = frame.column(0).to_pylist()
            for i, j, ids, where in enc.encode(frame.column(1), end_id):
                raw, bounds = memoryview(ids.astype("<u4")).cast("B"), where.tolist()
                for doc, first, stop in zip(docs[i:j], bounds, bounds[1:], strict=False):
                    n, at = stop - first, 0
                    for size in (*[capacity] * (n // capacity), *rest[n % capacity]):
                        part = raw[4 * (first + at) : 4 * (first + at + size)]
                        filler.add((doc, at, size, zlib.crc32(part), n, bytes(part) if with_ids else None))
                        at += size
                yield filler.batch()
        filler.leave_open()
        yield filler.batch()

    return run


def _next_round(capacity: int, base: int, last: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(capacity, base + _worker())
        for frame in frames:
            for piece in zip(*(frame.column(i).to_pylist() for i in range(6)), strict=True):
                filler.add(piece)
            yield filler.batch()
        if last:
            filler.first_fit()
        else:
            filler.leave_open()
        yield filler.batch()

    return run


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    vocabulary: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length[, ids].

    Each document's ids, with ``end_id`` after them, lie gapless in pieces,
    and pieces gapless in sequences of at most ``capacity``. ``ids`` are
    little-endian unsigned 32-bit. A null or empty text gives one piece that
    holds ``end_id`` alone. Repeated rows are packed as documents of their
    own. Extra columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark, scratch.BATCH_BYTES)
    vocabulary = vocabulary or tokens.default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    pieces = scratch.stage(rows.mapInArrow(lean(_first_round(vocabulary, capacity, end_id, with_ids)), SPARK), "pack-pieces")
    whole, left = pieces.where(F.col("sequence_id").isNotNull()), pieces.where(F.col("sequence_id").isNull())
    workers = left.select(F.spark_partition_id()).rdd.getNumPartitions()
    base, width = 1 << 22, max(1, -(-workers // FAN_IN))
    while True:
        last = width == 1
        more = left.select(*SPARK.names).repartition(width).mapInArrow(lean(_next_round(capacity, base, last)), SPARK)
        more = scratch.stage(more, "pack-rest")
        whole = whole.unionByName(more.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        left, base, width = more.where(F.col("sequence_id").isNull()), base + width, max(1, -(-width // FAN_IN))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    return whole.select(F.col("doc").alias(id_col), *names, *(["ids"] if with_ids else []))
