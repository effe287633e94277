"""CSV records that hold line ends, read by many tasks, each with its number.

Whether a line starts a record depends on the quotes in all lines before it in
its file: a record starts where their number is even. So a file is read as
lines by as many tasks as it has blocks. A task does not know whether its block
begins inside a quoted field, so it puts the block's lines together for either
case; the first block of a file begins outside. This is staged once. Sums of
quotes and of records over blocks, a row a block, then tell which case holds
and the number of a block's first record; only records that lie in several
Arrow batches or blocks are put together by a shuffle.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.sources import shared

BOM = "﻿"
#: A whole record, a part of one, or the sums of a block: its quotes, and the records that start in it if it begins outside or inside of quotes.
PIECES = "file string, block long, inside boolean, number long, piece long, record string, part string, quotes long, if_outside long, if_inside long"
ARROW_PIECES = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in PIECES.split(", "))])


def _rows(n: int, **columns) -> pa.RecordBatch:
    """``n`` rows; a column that is not given is null."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in ARROW_PIECES], schema=ARROW_PIECES)


class _Block:
    """The lines of one block, batch by batch."""

    def __init__(self, file: str, block: int):
        self.file, self.block = file, block
        self.quotes, self.pieces, self.starts = 0, 0, [0, 0]

    def add(self, lines: pa.Array, quotes: np.ndarray, blank: np.ndarray) -> Iterator[pa.RecordBatch]:
        before = self.quotes + np.cumsum(quotes) - quotes
        self.quotes += int(quotes.sum())
        for inside in (0, 1) if self.block else (0,):
            within = (before + inside) % 2 == 1
            kept = np.flatnonzero(within | ~blank)
            if not len(kept):
                continue
            begins = ~within[kept]
            heads = np.union1d([0], np.flatnonzero(begins))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([*heads, len(kept)], pa.int32()), lines.take(pa.array(kept))), "\n")
            whole = begins[heads]
            whole[-1] = False  # the next batch or block may go on with it
            n, whole = len(heads), pa.array(whole)
            yield _rows(
                n,
                file=pa.repeat(self.file, n),
                block=pa.repeat(self.block, n),
                inside=pa.repeat(bool(inside), n),
                number=pa.array(self.starts[inside] + np.cumsum(begins)[heads]),
                piece=pa.array(self.pieces + np.arange(n)),
                record=pc.if_else(whole, texts, None),
                part=pc.if_else(whole, None, texts),
            )
            self.starts[inside] += int(begins.sum())
            self.pieces += n

    def sums(self) -> pa.RecordBatch:
        outside, inside = self.starts
        return _rows(1, file=pa.array([self.file]), **{c: pa.array([v]) for c, v in (("block", self.block), ("quotes", self.quotes), ("if_outside", outside), ("if_inside", inside))})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, line, quotes, blank), block by block, to pieces of records."""
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        code, block = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
        quotes, blank = b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
        for i, j in pairwise([0, *cuts.tolist(), b.num_rows]):
            file, at = b.column(0)[i].as_py(), int(block[i])
            if now is None or (now.file, now.block) != (file, at):
                if now:
                    yield now.sums()
                now = _Block(file, at)
            yield from now.add(b.column(2).slice(i, j - i), quotes[i:j], blank[i:j])
    if now:
        yield now.sums()


def _staged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The pieces, and (file, block, begun, started) of each block but the files' first: whether it begins inside of quotes, and how many records start before it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), quotes.cast("long").alias("quotes"), (F.rtrim("value", F.lit("\r")) == "").alias("blank")
    )
    pieces = shared.stage(lines.mapInArrow(_pieces, PIECES), "pieces")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.where("quotes is not null").withColumn("begun", F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False)))
    started = F.sum(F.when(F.col("begun"), F.col("if_inside")).otherwise(F.col("if_outside"))).over(before)
    return pieces, shared.stage(blocks.select("file", "block", "begun", started.alias("started")).where("block > 0"), "blocks")


def _settled(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """``pieces`` of the case that holds, with their numbers in the file."""
    rows = pieces.join(F.broadcast(blocks), ["file", "block"], "left").where(F.col("inside") == F.coalesce("begun", F.lit(False)))
    return rows.withColumn("number", F.col("number") + F.coalesce("started", F.lit(0)))


def _together(parts: DataFrame, text: Column) -> DataFrame:
    """Records from all of their parts; blocks of a file may have been read in any order, so parts are ordered by block first."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "piece", text.alias("text"))))
    return parts.groupBy("file", "number").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("record"))


def _records(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    whole = _settled(pieces.where("record is not null"), blocks).select("file", "number", "record")
    parted = _together(_settled(pieces.where("part is not null"), blocks), F.col("part"))
    return whole.unionByName(parted).select("file", "number", _closed(F.col("record")).alias("record"))


def _closed(record: Column) -> Column:
    return F.regexp_replace(record, "\r\\z", "")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record): numbers from 1, the header, in the order of each file; blank lines between records don't count.

    A quoted field may hold line ends; a carriage return before the line end
    that closes a record is dropped. The first file's byte order mark stays in
    its header. A quote that is never closed makes the rest of its file one
    record.
    """
    return _records(*_staged(spark, path))


def csv_rows(spark: SparkSession, path: str, *, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the header, all strings, with ``_row``: the record's number in its file, 2 for the first after the header.

    Files of a folder share one header; a missing ``required`` column or a file
    with another header raises.
    """
    pieces, blocks = _staged(spark, path)
    firsts = _settled(pieces.where("number <= 1 and inside is not null"), blocks).where("number = 1")
    headers = [r["record"] for r in _together(firsts, F.coalesce("record", "part")).select(_closed(F.col("record")).alias("record")).distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError("the files have different headers")
    # A header is a handful of names, so the driver cuts it.
    names = next(csv.reader(io.StringIO((headers or [""])[0].removeprefix(BOM), newline="")), [])
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1", "emptyValue": ""}
    parsed = _records(pieces, blocks).where("number > 1").select(F.col("number").alias("_row"), F.from_csv("record", F.lit(schema), options).alias("r"))
    return parsed.select("_row", "r.*")


def numbered_problem(problem: Column, row: Column) -> Column:
    return F.when(problem.isNotNull(), F.format_string("row %d: %s", row, problem))
