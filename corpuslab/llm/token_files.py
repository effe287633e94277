"""Token-id shards under Re-Pair grammar compression.

Documents are range-partitioned by id and encoded in id order. About
``block_tokens`` ids make a block, which is compressed by itself: in each
round the pairs of neighbouring ids are counted, the frequent ones become
nonterminals, and every non-overlapping occurrence, from the left, is
replaced; rounds go on until no pair is frequent enough, however deep the rules
become. A pair never reaches over a document's end, so documents stay whole numbers of symbols. A block
stores its rules, the length that each rule expands to, and where each
document starts both in ids and in symbols, so that any range of ids can be
decoded without expanding what stands before it.

Blocks are rows of a Parquet dataset (one row a block, binary columns), so
that they are committed or repeated like any Spark output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm import scratch, tokens
from corpuslab.llm.kernels import lean

#: Pairs are counted in 2**bits buckets, no more than that and about as many as there are places.
BUCKETS = 18
#: A rule takes 12 bytes; from 12 occurrences on, at 2 bytes a symbol, it saves twice that.
MIN_COUNT = 12
BINARY = ("doc_ids", "doc_nulls", "doc_tokens", "doc_symbols", "rules", "rule_lengths", "symbols")
BLOCK_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("part", "block", "n_docs", "n_tokens", "terminals")],
        *[T.StructField(c, T.BinaryType()) for c in BINARY],
    ]
)
DOC_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "block", "doc", "at", "n_tokens", "ids_crc32")])


def _bucket(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, *, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as pairs, mask of symbols that end a document).

    ``ends`` marks the last id of each document. Symbol terminals + r stands
    for rule r; a rule refers only to ids and earlier rules. Rounds go on until
    no pair stands ``min_count`` times without overlap. In a round, an
    occurrence gives way to an overlapping one of a more frequent pair, and
    pairs that keep ``min_count`` occurrences become rules; the most frequent
    pair gives way to none, so each round makes a rule. Only places whose
    pair was frequent before or holds a new symbol are counted again; no other
    pair can have become frequent.
    """
    x, ends = ids.astype(np.uint32), ends.copy()
    rules: list[np.ndarray] = []
    count = 0
    live = np.flatnonzero(~ends[:-1])
    while len(live):
        left, right = x[live], x[live + 1]
        # In a run of one symbol every other place counts, from the left: a pair that overlaps itself counts as often as it can be replaced.
        twin = np.flatnonzero(left == right)
        first = np.ones(len(twin), dtype=bool)
        first[1:] = np.diff(live[twin]) != 1
        start = np.maximum.accumulate(np.where(first, np.arange(len(twin)), 0))
        odd = twin[(np.arange(len(twin)) - start) % 2 == 1]
        code = left.astype(np.uint64)
        code <<= np.uint64(32)
        code |= right
        bits = min(BUCKETS, len(live).bit_length())
        bucket = _bucket(code, bits)
        tally = np.bincount(bucket, minlength=1 << bits) - np.bincount(bucket[odd], minlength=1 << bits)
        some = (tally >= min_count)[bucket]
        stay, at = live[some], live
        some[odd] = False
        live, at, code, bucket = stay, at[some], code[some], bucket[some]
        seen = np.sort(code)
        head = np.flatnonzero(np.append(True, seen[1:] != seen[:-1])) if len(seen) else np.zeros(0, np.int64)
        tally = np.diff(np.append(head, len(seen)))
        often = np.flatnonzero(tally >= min_count)
        if not len(often):
            break
        often = often[np.argsort(tally[often], kind="stable")]
        pairs = seen[head[often]]
        rank_of = np.full(1 << bits, -1, np.int32)
        rank_of[_bucket(pairs, bits)] = np.arange(len(pairs))  # of two in a bucket the more frequent; the other waits
        rank = rank_of[bucket]
        own = np.flatnonzero((rank >= 0) & (pairs[rank] == code))
        at, rank = at[own], rank[own]
        beaten = np.zeros(len(at), dtype=bool)
        near = np.diff(at) == 1
        beaten[1:] = near & (rank[:-1] > rank[1:])
        beaten[:-1] |= near & (rank[1:] > rank[:-1])
        hit, rank = at[~beaten], rank[~beaten]
        good = np.bincount(rank, minlength=len(pairs)) >= min_count
        kept = good[rank]
        hit, rank = hit[kept], rank[kept]
        new = pairs[good]
        rules.append(np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        x[hit] = (terminals + count + np.cumsum(good) - 1)[rank].astype(np.uint32)
        ends[hit] = ends[hit + 1]
        count += len(new)
        again, stay = np.zeros(len(x), dtype=bool), np.ones(len(x), dtype=bool)
        again[live] = again[hit] = True
        again[hit[hit > 0] - 1] = True
        stay[hit + 1] = False
        x, ends, again = x[stay], ends[stay], again[stay]
        live = np.flatnonzero(again & ~ends)
    return x, (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), ends


class Grammar:
    """Rules of one block, expanded once."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, terminals: int):
        self.terminals, self.lengths = terminals, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), np.uint32)
        flat, starts = self.flat, self.starts
        for r, (a, b) in enumerate(rules.tolist()):
            at = starts[r]
            for s in (a, b):
                if s < terminals:
                    flat[at] = s
                    at += 1
                else:
                    n = self.lengths[s - terminals]
                    flat[at : at + n] = flat[starts[s - terminals] : starts[s - terminals] + n]
                    at += n

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        deep = symbols >= self.terminals
        out[deep] = self.lengths[symbols[deep] - self.terminals]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.symbol_lengths(symbols)
        out = np.repeat(symbols, n)
        deep = out >= self.terminals
        place = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        out[deep] = self.flat[self.starts[out[deep] - self.terminals] + place[deep]]
        return out


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    out = [0] * len(rules)
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = (1 if a < terminals else out[a - terminals]) + (1 if b < terminals else out[b - terminals])
    return np.array(out, np.uint32)


def _encode(vocabulary: str, end_id: int, block_tokens: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, number = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, parts, held, number
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
            ends = np.zeros(len(ids), dtype=bool)
            ends[np.cumsum(counts) - 1] = True
            symbols, rules, last = compress(ids, ends, enc.size)
            stops = np.flatnonzero(last) + 1
            row = {
                "part": part,
                "block": number,
                "n_docs": len(docs),
                "n_tokens": len(ids),
                "terminals": enc.size,
                "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
                "doc_nulls": bytes(d is None for d in docs),
                "doc_tokens": (np.cumsum(counts) - counts).astype("<i8").tobytes(),
                "doc_symbols": np.concatenate([[0], stops[:-1]]).astype("<i8").tobytes(),
                "rules": rules.astype("<u4").tobytes(),
                "rule_lengths": rule_lengths(rules, enc.size).astype("<u4").tobytes(),
                "symbols": symbols.astype("<u2" if enc.size + len(rules) <= 1 << 16 else "<u4").tobytes(),
            }
            docs, parts, held = [], [], 0
            number += 1
            return pa.RecordBatch.from_pylist([row], schema=ARROW_BLOCK)

        for frame in frames:
            names = frame.column(0).to_pylist()
            for i, j, ids, where in enc.encode(frame.column(1), end_id):
                bounds = where.tolist()
                for doc, first, stop in zip(names[i:j], bounds, bounds[1:], strict=False):
                    docs.append(doc)
                    parts.append(ids[first:stop])
                    held += stop - first
                    if held >= block_tokens:
                        yield flush()
        if docs:
            yield flush()

    return run


ARROW_BLOCK = pa.schema([(f.name, pa.binary() if f.name in BINARY else pa.int64()) for f in BLOCK_SCHEMA])
ARROW_DOC = pa.schema([(c, pa.int64()) for c in DOC_SCHEMA.names])


class Block:
    """One block read back."""

    def __init__(self, row: dict):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.doc_ids, self.doc_tokens, self.doc_symbols = get("doc_ids", "<i8"), get("doc_tokens", "<i8"), get("doc_symbols", "<i8")
        rules, lengths = get("rules", "<u4").reshape(-1, 2), get("rule_lengths", "<u4")
        self.symbols = get("symbols", "<u2" if row["terminals"] + len(rules) <= 1 << 16 else "<u4").astype(np.uint32)
        self.n_tokens = row["n_tokens"]
        self.grammar = Grammar(rules, lengths, row["terminals"])

    def ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the block, expanding only the symbols that they touch."""
        doc = int(np.searchsorted(self.doc_tokens, start, side="right")) - 1
        first, at = int(self.doc_symbols[doc]), int(self.doc_tokens[doc])
        after = int(np.searchsorted(self.doc_tokens, stop, side="left"))
        end = int(self.doc_symbols[after]) if after < len(self.doc_symbols) else len(self.symbols)
        lengths = self.grammar.symbol_lengths(self.symbols[first:end])
        reach = at + np.cumsum(lengths)
        lo = int(np.searchsorted(reach, start, side="right"))
        hi = int(np.searchsorted(reach, stop, side="left")) + 1
        skip = start - (int(reach[lo] - lengths[lo]) if lo < len(reach) else at)
        return self.grammar.expand(self.symbols[first + lo : first + hi])[skip : skip + stop - start]


def _decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for k in range(frame.num_rows):
            row = frame.slice(k, 1).to_pylist()[0]
            block = Block(row)
            raw = memoryview(block.ids().astype("<u4")).cast("B")
            starts = block.doc_tokens.tolist()
            stops = [*starts[1:], block.n_tokens]
            n = len(starts)
            docs = pa.array(block.doc_ids, pa.int64(), mask=np.frombuffer(row["doc_nulls"], np.uint8).astype(bool))
            columns = [[row["part"]] * n, [row["block"]] * n, docs, starts, [b - a for a, b in zip(starts, stops, strict=True)]]
            columns.append([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, stops, strict=True)])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=ARROW_DOC)


def write(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    vocabulary: str | None = None,
    block_tokens: int = 1 << 20,
    partitions: int | None = None,
) -> None:
    """Encode ``docs`` and write blocks under ``path``, ascending by id (null ids first).

    A null or empty text is the end id alone. Repeated ids stand side by side.
    Extra columns are not read; an empty table gives a dataset without rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions or scratch.parts(docs.sparkSession), "doc").sortWithinPartitions("doc")
    rows.mapInArrow(lean(_encode(vocabulary or tokens.default_vocabulary(), end_id, block_tokens)), BLOCK_SCHEMA).write.parquet(path)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, start): the number of ids in all blocks before, from block sizes alone."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.select("part", "block", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(totals, "part").select("part", "block", (F.col("before") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).alias("start"))
    return scratch.stage(starts, "token-starts")


def documents(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """One row a document, decoded from the files: id, start, n_tokens, ids_crc32."""
    found = spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(lean(_decode), DOC_SCHEMA)
    out = found.join(block_starts(spark, path), ["part", "block"])
    return out.select(F.col("doc").alias(id_col), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
