"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank.

1. Equal vectors are folded into one representative with a count.
2. On a bounded sample without its near copies, rotations are learned that bring the centred vectors
   close to the corners of a cube; cutting at the sample's medians gives
   balanced bits. Several rotations give as many bits as the tables need.
3. The code is cut into ``tables`` substrings; vectors with an equal substring
   share a bucket of that table. Codes that differ in fewer bits than there
   are tables always meet (pigeonhole). Substrings widen with the table, so
   that buckets stay small, and the number of tables widens with them, so that
   a pair at the threshold is met as likely in a large table as in a small one.
4. In a bucket, cosines are reranked block against block. The tables carry
   vectors rounded to 16 bits: a cosine that is further from the threshold than
   the rounding can move it is settled by them. A block pair with a closer one
   is done again with the original vectors in double precision, so that every
   link is the one that double precision gives. A pair is counted in the first
   table where it meets.

A large bucket is split into blocks and a task gets one pair of blocks, so no
task's work grows with a bucket. Links are never listed: a task returns each
vector's number of links and a spanning forest. One shuffle carries the
tables; the original vectors are shuffled once, to fold equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import scratch
from corpuslab.llm.components import components, roots
from corpuslab.llm.kernels import U64, lean, mix64

BLOCK = 768
RECALL = 0.995
MOST_TABLES = 64
#: Groups up to this size are compared together, pair distance by pair distance.
SMALL = 48
#: Rows of a list of buckets that may be broadcast (about 3 MB); longer lists are joined by a shuffle.
BROADCAST_ROWS = 100_000


def tables_for(width: int, least: float, tables: int) -> int:
    """``tables``, or as many more as a pair at cosine ``least`` needs to meet with a chance of ``RECALL``.

    A bit tells two vectors apart with the chance angle / pi, so all bits of a
    substring agree with the chance (1 - angle / pi) ** width.
    """
    agree = (1 - acos(max(-1.0, min(1.0, least))) / pi) ** width
    return tables if agree in (0, 1) else max(tables, ceil(log(1 - RECALL) / log1p(-agree)))


@dataclass(frozen=True)
class Quantiser:
    """Bits of a vector: signs of rotated, centred coordinates against medians."""

    mean: np.ndarray
    turn: np.ndarray
    cut: np.ndarray
    tables: int
    width: int

    def substrings(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables) integers of ``width`` bits."""
        bits = ((unit - self.mean) @ self.turn > self.cut).reshape(len(unit), self.tables, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))


def leaders(unit: np.ndarray, least: float, step: int = 500) -> np.ndarray:
    """Rows of ``unit`` none of which is within ``least`` of an earlier one that is kept.

    A large group of near copies would draw the medians into itself, and bits
    cut there tell its members apart; so a group counts as one vector in a fit.
    """
    kept = unit[:0]
    for s in range(0, len(unit), step):
        part = unit[s : s + step]
        part = part[(part @ kept.T < least).all(axis=1)] if len(kept) else part
        near = np.tril(part @ part.T >= least, -1)
        good = np.ones(len(part), dtype=bool)
        for i in np.flatnonzero(near.any(axis=1)):
            good[i] = not near[i, good].any()
        kept = np.concatenate([kept, part[good]])
    return kept


def learn(unit: np.ndarray, tables: int, width: int, rounds: int = 30, seed: int = 17) -> Quantiser:
    """Iterative quantisation on unit vectors; as many rotations as the bits need."""
    rng = np.random.default_rng(seed)
    mean = unit.mean(axis=0)
    x = unit - mean
    _, axes = np.linalg.eigh(x.T @ x)
    x = x @ axes
    d = x.shape[1]
    turns = []
    for _ in range(ceil(tables * width / d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            corners = np.where(x @ r > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(corners.T @ x)
            r = (u @ vt).T
        turns.append(axes @ r)
    turn = np.concatenate(turns, axis=1)
    # Deal the bits of all rotations over the tables, so that a table does not follow one rotation's order.
    turn = turn[:, rng.permutation(turn.shape[1])[: tables * width]]
    return Quantiser(mean, turn, np.median((unit - mean) @ turn, axis=0), tables, width)


def _matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): rows with ``dim`` finite components that are not all zero."""
    lists = column.to_pylist()
    good, out = [], []
    for i, v in enumerate(lists):
        if v and None not in v and (dim is None or len(v) == dim):
            a = np.array(v, np.float64)
            if np.isfinite(a).all() and a.any():
                good.append(i)
                out.append(a)
    return np.array(good, np.int64), (np.array(out) if dim is not None else out)


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _prepare(dim: int):
    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("unit", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows, m = _matrix(frame.column(1), dim)
            if not len(rows):
                continue
            ids = frame.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            raw = (m + 0.0).view(U64)  # no negative zero
            mark = np.arange(1, dim + 1, dtype=U64)
            keys = [mix64((mix64(raw ^ mix64(mark * U64(c))) * mark).sum(axis=1, dtype=U64)).view(np.int64) for c in (0x9E3779B1, 0x85EBCA77)]
            units = [u.tobytes() for u in _units(m)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys[0]), pa.array(keys[1]), pa.array(units, pa.binary())], schema=schema)

    return run


def _code(q: Quantiser):
    """Each representative's keys, one a table, and its body: all bits of its code, then its vector in 16 bits a component."""
    schema = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary()), ("keys", pa.list_(pa.int32())), ("body", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if not frame.num_rows:
                continue
            unit = np.frombuffer(b"".join(frame.column(2).to_pylist()), np.float64).reshape(frame.num_rows, -1)
            keys = q.substrings(unit).astype(np.int32)
            bits = (keys[:, :, None] >> np.arange(q.width)) & 1
            packed = np.packbits(bits.reshape(len(keys), -1).astype(np.uint8), axis=1)
            small = np.rint(unit * ROUND).astype("<i2")
            body = [a.tobytes() + b.tobytes() for a, b in zip(packed, small, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, q.tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*frame.columns, lists, pa.array(body, pa.binary())], schema=schema)

    return run


#: The 16-bit form of a component of a unit vector is its product with this.
ROUND = 32767


def _margin(dim: int) -> float:
    """How far the cosine of two rounded unit vectors can be from theirs: each is off by at most half a step a component."""
    off = dim**0.5 / (2 * ROUND)
    return 2 * off + off * off + 1e-9


PLACE = ("t", "key", "lo", "hi")
FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("t", pa.int32()), ("key", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _whole(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches cut where a group ends, and the places where their groups start."""
    held = None
    for frame in frames:
        table = pa.Table.from_batches([frame])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        start = _starts(held)
        if start[-1]:
            yield held.slice(0, start[-1]), start[:-1]
            held = held.slice(start[-1])
    if held is not None and held.num_rows:
        yield held, _starts(held)


def _starts(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for c in PLACE:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _rerank(least: float, tables: int, width: int, exact: bool):
    """(rep, links, root) of each group's links; with 16-bit vectors, also the groups to be done again (rep is null)."""
    code = -(-tables * width // 8)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _whole(frames):
            size = np.diff(np.append(start, table.num_rows))
            # Groups above SMALL alone, those below together, so that pairs in memory stay bounded.
            big = np.flatnonzero(size > SMALL)
            few = np.flatnonzero((size > 1) & (size <= SMALL))
            parts = [np.arange(start[g], start[g] + size[g]) for g in big]
            if len(few):
                rows = np.repeat(start[few] - np.append(0, np.cumsum(size[few])[:-1]), size[few]) + np.arange(size[few].sum())
                parts.append(rows)
            for rows in parts:
                yield from group(table.take(pa.array(rows)))

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        block, rep, copies, t, lo, hi = (table.column(c).to_numpy() for c in ("block", "rep", "copies", "t", "lo", "hi"))
        body = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8).reshape(n, -1)
        if exact:
            vector, margin = np.ascontiguousarray(body[:, code:]).view("<f8"), 0.0
        else:
            vector = np.ascontiguousarray(body[:, code:]).view("<i2").astype(np.float64) / ROUND
            margin = _margin(vector.shape[1])
        start = _starts(table)
        which = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        if len(start) == 1 and n > SMALL:
            left = np.flatnonzero(block == lo[0])
            right = left if lo[0] == hi[0] else np.flatnonzero(block == hi[0])
            near = vector[left] @ vector[right].T
            i, j = np.nonzero(near >= least - margin)
            cosine = near[i, j]
            i, j = left[i], right[j]
            if lo[0] == hi[0]:
                i, j, cosine = i[i < j], j[i < j], cosine[i < j]
        else:
            found = []
            for k in range(1, SMALL):
                i = np.flatnonzero(which[k:] == which[:-k])
                if not len(i):
                    break
                j = i + k
                met = (lo[i] == hi[i]) | (block[i] != block[j])
                i, j = i[met], j[met]
                cosine = np.einsum("ij,ij->i", vector[i], vector[j])
                near = cosine >= least - margin
                found.append((i[near], j[near], cosine[near]))
            i, j, cosine = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        if not len(i):
            return
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        bits = np.unpackbits(body[used, :code], axis=1)[:, : tables * width].reshape(len(used), tables, width)
        codes = bits @ (1 << np.arange(width, dtype=np.int64))
        x, y = at[: len(i)], at[len(i) :]
        first = np.concatenate([(codes[x[s : s + 65536]] == codes[y[s : s + 65536]]).argmax(axis=1) for s in range(0, len(x), 65536)]) == t[i]
        i, j, cosine = i[first], j[first], cosine[first]
        again = np.zeros(len(start), dtype=bool)
        if not exact:
            again[which[i[cosine < least + margin]]] = True
            sure = ~again[which[i]]
            i, j = i[sure], j[sure]
        links = np.zeros(n, np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        order = np.argsort(rep, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        root = rep[order][roots(place[i], place[j], n)[place]]
        keep = (links > 0) | (root != rep)
        if keep.any():
            none = [pa.nulls(int(keep.sum()), pa.int32())] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in (rep, links, root)), *none], schema=FOUND)
        if again.any():
            g = pa.array(start[again])
            none = [pa.nulls(len(g), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*none, *(table.column(c).take(g).combine_chunks() for c in PLACE)], schema=FOUND)

    return run


def _checked(df: DataFrame) -> DataFrame:
    """A staged list of buckets, to be broadcast only if it is short."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def near_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int = 16, sample: int = 20_000
) -> DataFrame:
    """One row a row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Two vectors link when their cosine is at least ``least``. The quantiser is
    fitted on at most ``sample`` vectors, those with the least id hash, of
    which near copies of others are left out of the fit (``leaders``); every
    vector is indexed in ``tables`` tables, or in more if the width of their
    substrings asks for it (``tables_for``). Vectors that are null, empty, zero, hold a null or
    non-finite component, or have another length than most of the sample link
    with nothing and are their own component, as do rows with a null id
    (component null, kept). Each row counts as a vector of its own, repeated
    rows too. Extra columns are not read; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    known = base.where("id is not null")
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    _, good = _matrix(pa.array([None if v is None else list(v) for v in drawn], pa.list_(pa.float64())), None)
    none = base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not good:
        return none
    lengths = np.bincount([len(v) for v in good])
    dim = int(len(lengths) - 1 - np.argmax(lengths[::-1]))
    unit = leaders(_units(np.array([v for v in good if len(v) == dim])), least)
    ready = scratch.stage(known.mapInArrow(lean(_prepare(dim)), "id long, k1 long, k2 long, unit binary"), "vectors")
    total = ready.count()
    width = min(20, max(4, ceil(log2(max(2, total))) - 2))
    while width > 1 and tables_for(width, least, tables) > max(tables, MOST_TABLES):
        width -= 1  # a low threshold: larger buckets rather than missed pairs
    q = learn(unit, tables_for(width, least, tables), width)
    # Of equal vectors the one of the least id; the only shuffle of original vectors.
    fold = ready.groupBy("k1", "k2").agg(F.min(F.struct("id", "unit")).alias("first"), F.count("*").alias("copies"))
    fold = scratch.stage(fold.select("k1", "k2", F.col("first.id").alias("rep"), "copies", F.col("first.unit").alias("unit")), "folded")
    named = ready.select("id", "k1", "k2").join(fold.select("k1", "k2", "rep", "copies"), ["k1", "k2"])
    named = scratch.stage(named.select("id", "rep", "copies"), "named")
    coded = fold.select("rep", "copies", "unit").mapInArrow(lean(_code(q)), "rep long, copies long, unit binary, keys array<int>, body binary")
    coded = scratch.stage(coded, "hamming-codes")
    full = coded.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    full = scratch.stage(full.select("t", "key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "buckets")

    def seats(*columns: str) -> DataFrame:
        """A row for each representative, table and pair of blocks of its bucket."""
        rows = coded.select("rep", *columns, F.posexplode("keys").alias("t", "key")).join(_checked(full), ["t", "key"], "left")
        rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.select("t", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", *columns)

    def reranked(rows: DataFrame, exact: bool) -> DataFrame:
        rows = rows.repartition(scratch.parts(spark), *PLACE).sortWithinPartitions(*PLACE)
        return rows.mapInArrow(lean(_rerank(least, q.tables, width, exact)), "rep long, links long, root long, t int, key int, lo int, hi int")

    once = scratch.stage(reranked(seats("copies", "body"), False), "links")
    close = scratch.stage(once.where("rep is null").select(*PLACE), "close")
    code = -(-q.tables * width // 8)
    original = coded.select("rep", "copies", F.concat(F.expr(f"substring(body, 1, {code})"), "unit").alias("body"))
    again = seats().join(_checked(close), list(PLACE), "left_semi").join(original, "rep")
    again = scratch.stage(reranked(again, True), "close-links")
    found = once.where("rep is not null").unionByName(again)
    scratch.discard(ready, fold, coded, full, close)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(found.where("root <> rep").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    out = named.join(links, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = base.join(out.groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component")), "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
