"""Integer vectors and tiles: what the exact searches and the clustering share.

A vector is scaled and floored once and then carried as little-endian 32-bit
integers. A search deals its rows into shards of bounded size and meets each
shard with blocks of queries: a tile is one shard with one group of queries,
and its rows come before its queries, so a task holds one shard and streams
the queries past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.columns import col
from corpuslab.llm.kernels import lean

#: Scaled components are below this in size, so that sums of products of 64 of them (and of squared differences) fit in 63 bits.
LARGEST = 1 << 27
#: Queries of a tile.
GROUP = 4096


def parse(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ints): the rows that hold ``dim`` finite components, and floor(scale * component) of them.

    A component whose integer reaches ``LARGEST`` raises: scores would not fit in a long.
    """
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = column.filter(right).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    m = flat.reshape(len(rows), dim)
    good = np.isfinite(m).all(axis=1)
    m = np.floor(scale * m[good])
    if m.size and np.abs(m).max() >= LARGEST:
        raise ValueError(f"a component times {scale} reaches {LARGEST}; scale the vectors down")
    return rows[good], m.astype(np.int64)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """(n, dim) integers of packed vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def packed(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m.astype("<i4")], pa.binary())


def usual_length(vectors: DataFrame, vector_col: str) -> int:
    """The length that most vectors have, the greater of equals; 0 without vectors."""
    sizes = vectors.select(F.size(col(vector_col)).alias("n")).where("n > 0").groupBy("n").count()
    first = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else 0


def prepared(vectors: DataFrame, *, id_col: str, vector_col: str, dim: int, scale: int, keep: dict | None = None) -> DataFrame:
    """(id, *keep, vec, norm): rows with a whole vector, its packed integers and the sum of their squares.

    ``keep`` gives names and expressions of further columns.
    """
    keep = keep or {}
    rows = vectors.select(col(id_col).cast("long").alias("id"), *[e.alias(n) for n, e in keep.items()], col(vector_col).alias("vec"))
    types = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at, m = parse(frame.column(frame.num_columns - 1), dim, scale)
            others = [frame.column(i).take(pa.array(at)) for i in range(frame.num_columns - 1)]
            names = [*frame.schema.names[:-1], "vec", "norm"]
            yield pa.RecordBatch.from_arrays([*others, packed(m), pa.array((m * m).sum(axis=1))], names=names)

    return rows.mapInArrow(lean(run), f"{types}, vec binary, norm long")


def sample(ready: DataFrame, total: int, most: int, *columns: str) -> list:
    """At most ``most`` rows of ``total``, those of the least id hash; about as many reach the sort."""
    share = min(1.0, 2 * most / max(1, total))
    h = F.xxhash64("id", F.lit(5))
    drawn = ready.where(F.pmod(h, F.lit(1 << 32)) < int(share * (1 << 32)))
    return drawn.orderBy(h, "id", "vec").limit(most).select(*columns).collect()


def numbered(queries: DataFrame) -> DataFrame:
    """Queries with a number each, fixed once they are staged; equal rows are one query."""
    return queries.distinct().withColumn("qno", F.monotonically_increasing_id())


def groups(queries: int) -> int:
    return max(1, -(-queries // GROUP))


def _runs(frame: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    if frame.num_rows:
        marks = np.stack([frame.column(c).to_numpy() for c in ("shard", "grp", "kind")])
        edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *edges], [*edges, frame.num_rows], strict=True):
            yield tuple(int(x) for x in marks[:, a]), frame.slice(a, b - a)


def _tiles(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    place, held, rows = None, [], None
    for frame in frames:
        for (shard, grp, kind), part in _runs(frame):
            if (shard, grp) != place:
                place, held, rows = (shard, grp), [], None
            if kind == 0:
                held.append(part)
            elif held:
                rows = rows if rows is not None else pa.Table.from_batches(held)
                yield rows, part


def meet(rows: DataFrame, queries: DataFrame, n_groups: int, parts: int, order: str, search: Callable, schema: str) -> DataFrame:
    """``search(tile's rows, batch of its queries)``, a record batch, for every tile.

    ``rows`` have a shard, ``queries`` the shards they go to and a number
    ``qno`` that deals them into groups; each group sees all rows of its shard.
    """
    rows = rows.withColumn("kind", F.lit(0)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    queries = queries.withColumn("kind", F.lit(1)).withColumn("grp", F.pmod(F.xxhash64("qno"), F.lit(n_groups)).cast("int"))
    both = rows.unionByName(queries, allowMissingColumns=True)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, part in _tiles(frames):
            yield search(tile, part)

    both = both.repartition(parts, "shard", "grp").sortWithinPartitions("shard", "grp", "kind", order)
    return both.mapInArrow(lean(run), schema)


def top(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` rows of highest score, then least id, of each group, with their ``rank``; each task's best are taken before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: The floor of an owner of whom nothing is known.
NONE = int(np.iinfo(np.int64).min)


class Best:
    """The ``most`` pairs (score, id) of highest score, then least id, for each owner; ``floor`` is a score that so many reach."""

    def __init__(self, most: int, floor: np.ndarray):
        self.most, self.floor = most, floor
        self.owner = self.score = self.id = np.zeros(0, np.int64)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        last = rank == self.most - 1
        self.floor[owner[last]] = np.maximum(self.floor[owner[last]], score[last])
        keep = rank < self.most
        self.owner, self.score, self.id = owner[keep], score[keep], ids[keep]
