"""Centroid clustering in exact integers, screened in single precision.

A batch of vectors meets all centroids in one float32 matrix product. Each
product is known up to a bound on its rounding error, so each distance lies in
an interval; a centroid whose interval lies wholly above another's cannot be
the nearest. Vectors with one centroid left are settled; for the others the
distances to the centroids left are computed again in 64-bit integers, and the
lowest number wins a tie. A round's sums are exact, so every machine, task
layout and retry gives the same centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import scratch
from corpuslab.llm.int_vectors import matrix, prepared
from corpuslab.llm.kernels import lean

#: Products that are held at a time.
CELLS = 1 << 21


def _screen(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k): which centroids can be the nearest.

    With unit roundoff u, a product of d terms whose factors were rounded to
    single precision is off by at most g |x| |c|, g = (d + 2) u / (1 - (d + 2) u),
    whatever the order of the sum. The last term covers double precision.
    """
    d = x.shape[1]
    u = 2.0**-24
    g = (d + 2) * u / (1 - (d + 2) * u)
    near = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids * centroids).sum(axis=1).astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
    off = 2 * g * np.outer(length, np.sqrt(squares) * (1 + 1e-12)) + (squares + 2 * np.abs(near)) * 2.0**-50
    score = squares - 2 * near  # the squared distance without |x|^2, the same for all centroids
    return score - off <= (score + off).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, vectors that the screen left open) of integer vectors."""
    number = np.empty(len(x), np.int64)
    step, again = max(1, CELLS // len(centroids)), 0
    for s in range(0, len(x), step):
        part = x[s : s + step]
        maybe = _screen(part, centroids)
        won = maybe.argmax(axis=1)
        open_ = np.flatnonzero(maybe.sum(axis=1) > 1)
        again += len(open_)
        i, j = np.nonzero(maybe[open_])
        exact = np.empty(len(i), np.int64)
        for t in range(0, len(i), 1 << 16):
            gap = part[open_[i[t : t + (1 << 16)]]] - centroids[j[t : t + (1 << 16)]]
            exact[t : t + (1 << 16)] = (gap * gap).sum(axis=1)
        order = np.lexsort((j, exact, i))
        first = order[np.searchsorted(i[order], np.arange(len(open_)))] if len(open_) else order
        won[open_] = j[first]
        number[s : s + step] = won
    gap = x - centroids[number]
    return number, (gap * gap).sum(axis=1), again


def _sums(centroids: np.ndarray):
    k, d = centroids.shape

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for frame in frames:
            if frame.num_rows:
                x = matrix(frame.column(0), d)
                number = nearest(x, centroids)[0]
                order = np.argsort(number, kind="stable")
                has, start = np.unique(number[order], return_index=True)
                total[has] += np.add.reduceat(x[order], start, axis=0)
                n += np.bincount(number, minlength=k)
        has = np.flatnonzero(n)
        if len(has):
            yield pa.RecordBatch.from_arrays(
                [pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"]
            )

    return run


def _assign(centroids: np.ndarray):
    d = centroids.shape[1]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                number, distance, _ = nearest(matrix(frame.column(1), d), centroids)
                yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1"
) -> DataFrame:
    """One row a kept vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors with ``dim`` components, none of them null or non-finite, are kept
    and become floor(``scale`` * x). Centroids start as the ``k`` vectors of
    least sha256 of ``seed:id`` (all, if fewer; ties by id, then vector; null
    ids last), and move ``rounds`` times to the componentwise floor of their
    vectors' mean; one without vectors stays. Repeated rows and rows with a
    null id count and come back like any other; other columns are not read; no
    kept vectors give no rows. A component that reaches 2**27 when scaled
    raises. The driver holds ``k`` centroids and their sums, nothing else.
    """
    spark = vectors.sparkSession
    ready = scratch.stage(prepared(vectors, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale).select("id", "vec"), "centroid-vectors")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = ready.orderBy(h.asc_nulls_last(), "id", "vec").limit(k).collect()
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], f"id long, cluster int, distance long{schema.removeprefix('cluster int')}").withColumnRenamed("id", id_col)
    centroids = np.array([np.frombuffer(r["vec"], "<i4") for r in start]).astype(np.int64)
    for _ in range(rounds):
        parts = ready.select("vec").mapInArrow(lean(_sums(centroids)), "cluster int, n long, total array<long>")
        # Sums of a task fit in a long; those of all tasks are decimals, so that no corpus overflows them.
        wide = lambda c: F.sum(c.cast("decimal(20,0)"))
        moved = parts.groupBy("cluster").agg(wide(F.col("n")).alias("n"), F.array(*[wide(F.get("total", F.lit(i))) for i in range(dim)]).alias("total"))
        centroids = centroids.copy()
        for r in moved.collect():
            centroids[r["cluster"]] = [int(t) // int(r["n"]) for t in r["total"]]
    out = scratch.stage(ready.mapInArrow(lean(_assign(centroids)), "id long, cluster int, distance long"), "centroid-clusters")
    scratch.discard(ready)
    spread = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    ends = spark.createDataFrame([(c, s, sum(spread.values()), digest[c]) for c, s in spread.items()], schema)
    both = out.join(F.broadcast(ends), "cluster")
    return both.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
