"""Connected components by alternating large and small stars.

Edges are first thinned in each task to a forest of stars. Then every round
points each node's larger neighbours at its least neighbour (large star) and
each node and its smaller neighbours at the least of them (small star), until
the edges stop changing: a star for each component, its least node in the
middle. A node's edges are never gathered; minima are map-side combined and
joined back, and a round is written to the shared folder before the next. Edges that
are few enough for one task's memory (``ONE_TASK``) are settled there at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import scratch
from corpuslab.llm.kernels import lean

#: Edges that one task may hold: 16 MB of node pairs.
ONE_TASK = 1_000_000
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    low = nodes[roots(place[: len(u)], place[len(u) :], len(nodes))]
    keep = low != nodes
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], schema=EDGES)


def _thin(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        yield _stars(frame.column(0).to_numpy(), frame.column(1).to_numpy())


def _settle(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(f.column(0).to_numpy(), f.column(1).to_numpy()) for f in frames if f.num_rows]
    if held:
        yield _stars(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _labels(stars: DataFrame) -> DataFrame:
    middle = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(middle)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    ``edges`` has two long columns u, v in any direction; loops and repeats do
    no harm. No edges give no rows.
    """
    now = edges.where("u <> v").mapInArrow(lean(_thin), "u long, v long").distinct()  # u > v from here on
    now, state = scratch.stage(now, "edges"), None
    if now.count() <= ONE_TASK:
        return _labels(scratch.stage(now.repartition(1).mapInArrow(lean(_settle), "u long, v long"), "stars"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.stage(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = scratch.stage(small.distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return _labels(now)
        state = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
