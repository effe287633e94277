"""Hard-negative mining by inner products in an orthogonally rotated basis.

The rotation brings the leading principal components of the vectors to the
front. A block of anchors meets a block of rows one slice of components after
another: the product so far, give or take the product of the norms of what is
left, bounds the score, and a slack covers every rounding of the rotation and
the products. Rows that can't be among an anchor's best, or lie outside every
band of scores wanted, are discarded as soon as the bound says so. What
survives is verified with products of integers, and these alone are returned.

Rows lie in shards and anchors stream past them in blocks; floors taken from a
bounded sample of the rows spare most shards most of the work.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import scratch
from corpuslab.llm.columns import col
from corpuslab.llm.int_vectors import NONE, Best, groups, matrix, meet, numbered, prepared, sample, top, usual_length
from corpuslab.llm.kernels import lean

SHARD = 16_384
SAMPLE = 4096
#: Anchors and rows of a block; pairs of a block that are followed one by one rather than as a matrix.
ANCHORS, ROWS, FEW = 256, 2048, 1 / 16


class Rotation:
    """Principal axes of integer vectors, leading first, and how far a product of rotated vectors can be from the integer one."""

    def __init__(self, x: np.ndarray):
        d = x.shape[1]
        m = x.astype(np.float64)
        _, axes = np.linalg.eigh(m.T @ m)
        self.axes = axes[:, ::-1].copy()
        u = 2.0**-53
        g = (d + 2) * u / (1 - (d + 2) * u)
        skew = np.linalg.norm(self.axes.T @ self.axes - np.eye(d)) + d * g
        # The axes are orthogonal up to skew; rotating either vector and summing the product round, each by at most g a term.
        self.slack = 2 * (skew + (2 * d**0.5 + 2) * g)
        self.cuts = sorted({max(1, d // 4), max(1, d // 2), max(1, 3 * d // 4), d})

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rotated vectors, norm of what follows each cut, norm) of integer vectors."""
        r = x.astype(np.float64) @ self.axes
        after = np.concatenate([np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(r), 1))], axis=1)
        return r, np.sqrt(after[:, self.cuts]) * (1 + 1e-12), np.sqrt((x * x).sum(axis=1).astype(np.float64)) * (1 + 1e-12)


def survivors(rotation: Rotation, a: tuple, x: tuple, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that are allowed and whose score can lie within the anchor's ``least`` and ``most``.

    ``a`` and ``x`` are integer vectors followed by what ``turned`` gave for them.
    """
    _, ra, after_a, norm_a = a
    _, rx, after_x, norm_x = x
    low, high = least[:, None], most[:, None]
    slack = rotation.slack * np.outer(norm_a, norm_x)
    part, begin = np.zeros(allowed.shape), 0
    i = j = None
    for c, end in enumerate(rotation.cuts):
        if i is None:
            part = part + ra[:, begin:end] @ rx[:, begin:end].T
            off = np.outer(after_a[:, c], after_x[:, c]) + slack
            allowed = allowed & (part + off >= low) & (part - off <= high)
            if allowed.sum() <= FEW * allowed.size or end == rotation.cuts[-1]:
                i, j = np.nonzero(allowed)
                part, slack = part[i, j], slack[i, j]
        else:
            part = part + np.einsum("ij,ij->i", ra[i, begin:end], rx[j, begin:end])
            off = after_a[i, c] * after_x[j, c] + slack
            keep = (part + off >= least[i]) & (part - off <= most[i])
            i, j, part, slack = i[keep], j[keep], part[keep], slack[keep]
        begin = end
    return i, j


def exact(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of pairs, a bounded number at a time."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 16):
        out[s : s + (1 << 16)] = (a[i[s : s + (1 << 16)]] * x[j[s : s + (1 << 16)]]).sum(axis=1)
    return out


def bands(tops: list[list[int]], low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) integer score of each anchor's bands; a band of no score where there is none.

    100 * s lies between 30 * p and 90 * p just if s lies between the quotients rounded inwards.
    """
    n = max([1, *map(len, tops)])
    least, most = np.full((len(tops), n), 1, np.int64), np.zeros((len(tops), n), np.int64)
    for r, t in enumerate(tops):
        for c, p in enumerate(t):
            least[r, c], most[r, c] = -((-low[0] * p) // low[1]), (high[0] * p) // high[1]
    return least, most


class Block:
    """A batch of anchors with the best rows met so far: of the same label, or of others in each positive's band."""

    def __init__(self, part: pa.RecordBatch, rotation: Rotation, most: int, low=None, high=None):
        self.rotation, self.most = rotation, most
        self.x = matrix(part.column("vec"), len(rotation.axes))
        self.turned = (self.x, *rotation.turned(self.x))
        self.id, self.label = (part.column(c).to_numpy() for c in ("id", "label"))
        self.same = low is None
        n, floor = len(self.id), part.column("floor").to_pylist()
        if self.same:
            self.least, self.limit = np.full((n, 1), NONE), np.full((n, 1), np.iinfo(np.int64).max)
        else:
            self.tops = part.column("tops").to_pylist()
            self.least, self.limit = bands(self.tops, low, high)
        self.width = self.least.shape[1]
        known = np.full((n, self.width), NONE)
        for r, f in enumerate(floor):
            for c, v in enumerate((f or [])[: self.width]):  # a row's own bands come first; what follows is padding
                known[r, c] = NONE if v is None else v
        self.best = Best(most, known.ravel())

    def meet(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, turned: tuple) -> None:
        floor = np.maximum(self.best.floor.reshape(-1, self.width), self.least)
        useful = self.least <= self.limit
        least = np.where(useful, floor.astype(np.float64), np.inf).min(axis=1)
        most = np.where(useful, self.limit.astype(np.float64), -np.inf).max(axis=1)
        same = self.label[:, None] == labels[None, :]
        allowed = same & (self.id[:, None] != ids[None, :]) if self.same else ~same
        i, j = survivors(self.rotation, self.turned, (x, *turned), allowed, least, most)
        score = exact(self.x, x, i, j)
        for c in range(self.width):
            fits = (score >= floor[i, c]) & (score <= self.limit[i, c]) & useful[i, c]
            self.best.add(i[fits] * self.width + c, score[fits], ids[j[fits]])

    def floors(self) -> list[list]:
        """The score of the last of ``most`` met rows, where there are so many."""
        f = self.best.floor.reshape(-1, self.width)
        return [[None if v == NONE else v for v in r] for r in f.tolist()]


def _blocks(part: pa.RecordBatch):
    for s in range(0, part.num_rows, ANCHORS):
        yield s, part.slice(s, ANCHORS)


def _met(rotation: Rotation, most: int, low=None, high=None):
    """Search of a tile: (qno, top, score, id) of the best rows; ``top`` is the positive's score, null for positives themselves."""
    known: dict = {"tile": None}

    def search(tile: pa.Table, part: pa.RecordBatch) -> pa.RecordBatch:
        if known["tile"] is not tile:
            x = matrix(tile.column("vec"), len(rotation.axes))
            known.update(tile=tile, x=x, id=tile.column("id").to_numpy(), label=tile.column("label").to_numpy(), turned=rotation.turned(x))
        x, ids, labels, turned = (known[c] for c in ("x", "id", "label", "turned"))
        out = []
        for _, p in _blocks(part):
            b = Block(p, rotation, most, low, high)
            for s in range(0, len(x), ROWS):
                cut = slice(s, s + ROWS)
                b.meet(x[cut], ids[cut], labels[cut], tuple(t[cut] for t in turned))
            which, c = np.divmod(b.best.owner, b.width)
            tops = pa.nulls(len(which), pa.int64()) if b.same else pa.array([b.tops[r][k] for r, k in zip(which, c, strict=True)], pa.int64())
            qno = p.column("qno").to_numpy()[which]
            out.append(pa.RecordBatch.from_arrays([pa.array(qno), tops, pa.array(b.best.score), pa.array(b.best.id)], names=["qno", "top", "score", "id"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(b.num_rows for b in out) else out[0]

    return search


def _floored(rotation: Rotation, drawn: tuple, most: int, low=None, high=None):
    """Anchors with ``floor``: scores that ``most`` rows of the sample reach, for the positives or for each band."""
    x, ids, labels = drawn
    turned = rotation.turned(x)

    def run(frames):
        for frame in frames:
            for _, p in _blocks(frame):
                empty = pa.array([None] * p.num_rows, pa.list_(pa.int64()))
                b = Block(p.append_column("floor", empty), rotation, most, low, high)
                for s in range(0, len(x), ROWS):
                    cut = slice(s, s + ROWS)
                    b.meet(x[cut], ids[cut], labels[cut], tuple(t[cut] for t in turned))
                yield p.append_column("floor", pa.array(b.floors(), pa.list_(pa.int64())))

    return run


def mine(
    vectors: DataFrame,
    *,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: tuple[int, int] = (30, 100),
    high: tuple[int, int] = (90, 100),
    shard: int = SHARD,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of hard negatives.

    Components become floor(``scale`` * x); a score is the integer inner product
    with the anchor, higher ones come first, ties by smaller id. Anchors are the
    rows for which ``anchors`` holds. An anchor's positives are its first
    ``positives`` rows of the same label and another id; for each, the first
    ``negatives`` rows of other labels with low <= score / positive's score <=
    high are returned (``low`` and ``high`` are fractions; none for a negative
    positive's score). Rows with a null id or label, a null vector, a null or
    non-finite component, or another length than most vectors take no part.
    Rows that repeat are candidates each; an anchor that repeats is one anchor.
    Labels of other types than integers are told apart by 64-bit hashes. Other
    columns are not read; an empty table gives no rows. The rotation and the
    floors come from at most ``SAMPLE`` rows and change the work, not the result.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dim = usual_length(vectors, vector_col)
    if not dim:
        return spark.createDataFrame([], schema)
    number = dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint")
    label = col(label_col).cast("long") if number else F.xxhash64(col(label_col))
    rows = vectors.where(col(id_col).isNotNull() & col(label_col).isNotNull())
    keep = {"label": label, "anchor": F.coalesce(anchors, F.lit(False))}
    ready = scratch.stage(prepared(rows, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale, keep=keep).drop("norm"), "mined")
    total = ready.count()
    if not total:
        return spark.createDataFrame([], schema)
    drawn = sample(ready, total, SAMPLE, "id", "label", "vec") or ready.limit(1).select("id", "label", "vec").collect()
    drawn = (np.array([np.frombuffer(r["vec"], "<i4") for r in drawn]).astype(np.int64), np.array([r["id"] for r in drawn]), np.array([r["label"] for r in drawn]))
    rotation = Rotation(drawn[0])
    asked = scratch.stage(numbered(ready.where("anchor").select("id", "label", "vec")), "anchors")
    n_groups, shards, parts = groups(asked.count()), ceil(total / shard), scratch.parts(spark)
    cells = max(parts, shards * n_groups)
    # Rows are dealt by their place in the staged files, so that no id or label, however frequent, fills a shard.
    dealt = ready.select(F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() * 7, F.lit(shards)).cast("int").alias("shard"), "id", "label", "vec")

    def search(queries: DataFrame, *columns: str, most: int, **kind) -> DataFrame:
        types = ", ".join(f"{n} {t}" for n, t in queries.dtypes) + ", floor array<long>"
        queries = queries.mapInArrow(lean(_floored(rotation, drawn, most, **kind)), types)
        queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return meet(dealt, queries, n_groups, cells, "id", _met(rotation, most, **kind), "qno long, top long, score long, id long")

    first = scratch.stage(top(search(asked, most=positives).drop("top"), ["qno"], positives), "positives")
    tops = first.where("score >= 0").groupBy("qno").agg(F.sort_array(F.collect_set("score"), asc=False).alias("tops"))
    found = search(asked.join(tops, "qno").select("id", "label", "vec", "qno", "tops"), most=negatives, low=low, high=high)
    found = scratch.stage(top(found, ["qno", "top"], negatives), "negatives")
    scratch.discard(ready)
    out = first.select("qno", F.col("id").alias("positive_id"), F.col("score").alias("top")).join(found, ["qno", "top"])
    out = out.join(asked.select("qno", F.col("id").alias("anchor_id")), "qno")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))
