"""Exact top-k search by inner product in M-trees, best first.

With one more component, sqrt(M^2 - |x|^2) for a row x (M the greatest norm)
and 0 for a query q, the squared distance of q and x is |q|^2 + M^2 - 2 q.x:
the nearest rows are those of the highest inner product, in a metric space.

* The root page routes rows to the nearest of a bounded number of pivots; a
  region's covering radius is its farthest row's distance from the pivot.
* Rows of a region lie in shards of bounded size; a shard's M-tree is built in
  one task and stored as pages: entries with their distance to the page's own
  pivot and, above the leaves, covering radius and child page.
* A query visits pages in the order of the least distance that they can hold.
  An entry is passed over without computing its distance when the stored
  distance to the page's pivot, the query's own and the radius prove it too
  far; the search ends when the next page is farther than the k-th best.

Distances are in double precision with a slack for their rounding; scores in
the leaves are products of integers, and only these are compared and returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import scratch
from corpuslab.llm.columns import col
from corpuslab.llm.int_vectors import NONE, Best, groups, matrix, meet, numbered, prepared, sample, top, usual_length
from corpuslab.llm.kernels import lean

#: Rows of a shard, regions of the root page, rows of the sample, entries of a leaf and of an inner page.
SHARD, REGIONS, SAMPLE, LEAF, FAN = 8192, 1024, 4096, 128, 16
#: What rounding can do to a distance, or a sum of three, as a part of the longest one.
LOOSE = 1e-11


@dataclass(frozen=True)
class Space:
    """The metric space: integer vectors and the square of their greatest norm."""

    dim: int
    square: int

    def height(self, x: np.ndarray) -> np.ndarray:
        """The added component of rows."""
        return np.sqrt((self.square - (x * x).sum(axis=1)).astype(np.float64))

    def points(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x.astype(np.float64), self.height(x)[:, None]], axis=1)

    def slack(self, query: np.ndarray) -> float:
        return LOOSE * 4 * (sqrt(self.square) + sqrt(int((query * query).sum())))


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points ``a`` from the point ``b``, by differences, so that small ones keep their digits."""
    gap = a - b
    return np.sqrt((gap * gap).sum(axis=1))


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of each point's nearest pivot; any near one would do, so a matrix product chooses."""
    half = (pivots * pivots).sum(axis=1) / 2
    number = np.concatenate([(half - points[s : s + 4096] @ pivots.T).argmin(axis=1) for s in range(0, len(points), 4096)])
    gap = points - pivots[number]
    return number, np.sqrt((gap * gap).sum(axis=1))


PAGE = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("ids", pa.binary()), ("vecs", pa.binary()), ("far", pa.binary()), ("radius", pa.binary())])


def tree(space: Space, shard: int, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray) -> Iterator[tuple]:
    """Pages of the M-tree over integer vectors ``x``; ``pivot`` is the point that page 0 belongs to.

    A page is cut into groups around spread-out rows of its own; equal or
    lopsided rows, which that would not part, are cut by their distance from
    the first of them. The tree is as deep as the logarithm of its rows.
    """
    points = space.points(x)
    todo, pages = [(0, np.arange(len(x)), pivot)], 1
    while todo:
        page, rows, centre = todo.pop()
        if len(rows) <= LEAF:
            far = between(points[rows], centre)
            yield shard, page, True, ids[rows].tobytes(), x[rows].astype("<i4").tobytes(), far.tobytes(), b""
            continue
        n = min(FAN, ceil(len(rows) / LEAF))
        seeds = [rows[0]]
        gap = between(points[rows], points[rows[0]])
        while len(seeds) < n and gap.max() > 0:  # farthest first, so that the pivots are spread
            seeds.append(rows[gap.argmax()])
            gap = np.minimum(gap, between(points[rows], points[seeds[-1]]))
        number, _ = _nearest(points[rows], points[seeds])
        size = np.bincount(number, minlength=n)
        if size.max() > len(rows) * 3 / 4:
            order = np.argsort(between(points[rows], points[rows[0]]), kind="stable")
            parts = [rows[o] for o in np.array_split(order, n)]
        else:
            parts = [rows[number == g] for g in np.flatnonzero(size)]
        # The pivot of a part is the row nearest its mean, which keeps the covering radius small.
        pivots = np.array([p[between(points[p], points[p].mean(axis=0)).argmin()] for p in parts])
        radius = np.array([between(points[p], points[c]).max() for p, c in zip(parts, pivots, strict=True)])
        children = np.arange(pages, pages + len(parts), dtype=np.int64)
        far = between(points[pivots], centre)
        yield shard, page, False, children.tobytes(), x[pivots].astype("<i4").tobytes(), far.tobytes(), radius.tobytes()
        todo += zip(children.tolist(), parts, points[pivots], strict=True)
        pages += len(parts)


class Tree:
    """Pages of one shard, opened as they are met."""

    def __init__(self, space: Space, rows: pa.Table):
        self.space, self.rows = space, {p: i for i, p in enumerate(rows.column("page").to_pylist())}
        self.columns = {c: rows.column(c) for c in ("leaf", "ids", "vecs", "far", "radius")}
        self.open: dict[int, tuple] = {}

    def page(self, number: int) -> tuple:
        """(leaf, ids or children, integer vectors or points, distances to the page's pivot, radii or 0)."""
        if number not in self.open:
            i = self.rows[number]
            leaf, ids, vecs, far, radius = (self.columns[c][i].as_py() for c in ("leaf", "ids", "vecs", "far", "radius"))
            x = np.frombuffer(vecs, "<i4").reshape(-1, self.space.dim).astype(np.int64)
            self.open[number] = (leaf, np.frombuffer(ids, np.int64), x if leaf else self.space.points(x), np.frombuffer(far), 0.0 if leaf else np.frombuffer(radius))
        return self.open[number]

    def search(self, query: np.ndarray, own: int, far: float, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids, entries computed) of the ``k`` best rows but ``own``; ``far`` is the distance to the pivot of page 0.

        ``floor`` is a score that ``k`` rows are known to reach; rows below it are left out.
        """
        best = Best(k, np.array([floor], np.int64))
        slack, length, computed = self.space.slack(query), int((query * query).sum()), 0
        point = np.append(query.astype(np.float64), 0.0)
        limit = lambda: np.inf if best.floor[0] == NONE else sqrt(max(0, length + self.space.square - 2 * int(best.floor[0]))) + slack
        heap, reach = [(0.0, 0, far)], limit()
        while heap:
            low, number, far = heapq.heappop(heap)
            if low > reach:
                break
            leaf, ids, rows, stored, radius = self.page(number)
            near = np.flatnonzero(np.abs(far - stored) - radius <= reach)
            computed += len(near)
            if leaf:
                score = rows[near] @ query
                fits = (score >= best.floor[0]) & (ids[near] != own)
                best.add(np.zeros(int(fits.sum()), np.int64), score[fits], ids[near][fits])
                reach = limit()
            else:
                distance = between(rows[near], point)
                for d, r, child in zip(distance.tolist(), radius[near].tolist(), ids[near].tolist(), strict=True):
                    if d - r <= reach:
                        heapq.heappush(heap, (max(0.0, d - r), child, d))
        return best.score, best.id, computed


def _routed(space: Space, pivots: np.ndarray, salts: np.ndarray | None):
    """Rows with their shard; without ``salts``, (region, rows, farthest) of each region met."""
    base = None if salts is None else np.cumsum(salts) - salts

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for frame in frames:
            if frame.num_rows:
                number, distance = _nearest(space.points(matrix(frame.column("vec"), space.dim)), pivots)
                n += np.bincount(number, minlength=len(pivots))
                np.maximum.at(far, number, distance)
        has = np.flatnonzero(n)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(far[has])], names=["region", "n", "far"])

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards of a region are dealt in turn, in the order of the staged file, so that a retry deals alike and a hot region is split.
        met = np.full(len(pivots), TaskContext.get().partitionId(), np.int64)
        for frame in frames:
            if frame.num_rows:
                number, _ = _nearest(space.points(matrix(frame.column("vec"), space.dim)), pivots)
                order = np.argsort(number, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.searchsorted(number[order], number[order])
                shard = base[number] + (met[number] + place) % salts[number]
                met += np.bincount(number, minlength=len(pivots))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), frame.column("id"), frame.column("vec")], names=["shard", "id", "vec"])

    return count if salts is None else deal


def _built(space: Space, pivots: np.ndarray, region: np.ndarray):
    """Pages of the trees of a task's shards; a shard at a time is held."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = None

        def pages() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held)
                found = list(tree(space, place, rows.column("id").to_numpy(), matrix(rows.column("vec"), space.dim), pivots[region[place]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), PAGE.types, strict=True)], schema=PAGE)

        for frame in frames:
            shard = frame.column("shard").to_numpy()
            edges = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, frame.num_rows], strict=True):
                if a < b:
                    if shard[a] != place:
                        yield from pages()
                        held, place = [], int(shard[a])
                    held.append(frame.slice(a, b - a))
        yield from pages()

    return run


def _sent(space: Space, k: int, drawn: tuple, pivots: np.ndarray, radius: np.ndarray, salts: np.ndarray):
    """A row for each query and shard that the root page can't rule out: floor, and distance to the shard's pivot."""
    x, ids = drawn
    base = np.cumsum(salts) - salts

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            q = matrix(frame.column("vec"), space.dim)
            own = frame.column("id").to_numpy()
            for s in range(frame.num_rows):
                known = np.sort((x @ q[s])[ids != own[s]])[::-1]
                floor = int(known[k - 1]) if len(known) >= k else NONE
                far = between(pivots, np.append(q[s].astype(np.float64), 0.0))
                reach = np.inf if floor == NONE else sqrt(max(0, int((q[s] * q[s]).sum()) + space.square - 2 * floor)) + space.slack(q[s])
                near = np.flatnonzero(far - radius <= reach)
                shard = np.concatenate([np.arange(base[r], base[r] + salts[r]) for r in near] or [np.zeros(0, np.int64)]).astype(np.int32)
                n = len(shard)
                alone = frame.slice(s, 1).take(pa.array(np.zeros(n, np.int64)))
                added = [pa.array(shard), pa.array(np.full(n, floor)), pa.array(np.repeat(far[near], salts[near]))]
                yield pa.RecordBatch.from_arrays([*alone.columns, *added], names=[*frame.schema.names, "shard", "floor", "distance"])

    return run


def _searched(space: Space, k: int):
    known: dict = {"rows": None}

    def search(rows: pa.Table, part: pa.RecordBatch) -> pa.RecordBatch:
        if known["rows"] is not rows:
            known.update(rows=rows, tree=Tree(space, rows))
        own, far, floor, qno = (part.column(c).to_numpy() for c in ("id", "distance", "floor", "qno"))
        found = [known["tree"].search(q, own[i], far[i], k, int(floor[i]))[:2] for i, q in enumerate(matrix(part.column("vec"), space.dim))]
        score, ids = (np.concatenate([f[c] for f in found]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qno, [len(f[0]) for f in found])), pa.array(score), pa.array(ids)], names=["qno", "score", "id"])

    return search


def search(vectors: DataFrame, *, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, k: int = 10, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the highest score for each query (all, if fewer).

    Components become floor(``scale`` * x); a score is the integer inner
    product, ties go to the smaller id. Queries are the rows for which
    ``queries`` holds; candidates are the rows of any other id. Rows with a null
    id or vector, a null or non-finite component, or another length than most
    vectors take no part. Rows that repeat are candidates each; a query that
    repeats is one query. Other columns are not read; an empty table gives no
    rows. Pivots and starting floors come from at most ``SAMPLE`` rows and
    change the work, not the result. A component that reaches 2**27 raises.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    dim = usual_length(vectors, vector_col)
    if not dim:
        return spark.createDataFrame([], schema)
    ready = prepared(vectors.where(col(id_col).isNotNull()), id_col=id_col, vector_col=vector_col, dim=dim, scale=scale, keep={"query": F.coalesce(queries, F.lit(False))})
    ready = scratch.stage(ready, "searched")
    whole = ready.agg(F.count("*").alias("n"), F.max("norm").alias("square")).first()
    if not whole["n"]:
        return spark.createDataFrame([], schema)
    space = Space(dim, whole["square"])
    drawn = sample(ready, whole["n"], SAMPLE, "id", "vec") or ready.limit(1).select("id", "vec").collect()
    drawn = (np.array([np.frombuffer(r["vec"], "<i4") for r in drawn]).astype(np.int64), np.array([r["id"] for r in drawn]))
    pivots = space.points(_spread(drawn[0], min(REGIONS, ceil(whole["n"] / shard))))
    regions = ready.select("vec").mapInArrow(lean(_routed(space, pivots, None)), "region int, n long, far double")
    regions = regions.groupBy("region").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()  # at most REGIONS rows
    salts, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in regions:
        salts[r["region"]], radius[r["region"]] = ceil(r["n"] / shard), r["far"]
    asked = scratch.stage(numbered(ready.where("query").select("id", "vec")), "queries")
    n_groups, parts = groups(asked.count()), max(scratch.parts(spark), int(salts.sum()))
    dealt = ready.select("id", "vec").mapInArrow(lean(_routed(space, pivots, salts)), "shard int, id long, vec binary")
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "id")
    region = np.repeat(np.arange(len(pivots)), salts)
    pages = dealt.mapInArrow(lean(_built(space, pivots, region)), "shard int, page int, leaf boolean, ids binary, vecs binary, far binary, radius binary")
    pages = scratch.stage(pages, "m-tree")
    scratch.discard(ready)
    sent = asked.mapInArrow(lean(_sent(space, k, drawn, pivots, radius, salts)), "id long, vec binary, qno long, shard int, floor long, distance double")
    found = meet(pages, sent, n_groups, parts * n_groups, "page", _searched(space, k), "qno long, score long, id long")
    found = scratch.stage(top(found, ["qno"], k), "found")
    out = found.withColumnRenamed("id", "vec_id").join(asked.select("qno", F.col("id").alias("query_id")), "qno")
    return out.select("query_id", "rank", "vec_id", "score")


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` distinct rows of ``x`` at even steps of their order, all if fewer."""
    some = np.unique(x, axis=0)
    return some[np.unique(np.linspace(0, len(some) - 1, n).astype(np.int64))]
