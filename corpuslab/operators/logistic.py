"""L2 logistic regression on sparse vectors: L-BFGS over sums that the tasks make.

Spark's own estimator divides each feature by its deviation before it
optimises. Rare terms have tiny deviations, so with 200,000 terms it needs
some 200 passes. Here steps are scaled by each term's own curvature, which
takes about 25. Vectors are packed once into binary blocks, which a pass reads
without touching their numbers one by one. A pass is one Arrow-batched map over
the blocks and one sum by block of terms; the driver holds coefficients, whose number the dictionary
bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.sources import shared

#: Coefficients of a block, the unit in which sums travel.
BLOCK = 4096
#: Entries of the vectors that a task of a pass reads, and tasks that there are at least.
ENTRIES, LEAST_TASKS = 4_000_000, 8
#: Entries of a packed block, one row at least.
PACKED = 1 << 18
PARTS = pa.schema([("block", pa.int32()), ("part", pa.binary())])


def _entries(frame: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of entries a row, index and value of each entry) of vectors as lists."""
    lists = frame.column("indices")
    return np.diff(np.asarray(lists.offsets)), lists.flatten().to_numpy(), frame.column("values").flatten().to_numpy()


def _packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: labels, numbers of entries, indices and values, each as one binary."""
    for frame in frames:
        i, ends = 0, np.append(0, np.cumsum(_entries(frame)[0]))
        while i < frame.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + PACKED, side="right")) - 1)
            part = frame.slice(i, j - i)
            size, index, value = _entries(part)
            cells = (part.column("label").to_numpy().astype("<f8"), size.astype("<i4"), index.astype("<i4"), value.astype("<f4"))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["label", "size", "indices", "values"])
            i = j


def _blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(label and number of entries a row, index and value of each entry) of packed blocks."""
    for frame in frames:
        for k in range(frame.num_rows):
            get = lambda c, kind, f=frame, k=k: np.frombuffer(f.column(c)[k].as_buffer(), kind)
            yield get("label", "<f8"), get("size", "<i4"), get("indices", "<i4"), get("values", "<f4").astype(np.float64)


def _margins(size: np.ndarray, index: np.ndarray, value: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margin a row, row of each entry); the last weight is the intercept."""
    own = np.repeat(np.arange(len(size)), size)
    return np.bincount(own, value * weights[index], len(size)) + weights[-1], own


def _parts(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in range(0, len(sums), BLOCK):
        part = sums[b : b + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=PARTS)


def _gradient(weights: np.ndarray) -> Callable:
    """The sums of a task's rows: the gradient of the log losses, then the losses."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros(len(weights)), 0.0
        for y, size, index, value in _blocks(frames):
            z, own = _margins(size, index, value, weights)
            loss += np.logaddexp(0, np.where(y == 1, -z, z)).sum()
            rest = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
            total += np.bincount(index, value * rest[own], len(total))
            total[-1] += rest.sum()
        yield from _parts(np.append(total, loss))

    return run


def _squares(size: int) -> Callable:
    """The sums of a task's squared values, then its rows."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for y, _, index, value in _blocks(frames):
            total += np.bincount(index, value * value, size + 1)
            total[-1] += len(y)
        yield from _parts(total)

    return run


def _added(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for frame in frames:
        for b, part in zip(frame.column("block").to_pylist(), frame.column("part").to_pylist(), strict=True):
            held[b] = held.get(b, 0) + np.frombuffer(part)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], schema=PARTS)


@dataclass(frozen=True)
class Logistic:
    """Coefficients with the intercept last, and the passes that the fit took."""

    weights: np.ndarray
    passes: int

    def score(self, rows: DataFrame, *keep: str) -> DataFrame:
        """(*keep, p, prediction): the probability of class 1."""
        weights = self.weights
        names = [*keep, "p", "prediction"]

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                z = _margins(*_entries(frame), weights)[0] if frame.num_rows else np.zeros(0)
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                kept = [frame.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((z > 0).astype(np.float64))], names=names)

        types = dict(rows.dtypes)
        return rows.select(*keep, "indices", "values").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", p double, prediction double")


def fit(rows: DataFrame, *, size: int, c: float = 3.0, most: int = 100, tolerance: float = 3e-3) -> Logistic:
    """Minimise the sum of log losses times ``c`` plus half the squared weights, the intercept's among them.

    ``rows`` has ``label`` (0 or 1, double), ``indices`` below ``size`` and
    ``values``. Ends when the gradient has shrunk to ``tolerance`` of its first
    length, or after ``most`` steps. No rows raise.
    """
    rows = rows.select("label", "indices", "values")
    n, entries = rows.agg(F.count("*"), F.sum(F.size("indices"))).first()
    if not n:
        raise ValueError("no rows to fit on")
    # A task's sums are as long as the dictionary, so tasks are few enough for the entries they read to outweigh them.
    tasks = max(LEAST_TASKS, -(-entries // ENTRIES))
    rows = shared.stage(rows.mapInArrow(_packed, "label binary, size binary, indices binary, values binary"), "packed").coalesce(tasks)
    blocks = -(-(size + 2) // BLOCK)
    parts = -(-blocks // 16)

    def summed(run: Callable) -> np.ndarray:
        sums = rows.mapInArrow(run, "block int, part binary").repartition(parts, "block").mapInArrow(_added, "block int, part binary")
        total = np.zeros(size + 2)
        for r in sums.collect():  # size + 2 numbers, whatever the rows
            part = np.frombuffer(r["part"])
            total[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
        return total

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = summed(_gradient(w))
        return total[-1] / n + w @ w / (2 * c * n), total[:-1] / n + w / (c * n)

    w = np.zeros(size + 1)
    # The loss bends by a quarter of a squared value at most.
    curve = summed(_squares(size))[:-1] / (4 * n) + 1 / (c * n)
    f, g = at(w)
    first, passes, pairs = np.linalg.norm(g), 2, []
    for _ in range(most):
        if np.linalg.norm(g) <= tolerance * first:
            break
        d, step = _direction(g, curve, pairs), 1.0
        while True:
            f1, g1 = at(w + step * d)
            passes += 1
            if f1 <= f + 1e-4 * step * (g @ d) or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:
            break
        if (s := step * d) @ (y := g1 - g) > 0:
            pairs = [*pairs[-9:], (s, y)]
        w, f, g = w + step * d, f1, g1
    return Logistic(w, passes)


def _direction(g: np.ndarray, curve: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient times the inverse curvature: each term's own, corrected by what the last steps show."""
    q, back = -g, []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        back.append(a)
        q = q - a * y
    q = q / curve
    if pairs:
        s, y = pairs[-1]
        q = q * ((s @ y) / (y @ (y / curve)))
    for (s, y), a in zip(pairs, reversed(back), strict=True):
        q = q + (a - (y @ q) / (s @ y)) * s
    return q
