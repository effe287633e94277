"""Batch scoring of texts by a model that lives in the worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Scorer = Callable[[list[str]], list[float]]


def score_many(rows: DataFrame, load: Callable[[], Scorer], *, id_col: str, text_col: str, batch: int = 32, threshold: float = 0.5) -> DataFrame:
    """(id, p, label): the probability of class 1 of each text, at most ``batch`` texts a call.

    ``load`` runs once a task, so a model is read where it is used and never
    sent with the rows. A null or blank text is not scored: p and label are
    null. A scorer that returns another number of values, or one outside of 0
    to 1, fails the task.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer | None = None
        for frame in frames:
            # Slice by slice: only one call's texts stand as Python strings beside the frame.
            for start in range(0, frame.num_rows, batch):
                part = frame.slice(start, batch)
                texts = part.column(1).to_pylist()
                at = [i for i, t in enumerate(texts) if t and t.strip()]
                p: list[float | None] = [None] * len(texts)
                if at:
                    scorer = scorer or load()
                    scores = scorer([texts[i] for i in at])
                    if len(scores) != len(at) or not all(0 <= x <= 1 for x in scores):
                        raise ValueError("a scorer gives one probability a text")
                    for i, x in zip(at, scores, strict=True):
                        p[i] = float(x)
                label = [None if x is None else int(x >= threshold) for x in p]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array(label, pa.int32())], names=["id", "p", "label"])
            del frame
            pa.default_memory_pool().release_unused()  # a worker lives on between tasks

    return rows.select(id_col, text_col).mapInArrow(run, f"id {kind}, p double, label int").withColumnRenamed("id", id_col)
