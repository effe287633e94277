"""Scoring holds one call's texts at a time, not a frame's."""

from types import SimpleNamespace

import pyarrow as pa

from corpuslab.operators import scoring


def test_texts_of_one_call_at_a_time():
    held = {}
    rows = SimpleNamespace(schema={"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    rows.select = lambda *c: rows
    rows.mapInArrow = lambda run, schema: held.update(run=run) or rows
    rows.withColumnRenamed = lambda *c: rows
    scoring.score_many(rows, lambda: lambda texts: [len(t) / 100 for t in texts], id_col="id", text_col="text", batch=7)
    texts = [None if i % 10 == 0 else "x" * i for i in range(60)]
    frame = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["id", "text"])
    parts = list(held["run"](iter([frame])))
    assert max(p.num_rows for p in parts) <= 7
    got = [(r["id"], r["p"], r["label"]) for p in parts for r in p.to_pylist()]
    assert got == [(i, None if t is None else i / 100, None if t is None else int(i >= 50)) for i, t in enumerate(texts)]
