"""Queries without an oracle that must not leave rows out."""

import hashlib

import pyarrow.parquet as pq

from corpuslab.operators import terms
from corpuslab.plans import models, relational, scalars  # noqa: F401  (they register their queries)
from corpuslab.plans.registry import QUERIES, Tables

SF = "/root/testdata/sf0.001"


def test_template_rotation_takes_every_document(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "source"]).to_pylist()
    used, want = {}, {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        start = int(hashlib.sha256(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % 12
        taken = used.setdefault(r["source"], set())
        want[r["doc_id"]] = next((k % 12 for k in range(start, start + 12) if k % 12 not in taken), None)
        taken.add(want[r["doc_id"]])
    got = QUERIES["win08_template_rotation"](spark, SF).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.template for r in got} == want


def test_causal_layout_keeps_every_word(spark):
    texts = pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn", "text"]).to_pylist()
    got = {(r.conv_id, r.turn): r for r in QUERIES["arr04_causal_layout"](spark, SF).collect()}
    assert len(got) == len(texts)
    for r in texts:
        ids = [str(len(w)) for w in r["text"].split()]
        row = got[r["conv_id"], r["turn"]]
        assert row.fits and row.n_ids == len(ids)
        assert row.variable.split(",")[: len(ids) + 1] == [*ids, "2"]
        assert row.fixed.split(",") == [*ids, *["0"] * (511 - len(ids)), "2"]


def test_causal_layout_reports_rows_over_the_context(spark):
    rows = spark.createDataFrame([(1, 0, [5, 6, 7]), (1, 1, [5, 6]), (1, 2, [5]), (2, 0, [1] * 9), (3, 0, [])], "conv_id long, turn int, ids array<int>")
    got = sorted(tuple(r) for r in scalars.whole_layout(rows, 3).collect())
    assert got == [(1, 0, 3, False, None, None), (1, 1, 2, True, "5,6,2", "5,6,2"), (1, 2, 1, True, "5,2,0", "5,0,2"), (2, 0, 9, False, None, None), (3, 0, 0, True, "2", "0,0,2")]


def test_fits_drop_no_terms_below_the_default(spark):
    rows = models._labelled(Tables(spark, "/root/testdata/sf0.01"))
    assert models.TERMS >= 200_000 and terms.dictionary(rows, text_col="text").count() > 20_000
