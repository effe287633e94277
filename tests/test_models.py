"""Dictionary, vectors and logistic fit against plain Python and an exact optimum."""

import re
from collections import Counter
from math import log

import numpy as np
import pytest

from corpuslab.operators import logistic, model, terms


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    common, one, two = ([f"{p}{i}" for i in range(n)] for p, n in (("w", 300), ("x", 40), ("y", 40)))
    out = []
    for i in range(240):
        label = i % 2
        words = list(rng.choice(common, 30)) + list(rng.choice(two if label else one, 2 + i % 3)) + ["Ünï", "a"]
        out.append((i, " ".join(rng.permutation(words)), float(label if i % 11 else 1 - label)))
    return [*out, (900, None, 0.0), (901, "", 1.0), (902, "q", 0.0), (902, "zz zz zz", 1.0)]


def split(text):
    w = re.findall(r"\w\w+", (text or "").lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def weights(texts, min_df=2, max_df=0.98):
    df = Counter(t for _, text, _ in texts for t in set(split(text)))
    n = len(texts)
    idf = {t: log((1 + n) / (1 + c)) + 1 for t, c in df.items() if min_df <= c <= int(n * max_df)}
    out = []
    for _, text, _ in texts:
        w = {t: (1 + log(c)) * idf[t] for t, c in Counter(split(text)).items() if t in idf}
        length = sum(x * x for x in w.values()) ** 0.5
        out.append({t: x / length for t, x in w.items()})
    return idf, out


@pytest.fixture(scope="module")
def fitted(spark, texts):
    rows = terms.spread(spark.createDataFrame(texts, "id long, text string, label double"), "id")
    known = terms.dictionary(rows, text_col="text")
    return known, terms.vectors(rows, known, text_col="text", keep=["id", "label"])


def test_vectors_are_those_of_the_definition(fitted, texts):
    known, vectors = fitted
    idf, want = weights(texts)
    rows = known.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(idf)))
    assert np.allclose(sorted(r["idf"] for r in rows), sorted(idf.values()))
    assert [r["idf"] for r in rows] == sorted(r["idf"] for r in rows)  # the most frequent first
    got = vectors.collect()
    assert len(got) == len(texts) and all(r["indices"] == sorted(set(r["indices"])) for r in got)
    order = lambda i, label, values: (i, label, sorted(float(v) for v in values))
    got = sorted(order(r["id"], r["label"], r["values"]) for r in got)
    want = sorted(order(t[0], t[2], w.values()) for t, w in zip(texts, want, strict=True))
    for (i, label, a), (j, other, b) in zip(got, want, strict=True):
        assert (i, label, len(a)) == (j, other, len(b)) and np.allclose(a, b, rtol=1e-6)


def test_most_frequent_terms_are_kept(spark, texts):
    rows = terms.spread(spark.createDataFrame(texts, "id long, text string, label double"), "id")
    known = terms.dictionary(rows, text_col="text", most=17)
    assert sorted(r["index"] for r in known.collect()) == list(range(17))
    assert terms.dictionary(rows.limit(0), text_col="text").count() == 0
    assert terms.vectors(rows, known.limit(0), text_col="text", keep=["id"]).where("size(indices) > 0").count() == 0


def test_fit_reaches_the_optimum(fitted, texts):
    """Newton steps on dense data give the optimum of the same penalised loss; accuracy and probabilities agree."""
    known, vectors = fitted
    size, rows = known.count(), vectors.collect()
    x = np.zeros((len(rows), size + 1))
    for r, v in enumerate(rows):
        x[r, v["indices"]] = v["values"]
        x[r, -1] = 1
    y, c, w = np.array([r["label"] for r in rows]), 3.0, np.zeros(size + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + np.eye(size + 1), c * x.T @ (p - y) + w)
    exact = 1 / (1 + np.exp(-x @ w))
    fit = logistic.fit(vectors, size=size)
    scored = {(r["id"], r["label"]): r for r in fit.score(vectors, "id", "label").collect()}
    got = np.array([scored[r["id"], r["label"]]["p"] for r in rows])
    assert np.abs(got - exact).max() < 0.02 and fit.passes < 60
    assert abs(((got > 0.5) == y).mean() - ((exact > 0.5) == y).mean()) <= 0.005
    assert all((r["p"] > 0.5) == (r["prediction"] == 1.0) for r in scored.values())
    close = logistic.fit(vectors, size=size, tolerance=1e-7)
    assert np.abs(close.weights - w).max() < 1e-3
    with pytest.raises(ValueError, match="no rows"):
        logistic.fit(vectors.limit(0), size=size)


def test_document_frequency_counts_documents(spark):
    rows = spark.createDataFrame([(1, "red blue"), (1, "red green"), (2, "red"), (3, "blue"), (4, None)], "id long, text string")
    got = {r["term"]: r["df"] for r in model.document_frequency(rows, id_col="id", text_col="text").collect()}
    assert got == {"red": 2, "blue": 2}


def test_vectors_and_passes_make_no_row_a_term(spark, fitted, texts, monkeypatch):
    """Vectors come from one map over texts; packed blocks of any size hold all rows."""
    rows = terms.spread(spark.createDataFrame(texts, "id long, text string, label double"), "id")
    staged = []
    monkeypatch.setattr(terms.shared, "stage", lambda df, name: staged.append(df) or df)
    terms.vectors(rows, fitted[0], text_col="text", keep=["id", "label"])
    plan = staged[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan
    monkeypatch.setattr(logistic, "PACKED", 100)
    frames = fitted[1].select("label", "indices", "values").toArrow().combine_chunks().to_batches()
    blocks = list(logistic._blocks(logistic._packed(iter(frames))))
    assert len(blocks) > 50 and sum(len(y) for y, *_ in blocks) == len(texts)
    every = [np.concatenate(c) for c in zip(*blocks, strict=True)]
    assert every[0].tolist() == [y for f in frames for y in f.column("label").to_pylist()]
    assert every[2].tolist() == [i for f in frames for x in f.column("indices").to_pylist() for i in x]
    assert every[3].tolist() == [v for f in frames for x in f.column("values").to_pylist() for v in x]
