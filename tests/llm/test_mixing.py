from collections import defaultdict

import pytest
from conftest import table

from corpuslab.llm.mixing import mix


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        add = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += add[s]
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_takes(spark):
    texts = ["w " * (5 + i % 37) for i in range(400)] + [None, "", "one"]
    sources = ["a" if i % 2 else f"src{i % 7}" for i in range(400)] + [None, None, "tiny"]
    rows = mix(table(spark, texts, sources)).collect()
    assert len(rows) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), texts, strict=True):
        assert r.size == len((t or "").split())
        sizes[sources[r.doc_id]] += r.size
        taken[sources[r.doc_id]] += r.taken
        assert r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[sources[r.doc_id]])
        assert r.source_size == sizes[sources[r.doc_id]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 42
    again = mix(table(spark, texts, sources).repartition(3)).collect()
    assert sorted(again) == sorted(rows)


def test_empty(spark):
    assert mix(table(spark, [])).count() == 0
    assert [r.taken for r in mix(table(spark, [None, ""])).collect()] == [0, 0]
