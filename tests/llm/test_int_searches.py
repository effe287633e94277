"""Hard negatives, top-k search and centroid clustering against brute force in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import centroid_clusters, hard_negatives, int_vectors, top_k

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, id string, vec string, norm string, shard string, `with.dot` string, score string"


def rows(n=420, d=8, seed=3, null_id=True):
    """(id, vector, label): clusters, a third equal, ties, repeated rows, and everything that takes no part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    out = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else centres[i % 6] + rng.standard_normal(d) * (0.02 if i % 5 else 0.6)
        out.append((i, [float(x) for x in np.round(v, 3)], None if i % 41 == 7 else int(i % 4)))
    out += [out[10], out[100], (100, [float(x) for x in -centres[1]], 1)]  # repeated rows; an id with two vectors
    odd = [None, [], [1.0], [None] + [1.0] * (d - 1), [NAN] * d, [INF] + [0.0] * (d - 1), [0.0] * d, [1.0] * (d + 1)]
    out += [(10_000 + 100 * i, v, 1) for i, v in enumerate(odd)]
    return out + ([(None, [0.5] * d, 2)] if null_id else [])


def frame(spark, data):
    return spark.createDataFrame([(i, v, l, *["x"] * 6) for i, v, l in data], SCHEMA)


def whole(data, d, scale):
    return [(i, [math.floor(scale * x) for x in v], l) for i, v, l in data if v and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def best(scored, k):
    return sorted(scored, key=lambda x: (-x[0], x[1]))[:k]


def brute_top(data, d, k=10, scale=1024):
    kept = [r for r in whole(data, d, scale) if r[0] is not None]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v, _ in kept if i % 100 == 0}):
        found = best([(dot(q, v), j) for j, v, _ in kept if j != i], k)
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def brute_negatives(data, d, scale=256):
    kept = [r for r in whole(data, d, scale) if r[0] is not None and r[2] is not None]
    out = []
    for i, a, label in sorted({(i, tuple(v), l) for i, v, l in kept if i % 100 == 0}):
        scored = [(dot(a, v), j, l) for j, v, l in kept if j != i]
        for p, pid in best([(s, j) for s, j, l in scored if l == label], 5):
            fits = best([(s, j) for s, j, l in scored if l != label and 30 * p <= 100 * s <= 90 * p], 10)
            out += [(i, pid, r + 1, j, p, s) for r, (s, j) in enumerate(fits)]
    return sorted(out)


def brute_clusters(data, d, k, rounds, scale=64):
    kept = [(i, v) for i, v, _ in whole(data, d, scale)]
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    pack = lambda v: np.array(v, "<i4").tobytes()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[0] if r[0] is not None else -1, pack(r[1])))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((gap(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, n) in zip(kept, found, strict=True) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    total = sum(g for g, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, g, sum(h for h, m in found if m == n), total, digest[n]) for (i, _), (g, n) in zip(kept, found, strict=True)), key=str)


@pytest.mark.parametrize("shard, group", [(8192, 4096), (50, 2)])
def test_top_k(spark, monkeypatch, shard, group):
    monkeypatch.setattr(int_vectors, "GROUP", group)
    monkeypatch.setattr(top_k, "SAMPLE", 30 if shard == 50 else 4096)
    data = rows()
    got = top_k.search(frame(spark, data), queries=F.expr("vec_id % 100 = 0"), shard=shard)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(data, 8)


@pytest.mark.parametrize("shard, group", [(16384, 4096), (50, 2)])
def test_hard_negatives(spark, monkeypatch, shard, group):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 40 if shard == 50 else 4096)
    monkeypatch.setattr(int_vectors, "GROUP", group)
    data = rows()
    want = brute_negatives(data, 8)
    got = hard_negatives.mine(frame(spark, data), anchors=F.expr("vec_id % 100 = 0"), shard=shard)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # Rows that repeat give equal positives, which stand for themselves each.
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want


def test_clusters(spark):
    data = rows(d=8)
    got = centroid_clusters.cluster(frame(spark, data), dim=8, k=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(data, 8, 5, 3)
    few = [r for r in data if r[0] is not None and r[0] < 3]
    assert sorted((tuple(r) for r in centroid_clusters.cluster(frame(spark, few), dim=8).collect()), key=str) == brute_clusters(few, 8, 16, 3)


def test_nothing_and_few(spark):
    for data in ([], [(100, None, 1), (200, [], 2)], [(100, [1.0] * 64, 1)]):
        docs, anchors = frame(spark, data), F.expr("vec_id % 100 = 0")
        assert top_k.search(docs, queries=anchors).count() == 0
        assert hard_negatives.mine(docs, anchors=anchors).count() == 0
        assert centroid_clusters.cluster(docs).count() == sum(bool(v) for _, v, _ in data)


def test_a_component_too_large_raises(spark):
    with pytest.raises(Exception, match="scale the vectors down"):
        top_k.search(frame(spark, [(1, [1e30] * 4, 1)]), queries=F.lit(True)).collect()


def test_screen_settles_what_single_precision_cannot():
    """Distances that differ by one among products of 2**50: the screen leaves them open, integers decide, ties go to the smaller number."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 26), 1 << 26, 64)
    centroids = np.array([base + 1, base, base, base - 1] + [rng.integers(-(1 << 26), 1 << 26, 64) for _ in range(12)])
    x = np.concatenate([base + rng.integers(-1, 2, (300, 64)), rng.integers(-(1 << 26), 1 << 26, (300, 64))])
    number, distance, again = centroid_clusters.nearest(x, centroids)
    for v, n, g in zip(x.tolist(), number, distance, strict=True):
        assert (g, n) == min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids.tolist()))
    assert 300 <= again < 400 and 2 not in number  # the far ones are settled by the screen, but for a few


def test_bounds_discard_and_never_lose():
    """On vectors with strong leading components most pairs go before the last slice; every pair above the bound survives."""
    rng = np.random.default_rng(2)
    spread = 4000.0 * 0.8 ** np.arange(32)
    turn = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    x = np.floor(rng.standard_normal((3000, 32)) * spread @ turn).astype(np.int64)
    rotation = hard_negatives.Rotation(x)
    a = x[:40]
    score = a @ x.T
    least = np.sort(score, axis=1)[:, -10].astype(float)
    most = np.full(40, np.inf)
    i, j = hard_negatives.survivors(rotation, (a, *rotation.turned(a)), (x, *rotation.turned(x)), np.ones(score.shape, bool), least, most)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*(w.tolist() for w in np.nonzero(score >= least[:, None])), strict=True)}
    rotation.cuts = [8]  # a quarter of the components alone discards most pairs
    i, j = hard_negatives.survivors(rotation, (a, *rotation.turned(a)), (x, *rotation.turned(x)), np.ones(score.shape, bool), least, most)
    assert len(i) < 0.2 * score.size and (score[i, j] >= least[i]).sum() == (score >= least[:, None]).sum()


def test_tree_passes_over_entries():
    """On clustered rows best-first search computes few of a tree's entries, and finds what brute force finds."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 1000
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.standard_normal((4000, 16)) * 30).astype(np.int64)
    space = top_k.Space(16, int((x * x).sum(axis=1).max()))
    pivot = space.points(x[:1])[0]
    import pyarrow as pa

    pages = list(top_k.tree(space, 0, np.arange(4000), x, pivot))
    leaves = [p for p in pages if p[2]]
    assert sorted(np.concatenate([np.frombuffer(p[3], np.int64) for p in leaves])) == list(range(4000))
    t = top_k.Tree(space, pa.table(list(map(list, zip(*pages, strict=True))), schema=top_k.PAGE))
    total = 0
    for own in range(0, 4000, 100):
        far = float(top_k.between(pivot[None, :], np.append(x[own].astype(float), 0.0))[0])
        score, ids, computed = t.search(x[own], own, far, 10, int_vectors.NONE)
        want = best([(int(s), j) for j, s in enumerate(x @ x[own]) if j != own], 10)
        assert list(zip(score.tolist(), ids.tolist(), strict=True)) == want
        total += computed
    assert total < 0.5 * 40 * 4000
