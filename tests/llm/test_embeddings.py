import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import components as stars
from corpuslab.llm import embedding_dedup
from corpuslab.llm.components import components


def brute(ids, vectors, least=0.95):
    good = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)]  # scaled first: no overflow
    m = np.array([vectors[i] for i in good], np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= least
    links, comp = dict.fromkeys(ids, 0), {i: i for i in ids}
    for k, i in enumerate(good):
        links[ids[i]] = int(near[k].sum()) - 1
    label = [ids[i] for i in good]
    while True:
        new = [min(label[b] for b in np.flatnonzero(near[a])) for a in range(len(good))]
        if new == label:
            break
        label = new
    comp.update({ids[i]: c for i, c in zip(good, label, strict=True)})
    return links, comp


def planted(n=1500, d=48, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n, d))
    rows = [c for c in centres]
    for k in range(300):
        rows.append(centres[k] + rng.standard_normal(d) * rng.uniform(0.05, 0.33))
    rows += [centres[0]] * 40 + [centres[1] * 3.5] * 5
    rows += [centres[2] + rng.standard_normal(d) * 0.02 for _ in range(200)]
    return [list(map(float, v)) for v in rows]


@pytest.mark.parametrize("block", [768, 16])
def test_links_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    vectors = [*planted(), None, [], [0.0] * 48, [None] + [1.0] * 47, [float("nan")] + [1.0] * 47, [float("inf")] + [1.0] * 47, [1.0, 2.0], [5e-324] + [0.0] * 47, [1e308] * 48]
    ids = list(range(10, 10 + len(vectors)))
    frame = spark.createDataFrame(list(zip(ids, vectors, ids, strict=True)), "vec_id long, embedding array<double>, unit long")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    links, comp = brute(ids, [v if v and len(v) == 48 else None for v in vectors])
    assert set(got) == set(ids)
    assert all(got[i].n_links <= links[i] for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    assert np.mean([got[i].component_id == comp[i] for i in ids]) >= 0.99
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = embedding_dedup.near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(stars, "ONE_TASK", one_task)
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 900)]
    pairs = [*chain, *star, (7, 7), (3, 2), *map(tuple, rng.integers(1000, 1400, (250, 2)).tolist())]
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "u long, v long").repartition(7)
    got = {r.node: r.component for r in components(frame).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if x != 7}
    assert components(frame.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("width", [12, 16, 19, 20])
def test_recall_at_the_widths_of_large_tables(width):
    rng = np.random.default_rng(3)
    a, away = embedding_dedup._units(rng.standard_normal((4000, 64))), rng.standard_normal((4000, 64))
    away = embedding_dedup._units(away - (a * away).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * away
    q = embedding_dedup.learn(a, embedding_dedup.tables_for(width, 0.95, 16), width)
    assert (q.substrings(a) == q.substrings(b)).any(axis=1).mean() >= 0.98


def test_tables_follow_the_width(spark, monkeypatch):
    seen, learn = [], embedding_dedup.learn
    monkeypatch.setattr(embedding_dedup, "learn", lambda unit, tables, width: seen.append((tables, width)) or learn(unit, tables, width))
    monkeypatch.setattr(embedding_dedup, "log2", lambda n: 18.0)
    vectors = planted(300)
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert embedding_dedup.near_vectors(rows).count() == len(vectors)
    assert seen == [(27, 16)]


@pytest.mark.parametrize("block", [768, 16])
def test_cosines_closer_than_the_rounding_are_settled_in_double_precision(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(8)
    a = embedding_dedup._units(rng.standard_normal((600, 48)))
    away = rng.standard_normal((600, 48))
    away = embedding_dedup._units(away - (a * away).sum(axis=1, keepdims=True) * a)
    shift = np.array([-1e-6, 1e-6, -2e-5, 2e-5, -1e-9, 1e-9])[np.arange(600) % 6]
    c = (0.95 + shift)[:, None]
    b = c * a + np.sqrt(1 - c * c) * away
    # Near copies of one vector make buckets larger than a small group.
    near = [a[0] + rng.standard_normal(48) * 1e-3 for _ in range(70)]
    vectors = [list(map(float, v)) for v in [*a, *b, *near, a[1], a[1]]]
    ids = list(range(len(vectors)))
    frame = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame, tables=40).collect()}
    links, comp = brute(ids, vectors)
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == comp


def test_rounding_stays_within_its_margin():
    rng = np.random.default_rng(4)
    for d in (2, 64, 768):
        x, y = embedding_dedup._units(rng.standard_normal((500, d))), embedding_dedup._units(rng.standard_normal((500, d)))
        rounded = [np.rint(v * embedding_dedup.ROUND) / embedding_dedup.ROUND for v in (x, y)]
        assert np.abs(x @ y.T - rounded[0] @ rounded[1].T).max() <= embedding_dedup._margin(d)


def test_a_third_of_all_rows_in_one_group_of_near_copies(spark):
    rng = np.random.default_rng(12)
    rest = rng.standard_normal((2000, 48))
    group = rest[0] + rng.standard_normal((1000, 48)) * 0.1 * np.linalg.norm(rest[0]) / 48**0.5
    vectors = [list(map(float, v)) for v in [*rest, *group]]
    ids = list(range(len(vectors)))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")).collect()}
    links, comp = brute(ids, vectors)
    assert sum(links.values()) > 900_000
    assert all(got[i].n_links <= links[i] for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    assert {i: r.component_id for i, r in got.items()} == comp


def test_leaders():
    rng = np.random.default_rng(3)
    x = embedding_dedup._units(rng.standard_normal((700, 16)))
    x = np.concatenate([x, x[:300], embedding_dedup._units(x[:400] + rng.standard_normal((400, 16)) * 0.02)])
    kept = []
    for v in x:
        if not any(v @ k >= 0.95 for k in kept):
            kept.append(v)
    assert np.array_equal(embedding_dedup.leaders(x, 0.95), np.array(kept))
    assert len(embedding_dedup.leaders(x[:1], 0.95)) == 1
