from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from corpuslab.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def test_stages_follow_from_what_the_one_before_kept(spark, steps):
    raw, good, lines, single, mixed, packed = steps
    assert all(s.columns == COLUMNS for s in steps[:-1])
    rules = quality.fit(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(raw, rules).collect() if r["__kept"]}
    assert {r.doc_id for r in good.collect()} == kept and 0 < len(kept) < raw.count()

    from test_line_dedup import brute as lines_brute
    from test_mixing import brute_targets
    from test_ngram_join import brute as groups_brute

    given = sorted(good.collect())
    want = lines_brute([r.text for r in given])
    got = sorted(lines.collect())
    assert [(r.doc_id, r.text, r.n_chars) for r in got] == [(r.doc_id, want[i][0], len(want[i][0])) for i, r in enumerate(given)]
    groups = groups_brute([r.text for r in got], 5, 80, 100)
    assert {r.doc_id for r in single.collect()} == {r.doc_id for i, r in enumerate(got) if groups[i][1] == i}
    rows = single.collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += len(r.text.split())
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3
    for r in rows:
        taken[r.source] += copies[r.doc_id] * len(r.text.split())
    goal, longest = brute_targets(sizes), max(len(r.text.split()) for r in rows)
    assert all(abs(taken[s] - goal[s]) <= longest for s in sizes)
    pieces = packed.collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == copies
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_run_is_the_stages_in_order(spark, steps):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == steps[-1].columns and out.count() == steps[-1].count()
