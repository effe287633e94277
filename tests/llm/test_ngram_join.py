import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import table

from corpuslab.llm import ngram_join
from corpuslab.llm import kernels as K
from corpuslab.llm.kernels import U64

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(UP))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(hard_texts):
    rng = random.Random(21)
    texts = list(hard_texts)
    for _ in range(12):
        words = [f"v{rng.randrange(900)}" for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return [*texts, "Same Words", "same words", "same", "SAME\n", "é É"]


@pytest.mark.parametrize(("k", "num", "den", "block"), [(4, 85, 100, 256), (5, 80, 100, 3), (2, 1, 2, 256)])
def test_components_match_brute_force(spark, hard_texts, k, num, den, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_texts(hard_texts)
    rows = ngram_join.similarity_groups(table(spark, texts).repartition(3), k=k, at_least=(num, den)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == brute(texts, k, num, den)


def test_nothing(spark):
    assert ngram_join.similarity_groups(table(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.similarity_groups(rows).collect()), key=str)
    assert got == [(3, 2, 3), (4, 0, 4), (None, 0, None)]


def test_trie_finds_what_sets_give():
    rng = np.random.default_rng(9)
    for num, den in ((85, 100), (1, 2)):
        limit = ngram_join.Threshold(num, den)
        lead = np.unique(rng.integers(0, 400, 150).astype(U64))
        others = []
        for _ in range(300):
            y = lead[rng.random(len(lead)) < rng.uniform(0.4, 1)]
            others.append(np.unique(np.append(y, rng.integers(0, 400, rng.integers(0, 60)).astype(U64))))
        got = ngram_join.trie_links(lead, [y.astype(">u8").tobytes() for y in others], limit)
        want = [k for k, y in enumerate(others) if den * len(np.intersect1d(lead, y)) >= num * len(np.union1d(lead, y))]
        assert sorted(got) == want


def test_a_leader_with_many_salts_goes_out_in_small_batches(spark):
    """A text of 20,000 words that 1,500 salts ask for: no batch holds more than the bound and one set."""

    class Sketch:
        value = np.zeros(1 << ngram_join.SKETCH, np.uint32)

    text = " ".join(f"w{i}" for i in range(20_000))
    data, offsets = K.text_buffers(pa.array([text]))
    h, first = ngram_join.sets(data, offsets, 0, 1, 4)
    sid = int(ngram_join.set_ids(h, first)[0])
    asked = [{"group": 1, "salt": s, "lead": True, "sid": sid} for s in range(1500)]
    frame = pa.RecordBatch.from_pydict({"doc": [1], "text": [text], "asked": [asked]})
    salts, most = [], 0
    for out in ngram_join._sequences(4, Sketch)(iter([frame])):
        salts += out.column("salt").to_pylist()
        most = max(most, out.nbytes)
    assert sorted(salts) == list(range(1500)) and most < ngram_join.SET_BYTES + 2 * 8 * 20_000
