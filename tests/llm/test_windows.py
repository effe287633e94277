import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import table

from corpuslab.llm import kernels as K
from corpuslab.llm import substring_dedup, suffix_dedup, windows


def brute(seqs, length, keep):
    """Kept symbols of each sequence."""
    places = defaultdict(list)
    for d, s in enumerate(seqs):
        for p in range(len(s) - length + 1):
            places[s[p : p + length]].append((d, p))
    gone = [[False] * len(s) for s in seqs]
    for where in places.values():
        for d, p in where if keep == "none" and len(where) > 1 else sorted(where)[1:]:
            gone[d][p : p + length] = [True] * length
    return gone


def more_texts(hard_texts):
    rng = random.Random(11)
    base = hard_texts[6]
    return [*hard_texts, *[f"{rng.random()} {base} {rng.random()}" for _ in range(25)], "z" * 500, "xyz" * 300, "lorem " * 60 + base]


@pytest.fixture(params=[1_500_000, 200])
def gather(request, monkeypatch):
    monkeypatch.setattr(windows, "GATHER", request.param)
    monkeypatch.setattr(substring_dedup, "GATHER", request.param)


def test_word_windows(spark, hard_texts, gather):
    texts = more_texts(hard_texts)
    words = [tuple((t or "").encode().split()) for t in texts]
    for length in (20, 5, 23):
        gone = brute(words, length, "first")
        rows = substring_dedup.dedup_windows(table(spark, texts).repartition(3), length=length).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = b" ".join(w for w, g in zip(words[r.doc_id], gone[r.doc_id], strict=True) if not g)
            assert (r.n_words, r.n_removed, r.text.encode()) == (len(words[r.doc_id]), sum(gone[r.doc_id]), want)


@pytest.mark.parametrize("hot_from", [1, 3, 400])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_byte_windows(spark, hard_texts, keep, hot_from, gather):
    texts = more_texts(hard_texts)
    raw = [(t or "").encode() for t in texts]
    gone = brute(raw, 200, keep)
    rows = suffix_dedup.dedup_bytes(table(spark, texts).repartition(3), keep=keep, hot_from=hot_from).collect()
    assert len(rows) == len(texts)
    for r in rows:
        g = np.array(gone[r.doc_id], dtype=bool)
        runs = len([1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1])])
        want = bytes(b for b, x in zip(raw[r.doc_id], g, strict=True) if not x)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(g), int(g.sum()), runs, want)


def test_nothing_and_null_ids(spark):
    assert substring_dedup.dedup_windows(table(spark, [])).count() == 0
    assert suffix_dedup.dedup_bytes(table(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "w " * 50), (1, "w " * 50)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_windows(rows).collect()}
    assert got == {None: 0, 1: 49}


def test_superwindows_cover_each_window_once():
    rng = np.random.default_rng(0)
    symbols = rng.integers(1, 4, 600).astype(np.uint64)
    first = np.array([0, 0, 150, 155, 400, 600])
    s = K.SuperWindows(K.mix64(symbols), first, 12, 4)
    seen = Counter((int(r), int(q) + k) for r, q, n in zip(s.row, s.start, s.n, strict=True) for k in range(n))
    want = Counter((r, p) for r in range(5) for p in range(first[r + 1] - first[r] - 11))
    assert seen == want


def words_of(rng, n):
    return K.mix64(rng.integers(1, 6, n).astype(np.uint64))


def test_each_doubling_level_keeps_what_is_repeated_at_full_length():
    """A repeated full window contains its least short window and, on one side of it at least, a window of twice that."""
    rng = np.random.default_rng(3)
    one = words_of(rng, 400)
    symbols = np.concatenate([one, words_of(rng, 50), one[100:160], words_of(rng, 90)])
    first = np.array([0, 400, 400, len(symbols)])
    s = substring_dedup.short_windows(symbols, first, 20, 5)
    own = first[s["row"]]
    for k in range(len(own)):
        at = int(own[k] + s["at"][k])
        assert s["key"][k] == K.gram_hashes(symbols[at : at + 5], 5).view(np.int64)[0]
        if s["has_left"][k]:
            assert s["left"][k] == K.gram_hashes(symbols[at - 5 : at + 5], 10).view(np.int64)[0] >> 32
        if s["has_right"][k]:
            assert s["right"][k] == K.gram_hashes(symbols[at : at + 10], 10).view(np.int64)[0] >> 32
    full = Counter()
    places = defaultdict(list)
    for k in range(len(own)):
        for q in range(int(s["q"][k]), int(s["q"][k] + s["n"][k])):
            p = int(own[k]) + q
            text = symbols[p : p + 20].tobytes()
            full[text] += 1
            reached = [(side, int(s[side][k])) for side, yes in (("left", q <= s["at"][k] - 5), ("right", q >= s["at"][k] - 10)) if yes]
            assert reached and all(s[f"has_{side}"][k] for side, _ in reached)
            places[text].append({("key", int(s["key"][k])), *reached})
    assert sum(full.values()) == sum(max(0, n - 19) for n in np.diff(first))
    assert any(len(v) > 1 for v in places.values())
    assert all(v[0] == x for v in places.values() for x in v)  # every copy of a window is found under the same keys


def test_levels_drop_what_is_not_repeated(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "key string, x int")
    assert sorted(r.x for r in substring_dedup.surviving(rows, "key")[0].collect()) == [1, 2]


def test_runs_are_merged():
    got = substring_dedup.merged(np.array([2, 1, 1, 1, 2]), np.array([0, 30, 3, 0, 9]), np.array([1, 2, 1, 1, 1]), 5).to_pydict()
    assert got == {"doc": [1, 1, 2, 2], "s": [0, 30, 0, 9], "e": [8, 36, 5, 14]}


def naive_factors(text, starts, depth):
    def common(i, j):
        n = 0
        while n < depth and text[i + n] == text[j + n]:
            n += 1
        return n

    return [max([common(i, j) for j in starts if j < i], default=0) for i in starts]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh"])
@pytest.mark.parametrize("depth", [1, 3, 8, 20])
def test_previous_factors(alphabet, depth):
    rng = random.Random(len(alphabet) * 100 + depth)
    text = bytes(rng.choice(alphabet) for _ in range(160))
    text = text + text[30:90]
    starts = np.array([i for i in range(len(text) - depth) if i % 7 != 3])
    data = np.frombuffer(text, np.uint8)
    ranks = suffix_dedup.prefix_ranks(data, depth)
    order = np.argsort(ranks[-1][1][starts], kind="stable")
    shared = np.append(0, suffix_dedup.common_prefixes(ranks, starts[order[:-1]], starts[order[1:]]))
    got = np.zeros(len(starts), np.int64)
    got[order] = suffix_dedup.previous_factors(starts[order], shared)
    want = naive_factors(text, starts.tolist(), depth)
    assert got.tolist() == want
    for keep in ("first", "none"):
        hit = suffix_dedup.repeated_suffixes(data, starts, depth, keep)
        again = Counter(text[i : i + depth] for i in starts)
        assert hit.tolist() == [w >= depth or keep == "none" and again[text[i : i + depth]] > 1 for i, w in zip(starts.tolist(), want, strict=True)]


def test_prefix_ranks_order():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(400))
    for depth in (1, 3, 8, 20, 200):
        ranks = suffix_dedup.prefix_ranks(np.frombuffer(text, np.uint8), depth)
        assert ranks[-1][0] == depth
        for width, rank in ranks:
            places = {c: k for k, c in enumerate(sorted({text[i : i + width] for i in range(400)}))}
            assert rank.tolist() == [places[text[i : i + width]] for i in range(400)]
