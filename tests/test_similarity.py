"""Sequence ratios in arrays against ``difflib``."""

import random
from difflib import SequenceMatcher

from corpuslab.operators import similarity


def test_ratios_are_those_of_difflib(monkeypatch):
    rng = random.Random(4)
    text = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    pairs = [(text(k, 90), text(k, 60)) for k in ("a", "ab", "abc", "etaoin shrdlu", "é日😀x") for _ in range(120)]
    pairs += [(x, "".join(c for c in x if rng.random() > 0.1) + text("ab ", 9)) for x, _ in pairs[::3]]
    pairs += [(x.split(" "), y.split(" ")) for x, y in pairs[360:480]] + [(None, "a"), ("a", None), ("", ""), ("", "a"), ("abc" * 900, "cab" * 800)]
    want = [None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in pairs]
    called = []
    real = similarity.SequenceMatcher
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda *a, **b: called.append(a) or real(*a, **b))
    assert similarity._ratios(pairs) == want
    assert len(called) == 1  # the long pair alone
