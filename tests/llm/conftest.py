import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, pos int"


def table(spark, texts, sources=None, first=0):
    """A documents table with two extra columns whose names clash with inner ones."""
    rows = [(first + i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def hard_texts():
    """Null, empty, blank, copies, near copies, shared passages, long and odd texts."""
    rng = random.Random(7)
    vocab = [f"wörd{i}" if i % 9 == 0 else f"w{i}" for i in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocab) + ("\n" if rng.random() < 0.06 else "") for _ in range(n))

    passage, long = prose(70), prose(4000)
    texts = [None, "", "   ", "\n\n\n", "a", "one two three", passage, passage, "x " + passage + " y", prose(30) + " " + passage]
    base = prose(200).split(" ")
    for i in range(12):
        copy = list(base)
        copy[(i * 13) % 200] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += [long, long[500:], "same " * 400, "ab" * 600, "Tab\tand\x0bvt\r\nThis Line Repeats\n  this line repeats\t\n", "THIS LINE REPEATS\nother", None]
    texts += [prose(rng.randrange(1, 120)) for _ in range(20)]
    return texts
