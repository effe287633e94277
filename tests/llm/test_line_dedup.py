from collections import defaultdict

from conftest import table

from corpuslab.llm.line_dedup import SPACES, UPPER, dedup_lines

LOWER = str.maketrans(UPPER, UPPER.lower())


def brute(texts, least=10):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    docs = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(docs[key(x)]) > 1 and min(docs[key(x)]) != i)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_matches_brute_force_for_any_batching(spark, hard_texts):
    texts = [*hard_texts, "shared line number one\nown a", "Shared line number one  \nown b\nshared LINE number one"]
    for batches, fanout in ((1, 2), (4, 2), (3, 3)):
        out = dedup_lines(table(spark, texts), batches=batches, fanout=fanout)
        assert out.columns[:7] == table(spark, [""]).columns
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
        assert got == brute(texts)


def test_empty_and_repeated_rows(spark):
    assert dedup_lines(table(spark, [])).count() == 0
    rows = table(spark, ["a common long line\nx"]).unionAll(table(spark, ["a common long line\nx"])).unionAll(table(spark, ["a common long line\nz"], first=5))
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in dedup_lines(rows).collect())
    assert got == [(0, "a common long line\nx", 0), (0, "a common long line\nx", 0), (5, "z", 1)]
