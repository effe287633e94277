import math
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import latex
from corpuslab.functions import text as X
from corpuslab.functions import values as V
from corpuslab.operators import chunking, evaluate, sampling, similarity
from corpuslab.plans.relational import EDITS


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_words_follow_unicode_space(spark):
    r = one(spark, n=X.word_count(F.lit("a\u00a0b\u2003c\x1cd e")), none=X.word_count(F.lit(None).cast("string")))
    assert (r.n, r.none) == (5, 0)


def test_bins(spark):
    sizes = [1, 50, 51, 100, 101, 250, 251, 500, 501, 1000, 1001, 2000, 2001]
    rows = spark.createDataFrame([(s,) for s in sizes], "w int").select(evaluate.corpus_bin(F.col("w")).alias("b")).collect()
    assert [r.b for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6]


def test_unescape_and_latex(spark):
    source = r"% c" + "\n" + r"\begin{document}\section{A} x~\emph{y} $z$ \cite{q} 50\%\end{document}"
    r = one(spark, a=X.clean_inline(F.lit("a &amp;  b&nbsp;c &lt;")), b=X.latex_to_text(F.lit(source)))
    assert r.a == "a & b c <"
    assert r.b.split() == ["A", "x", "y", "50"]


def test_latex_prose():
    cases = {
        r"a % note \emph{x}" + "\nb": "a b",
        r"price 5\% and 3\$ \& more": "price 5 and 3 & more",
        r"pre \begin{document}\section*{One}\label{s}text\end{document} post": "One text",
        r"x \begin{table}\begin{table}u\end{table}v\end{table} y": "x y",
        r"x \begin{itemize}\item[a] one\end{itemize} y": "x one y",
        r"$$a$$ b \(c\) d \[e\] f $g$ h": "b d f h",
        r"see \citep[p.~3]{k,l}\ref{a} \href{u}{shown} on": "see shown on",
        r"\textbf{deep \emph{er \foo{in}}} out": "deep er in out",
        r"open {brace \unknown": "open brace",
        r"lone $ sign } and \\ so": "lone sign and so",
        "": "",
    }
    assert {k: " ".join(latex.prose(k).split()) for k in cases} == cases


def test_book_body(spark):
    start, end = "*** START OF THE PROJECT GUTENBERG EBOOK A ***", "*** END OF THE PROJECT GUTENBERG EBOOK A ***"
    body = lambda t: one(spark, a=X.between_markers(F.lit(t))).a
    assert body(f"{start}\n a &amp;  b\n{end}") == "a & b"
    assert body(f"{start}\nno end") is None and body(f"{end}\n{start}\nx") is None and body("x") is None
    assert body(f"{start}\nBook one\nPart 2\nBOOK ONE\n\ntext\n{end}") == "BOOK ONE\n\ntext"


def test_rejected_edits_need_no_ratio(spark):
    rows = spark.createDataFrame([("a b c d", "a b c", "light"), ("a b", "a b", "light"), ("a b c d e f g h i j", "a b c d e f g h i k", "light")], "o string, e string, l string")
    got = [r[0] for r in rows.select(similarity.validate_edit(F.col("o"), F.col("e"), F.col("l"))).collect()]
    assert got == ["has 3 words; expected 3 to 5", "is unchanged", ""] or got[1:] == ["is unchanged", ""]


def test_chunks_clean_each_text_once(spark):
    docs = spark.createDataFrame([(1, "a &amp; b " * 60)], "doc_id long, text string")
    out = chunking.chunk_documents(docs, id_col="doc_id", text_col="text", key=F.col("doc_id").cast("string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_trim_keeps_spacing(spark):
    text = " ".join(" ".join(["go"] * 26 + ["stop!"]) for _ in range(5))
    r = one(spark, a=X.trim_overlong(F.lit(text), F.lit(100), 0.2), b=X.trim_overlong(F.lit("a  b\nc."), F.lit(100), 0.2))
    assert len(r.a.split()) == 108 and r.a.endswith("!") and r.b == "a  b\nc."


def test_layouts(spark):
    rows = spark.createDataFrame([([5, 6],), ([7],)], "ids array<int>")
    row = lambda fixed, width: [r[0] for r in rows.select(V.causal_row(F.col("ids"), F.lit(width), 0, 2, fixed)).collect()]
    mask = [r[0] for r in rows.select(V.causal_mask(F.col("ids"), F.lit(6), True)).collect()]
    assert row(False, 3) == [[5, 6, 2], [7, 2, 0]]
    assert row(True, 6) == [[5, 6, 0, 0, 0, 2], [7, 0, 0, 0, 0, 2]]
    assert mask == [[1, 1, 0, 0, 0, 1], [1, 0, 0, 0, 0, 1]]


def test_rewards(spark):
    rows = spark.createDataFrame([(0, 100), (50, 100), (100, 100), (200, 100)], "w int, t int")
    assert [r[0] for r in rows.select(V.length_adherence(F.col("w"), F.col("t"))).collect()] == [0.0, 0.5, 1.0, 0.5]
    assert one(spark, a=V.token_limit(F.lit(50), 4096), b=V.token_limit(F.lit(1000), 4096), c=V.token_limit(F.lit(1000), 512))[:] == (96, 1616, 512)


def test_similarity_is_the_larger_of_both_ratios(spark):
    rows = spark.createDataFrame(EDITS, "id int, original string, edited string, level string")
    got = {r.id: (r.s, r.v) for r in rows.select("id", similarity.similarity(F.col("original"), F.col("edited")).alias("s"), similarity.validate_edit(F.col("original"), F.col("edited"), F.col("level")).alias("v")).collect()}
    import re

    for i, a, b, _ in EDITS:
        x, y = (re.findall(r"\b\w+(?:['’-]\w+)*\b", t.lower()) for t in (a, b))
        want = 0.0 if not x or not y else max(SequenceMatcher(None, x, y, autojunk=False).ratio(), 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)))
        assert got[i][0] == pytest.approx(want)
    assert [got[i][1] for i in range(1, 7)] == ["", "is unchanged", "rewrites too much for light editing", "changes too little for moderate editing", "is empty", "mentions the generation process"]


def test_agreement_with_a_tie(spark):
    rows = spark.createDataFrame([(1, 1, 0, 55), (1, 1, 1, 75)], "id int, label int, prediction int, score int")
    r = evaluate.agreement(rows, 70).first()
    assert (r.classifications, r.unanimous, r.majority_accuracy, r.fn) == (2, 0.0, 0.0, 1)


def test_nested_order_prefixes(spark):
    counts = Counter({"0::a": 45, "0::b": 15, "1::a": 30, "1::b": 10})
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(counts.elements())], "id long, s string")
    order = [r.s for r in sampling.nested_order(rows, stratum="s", id_col="id", seed=1).orderBy("position").collect()]
    assert len(order) == 100
    for n in range(1, 100):
        seen = Counter(order[:n])
        assert all(abs(seen[s] - counts[s] * n / 100) <= 1 for s in counts)
    assert sampling.subset_sizes(40559, (0.01, 0.025, 1.0)) == [406, 1014, 40559]


@pytest.mark.parametrize("counts", [(7, 3), (5, 5), (1, 9), (12, 8)])
def test_nested_order_of_two_takes_the_one_furthest_behind(spark, counts):
    left = dict(zip("ab", counts, strict=True))
    want, taken, total = [], Counter(), sum(counts)
    for step in range(total):
        want.append(max((s for s in left if taken[s] < left[s]), key=lambda s: (left[s] * (step + 1) - taken[s] * total, s)))
        taken[want[-1]] += 1
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(Counter(left).elements())], "id long, s string")
    assert [r.s for r in sampling.nested_order(rows, stratum="s", id_col="id", seed=1).orderBy("position").collect()] == want


def test_quota_selection(spark):
    rows = spark.createDataFrame([(i, "blog" if i < 12 else "arxiv") for i in range(1, 21)], "id long, c string")
    got = {r.c: r.quota for r in sampling.quotas(rows, stratum="c", count=10).collect()}
    assert sum(got.values()) == 10 and got["blog"] == 6 - (11 * 10 % 20 < 9 * 10 % 20)


def test_claims_are_disjoint(spark):
    free = spark.range(1, 11).withColumnRenamed("id", "doc")
    jobs = [(f"j{i}", 2) for i in range(5)]
    rows = sampling.claims(free, id_col="doc", jobs=jobs, seed=17).collect()
    assert sorted(r.doc for r in rows) == list(range(1, 11)) and Counter(r.job for r in rows) == {f"j{i}": 2 for i in range(5)}


def test_latency(spark):
    r = evaluate.latency(spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, s double"), ["k"], "s", F.lit(100)).first()
    assert (r.mean_seconds, r.ms_per_text, r.texts_per_second, r.std_seconds) == (2.0, 20.0, 50.0, 0.0)
    assert not math.isnan(r.texts_over_mean_time)
