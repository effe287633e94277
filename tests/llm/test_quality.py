import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import table
from pyspark.sql import functions as F

from corpuslab.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_match_brute_force(spark, hard_texts):
    texts = [*hard_texts, "# x | y\n# x | y\n<b>&é#</b>", "ü ü ü ü", "a b c a b c"]
    rows = quality.judge(table(spark, texts), quality.DecisionList()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert tuple(r["__counts"][c] for c in quality.COUNTS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["__base_failed"] == failed and r["__kept"] == (not failed)


def test_learned_list_separates_planted_junk(spark):
    rng = np.random.default_rng(3)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(80))
    texts, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        t = good()
        texts.append(t.upper().replace(" ", "!! ") if bad and i % 2 else t.replace(" ", " *** ") if bad else t)
        labels.append((i, 0 if bad else 1))
    labels += [(None, 0), (7, None), (9999, 0)]
    docs, marks = table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality.fit(docs, marks)
    assert rules.rules
    got = {r.doc_id: r["__kept"] for r in quality.judge(docs, rules).collect()}
    assert all(got[i] == (i % 5 != 0) for i in range(300))
    assert quality.fit(docs, marks.where("quality = 1")).rules == ()
    assert quality.fit(docs, marks.limit(0)).rules == ()
    assert quality.judge(table(spark, []), rules).count() == 0


def test_verdict_column_equals_numpy(spark):
    rules = quality.DecisionList(((quality.Condition("upper_share", True, 0.5),), (quality.Condition("mark_share", True, 0.3), quality.Condition("chars_per_word", False, 9.0))))
    texts = ["ABC DEF", "a,b,c, d!!", "plain words", "", None, "x" * 50 + "!" * 40]
    rows = table(spark, texts).withColumn("c", quality.counts(F.col("text"))).withColumn("keep", rules.verdict(F.col("c"))).orderBy("doc_id").collect()
    got = np.array([not r["keep"] for r in rows])
    counts = {c: np.array([r["c"][c] for r in rows]) for c in (*quality.COUNTS, *quality.MORE)}
    assert (got == rules.rejects(quality.features(counts))).all()


def test_fit_counts_a_labelled_text_once(spark, monkeypatch):
    """Two evaluations in a task hold two Python workers a core, which then stay for all that follows."""
    met = spark.sparkContext.accumulator(0)

    @F.arrow_udf(quality.COUNTS_TYPE)
    def counted(text: pa.Array) -> pa.Array:
        met.add(len(text))
        got = quality.text_counts(text)
        return pa.StructArray.from_arrays([pa.array(v) for v in got.values()], names=list(got))

    monkeypatch.setattr(quality, "counts", lambda text: counted(text))
    docs = table(spark, [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)])
    labels = spark.range(30).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(2)).cast("int").alias("quality"))
    quality.fit(docs, labels)
    assert met.value == 30
