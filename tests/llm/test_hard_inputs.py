"""Clashing column names, nulls, empty tables, repeated rows and very long texts, for all ten operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm import columns, embedding_dedup, line_dedup, mixing, ngram_join, packing, quality, scratch, secrets, substring_dedup, suffix_dedup, token_files

#: Names that operators might use inside, or that a SQL name could trip over.
CLASHING = (
    "__id __row __lines __spans __r __counts __base_failed __kept __src __copies __copy id row key gone lines spans result doc text_ drop pos owner "
    "size h copies start end kind m q n a sid rep k1 part block source_size target doc_key component n_shingles old last with.dot"
).split() + ["with space"]


def clashing(spark, texts):
    """doc_id, text, source and a column of each clashing name with the value name:doc_id."""
    base = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return base.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def few():
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    return [passage, passage + " more words\nthe same long line here", None, "", "the same long line here\n" + passage[:300], "x", passage]


def written(spark, docs):
    at = scratch.path(spark, "t")
    token_files.write(docs, at)
    return token_files.documents(spark, at)


def near(docs):
    vectors = docs.withColumn("text", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i * (1 + F.coalesce(F.length("text"), F.lit(0)))) % 7 + 0.5))
    return embedding_dedup.near_vectors(vectors, id_col="doc_id", vector_col="text")


PASSING = {
    "op1": line_dedup.dedup_lines,
    "op4": lambda d: suffix_dedup.dedup_bytes(d, keep="none"),
    "op5": lambda d: quality.judge(d, quality.DecisionList()),
    "op9": substring_dedup.dedup_windows,
}
OTHERS = {
    "op2": packing.pack,
    "op3": near,
    "op6": ngram_join.similarity_groups,
    "op7": secrets.scan,
    "op8": mixing.mix,
    "op10": lambda d: written(d.sparkSession, d),
}


@pytest.mark.parametrize("name", [*PASSING, *OTHERS])
def test_columns_of_the_caller(spark, few, name):
    """Operators that return their input's columns return their values; the others give what they give without them."""
    docs = clashing(spark, few)
    if name in PASSING:
        rows = PASSING[name](docs).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(few)))
        for r in rows:
            assert [r[c] for c in CLASHING] == [f"{c}:{r['doc_id']}" for c in CLASHING]
            assert r["source"] == f"s{r['doc_id'] % 2}"
        plain = [c for c in rows[0].__fields__ if c not in CLASHING and not c.startswith("__")]
        alone = PASSING[name](docs.select("doc_id", "text", "source")).select(*plain).collect()
        assert sorted(str(r.asDict()) for r in alone) == sorted(str({c: r[c] for c in plain}) for r in rows)
    else:
        got, alone = OTHERS[name](docs), OTHERS[name](docs.select("doc_id", "text", "source"))
        assert got.columns == alone.columns
        drop = [c for c in ("sequence_id", "offset", "k") if c in got.columns]
        assert sorted(map(str, got.drop(*drop).collect())) == sorted(map(str, alone.drop(*drop).collect()))


@pytest.mark.parametrize("name", [*PASSING, *OTHERS])
def test_empty_table_and_repeated_rows(spark, few, name):
    run = {**PASSING, **OTHERS}[name]
    docs = clashing(spark, few).select("doc_id", "text", "source")
    assert run(docs.limit(0)).count() == 0
    twice = run(docs.unionAll(docs))
    ids = [r["doc_id"] for r in twice.select("doc_id").collect()]
    assert set(ids) == set(range(len(few))) and all(ids.count(i) >= 2 for i in ids)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages(spark, few, stage):
    """Null ids and texts, repeated rows, no rows, and extra columns that clash."""
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = clashing(spark, few).withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit(None).cast("string"))
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string"))
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(odd)
    sf = "/root/testdata/sf0.001"
    out, none = run(spark, docs, sf), run(spark, docs.limit(0), sf)
    assert none.count() == 0
    rows = out.collect()
    if stage == "packing":
        assert sum(r["start"] == 0 for r in rows) == docs.count()
        return
    assert out.columns == docs.columns == none.columns
    given = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for r in rows:
        assert r["doc_id"] in given
        if r["doc_id"] is not None:
            assert [r[c] for c in CLASHING] == [f"{c}:{r['doc_id']}" for c in CLASHING]
    if stage == "line_dedup":
        assert len(rows) == docs.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    if stage == "ngram_join":  # null, empty and short texts and the null id stay, and of the copies the first
        kept = [r["doc_id"] for r in rows]
        assert {0, 2, 3, 5, None} <= set(kept) and 6 not in kept and kept.count(0) == 2


def test_a_text_with_very_many_matches(spark):
    """Time follows the number of matches, not its square."""
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(18)) for _ in range(100_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, "deadbeefdeadbeef", "s")], "doc_id long, text string, source string")
    secrets.scan(docs.where("doc_id = 2")).collect()
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert time.time() - began < 30
    assert got[1]["n_hex"] == 100_000 and got[1]["spans"].startswith("hex:0:18,hex:19:37,") and got[2]["n_hex"] == 1


def test_long_tokens_are_spans_too(spark):
    value = "Aa1" * 100
    docs = spark.createDataFrame([(1, f"x {value} y", "s")], "doc_id long, text string, source string")
    assert secrets.scan(docs).first()["spans"] == f"token:2:{2 + len(value)}"


def test_fresh_names():
    class Frame:
        columns = ["A", "a_", "b"]

    assert columns.fresh(Frame, "a", "b", "c", "c") == ["a__", "b_", "c", "c_"]
    assert columns.without(["A", "b", "C"], "a", "c") == ["b"]
