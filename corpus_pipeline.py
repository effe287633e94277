"""The corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
works on all rows that its predecessor kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import columns, line_dedup, mixing, ngram_join, packing, quality, scratch

#: The rules are learned, so SQL cannot express the first stage.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go.

    A null, empty or blank text has no words and goes. Rows are judged one by
    one: repeated rows, equal texts and rows with a null id share their text's
    verdict. An empty table gives an empty table; extra columns pass through.
    """
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, rules)
    return judged.where(columns.col(judged.columns[-1])).select(*columns.cols(docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; ``n_chars`` follows the text.

    Every row stays. A null text becomes the empty string; a row with a null id
    neither loses lines nor makes others lose any. Rows that repeat an id count
    as one document. An empty table gives an empty table; extra columns pass
    through.
    """
    out = line_dedup.dedup_lines(docs).select(*columns.cols(docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the smallest id stays.

    Rows with a null id and null, empty or blank texts link with nothing and
    stay. Rows that repeat an id go together: they stay unless one of them is
    linked to a smaller id. An empty table gives an empty table; extra columns
    pass through.
    """
    groups = ngram_join.similarity_groups(docs)
    (lost_id,) = columns.fresh(docs, "lost_id")
    lost = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(lost_id)).distinct()
    return docs.join(lost, columns.col("doc_id") == F.col(lost_id), "left_anti").select(*columns.cols(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times.

    A null source is a source of its own, a null or empty text has size 0. Rows
    with a null id share a hash, as do rows that repeat an id; rows of one id
    are all taken as often as the one of them that is taken most. An empty
    table gives an empty table; extra columns pass through.
    """
    key, times, number = columns.fresh(docs, "taken_id", "times", "number")
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    out = docs.join(taken, columns.col("doc_id").eqNullSafe(F.col(key)))
    out = out.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return out.select(*columns.cols(docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, one row a piece.

    Every row is a document of its own, repeated rows too; a null or empty text
    is the end id alone. Null ids stay null. An empty table gives an empty
    table; extra columns are not read.
    """
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
