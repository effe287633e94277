"""Contract queries opN_<name>: thin projections over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import (
    centroid_clusters,
    embedding_dedup,
    hard_negatives,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    quality,
    scratch,
    secrets,
    substring_dedup,
    suffix_dedup,
    token_files,
    top_k,
)
from corpuslab.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep="none")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality.judge(docs, rules)
    return out.select(
        "doc_id", *[F.col("__counts")[c].alias(c) for c in quality.COUNTS], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept")
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, at_least=(85, 100))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.path(spark, "token-blocks")
    token_files.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), at)
    return token_files.documents(spark, at)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, anchors=F.col("vec_id") % 100 == 0)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), queries=F.col("vec_id") % 100 == 0)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_packing,
        op3_embedding_dedup,
        op4_suffix_dedup,
        op5_quality_rules,
        op6_ngram_join,
        op7_secret_scan,
        op8_mixing,
        op9_substring_dedup,
        op10_token_files,
        op11_hard_negatives,
        op12_top_k,
        op13_centroid_clusters,
    )
}
