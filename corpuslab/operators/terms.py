"""Terms of texts: words and their pairs, a dictionary over the corpus, sparse TF-IDF vectors.

Terms are 64-bit hashes that the JVM makes, so no string is grouped, shuffled
or broadcast; two of n distinct terms share a hash with a chance of
n * n / 2 ** 65 and then count as one.

* The dictionary counts each document's distinct terms where the document
  lies, bounds their document frequency, and numbers the survivors by a range sort with prefix
  sums; the most frequent ones are kept, so its size is bounded by ``most``
  whatever the corpus holds, and it may be broadcast.
* A vector is put together where its text lies: terms are looked up by binary
  search and counted by sorting, in arrays over batches of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.ordering import numbered
from corpuslab.sources import shared

#: Terms that a task holds at a time.
ENTRIES = 2_000_000
#: A run of two or more word characters; the search is greedy, so a run is never cut.
TOKEN = r"(?U)\w\w+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _with_pairs(items: Column, pair) -> Column:
    """``items`` and ``pair`` of each two neighbours; the array is bound once, so it is computed once."""
    one = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    both = lambda w: F.concat(w, F.zip_with(F.slice(w, F.lit(1), one(w)), F.slice(w, F.lit(2), one(w)), pair))
    return F.get(F.transform(F.array(items), both), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased words of two or more characters and their pairs."""
    return _with_pairs(words(text), lambda a, b: F.concat_ws(" ", a, b))


def counted(docs: DataFrame, *, text_col: str, keep: list[str]) -> DataFrame:
    """(row, *keep, term, tf): hashes of the terms of each text with their number; a null term keeps texts that have no other.

    Texts are dealt out by ``row`` and cut there, so their terms are told
    apart without a shuffle of terms; a word and the one after it stand in one
    row, from which both hashes are made in generated code.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("row", *keep, text_col).repartition(parts, "row").select("row", *keep, words(F.col(text_col)).alias("a"))
    both = dealt.select("row", *keep, F.inline_outer(F.arrays_zip("a", F.slice("a", F.lit(2), F.lit(1 << 30)).alias("b"))))
    pair = F.when(F.col("b").isNotNull(), F.xxhash64("a", "b"))
    word = F.when(F.col("a").isNotNull(), F.xxhash64("a"))
    rows = both.select("row", *keep, F.explode(F.array(word, pair)).alias("term"))
    return rows.groupBy("row", *keep, "term").agg(F.count("*").alias("tf"))


def hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, then of their pairs."""
    words_of = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    one = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), one(w)), F.slice(w, F.lit(2), one(w)), lambda a, b: F.xxhash64(a, b))
    return F.get(F.transform(F.array(words(text)), lambda w: F.concat(words_of(w), pairs(w))), F.lit(0))


def _batches(frame: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, row and hash of each term) of about ``ENTRIES`` terms, one row at least; a null list is empty."""
    lists = frame.column("terms")
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    values = lists.flatten().to_numpy()
    i = 0
    while i < frame.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + ENTRIES, side="right")) - 1)
        yield frame.slice(i, j - i), np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), values[ends[i] : ends[j]]
        i = j


def _weighed(spark: SparkSession, known: DataFrame, keep: list[str]) -> Callable:
    """The vectors of a task's rows; the dictionary, bounded whatever the corpus holds, is broadcast as arrays by hash."""
    table = known.select("term", "index", "idf").toArrow()
    by_hash = np.argsort(at := table.column("term").to_numpy())
    sent = spark.sparkContext.broadcast((at[by_hash], table.column("index").to_numpy()[by_hash], table.column("idf").to_numpy()[by_hash]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_, index_of, idf_of = sent.value
        for frame in frames:
            for part, row, term in _batches(frame):
                n = part.num_rows
                place = np.minimum(np.searchsorted(terms_, term), max(len(terms_) - 1, 0))
                hit = np.flatnonzero(terms_[place] == term) if len(terms_) else np.zeros(0, np.int64)
                place, row = place[hit], row[hit]
                code = np.sort((row << 32) | index_of[place].astype(np.int64))
                code, tf = np.unique(code, return_counts=True)
                row, index = code >> 32, (code & 0xFFFFFFFF).astype(np.int32)
                idf = np.zeros(len(terms_))
                idf[index_of] = idf_of
                w = (1 + np.log(tf)) * idf[index]
                length = np.sqrt(np.bincount(row, w * w, n))
                ends = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                values = pa.array((w / length[row]).astype(np.float32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(index)), pa.ListArray.from_arrays(ends, values)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *lists], names=[*keep, "indices", "values"])

    return run


def spread(docs: DataFrame, *by: str) -> DataFrame:
    """``docs`` staged with a number ``row`` a row, in as many files as the session has shuffle partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared.stage(docs.repartition(parts, *by).withColumn("row", F.monotonically_increasing_id()), "texts")


def dictionary(docs: DataFrame, *, text_col: str, most: int = 200_000, min_df: int = 2, max_df: float = 0.98) -> DataFrame:
    """(term, index, idf), staged: hashes of terms in at least ``min_df`` and at most ``max_df`` of the documents.

    The ``most`` frequent ones are kept, ties by hash, and numbered from 0 in
    that order; idf is ln((1 + n) / (1 + df)) + 1. Null texts count as documents
    without terms.
    """
    total = docs.count()
    seen = counted(docs, text_col=text_col, keep=[]).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    seen = seen.where((F.col("df") >= min_df) & (F.col("df") <= int(total * max_df)))
    kept = numbered(seen, [F.desc("df"), "term"], "index").where(F.col("index") < most)
    idf = F.ln(F.lit(1.0 + total) / (1 + F.col("df"))) + 1
    return shared.stage(kept.select("term", F.col("index").cast("int").alias("index"), idf.alias("idf")), "dictionary")


def vectors(docs: DataFrame, known: DataFrame, *, text_col: str, keep: list[str]) -> DataFrame:
    """(*keep, indices, values), staged: (1 + ln tf) * idf of the terms that ``known`` holds, by ascending index, scaled to length one,
    in single precision.

    ``docs`` has a number ``row`` that no other row has (``spread``). Texts
    without a known term, null ones too, give empty arrays.
    """
    rows = docs.select(*keep, hashes(F.col(text_col)).alias("terms"))
    types = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in keep)
    run = _weighed(docs.sparkSession, known, keep)
    return shared.stage(rows.mapInArrow(run, f"{types}, indices array<int>, values array<float>"), "vectors")
