"""TF-IDF, logistic regression, calibration and learning curves."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import logistic
from corpuslab.operators.terms import dictionary, terms, vectors


def document_frequency(docs: DataFrame, *, id_col: str, text_col: str, min_df: int = 2, max_df: float = 0.98, row_each: bool = False) -> DataFrame:
    """(term, df, idf) of terms within the bounds; idf is ln((1 + n) / (1 + df)) + 1.

    A document is an ``id_col``: where its text stands in several rows, a term
    counts once for all of them. ``row_each`` says that no id has two rows,
    which spares the shuffle of texts by id.
    """
    spark = docs.sparkSession
    rows = docs.select(id_col, text_col)
    # A file too small for the cores is dealt out all the same.
    if not row_each or rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), id_col)
    total = docs.agg((F.count("*") if row_each else F.count_distinct(id_col)).alias("n"))
    rows = rows.select(id_col, F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    # A document's terms are told apart where its rows lie; then one row a document and term is counted with map-side combining.
    rows = (rows if row_each else rows.distinct()).groupBy("term").agg(F.count("*").alias("df"))
    rows = rows.where(F.col("df") >= min_df).join(F.broadcast(total)).where(F.col("df") <= F.floor(F.col("n") * max_df))
    return rows.select("term", "df", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame, frequency: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, term, weight): (1 + ln tf) * idf, scaled to length one a document."""
    counts = docs.select(id_col, F.explode(terms(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    rows = counts.join(frequency, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    length = rows.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return rows.join(length, id_col).select(id_col, "term", (F.col("w") / F.col("length")).alias("weight"))


def platt(rows: DataFrame, *, margin_col: str, label_col: str = "label"):
    """A one-dimensional logistic fit of labels on margins."""
    ready = VectorAssembler(inputCols=[margin_col], outputCol="__m").transform(rows)
    return LogisticRegression(featuresCol="__m", labelCol=label_col, regParam=0.0, maxIter=200).fit(ready)


def temperature_grid(rows: DataFrame, *, margin: str, label: str, low: float = 0.05, high: float = 5.0, steps: int = 100) -> DataFrame:
    """(temperature, loss): mean log loss of margins over a grid, one pass and one aggregation."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.round(F.lit(low) + i * ((high - low) / (steps - 1)), 6)))
    spread = rows.select(margin, label, grid.alias("temperature"))
    z = F.when(F.col(label) == 1, -F.col(margin)).otherwise(F.col(margin)) / F.col("temperature")
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return spread.groupBy("temperature").agg(F.avg(loss).alias("loss"))


def learning_curve(train: DataFrame, held: DataFrame, sizes: list[int], *, text_col: str, order_col: str = "position", most: int = 200_000) -> list[dict]:
    """Accuracy on both sets for nested prefixes of ``train``; one dictionary and one fit a size, of that prefix alone.

    Both tables have ``row`` and ``label`` (``terms.spread``).
    """
    out = []
    for n in sizes:
        part = train.where(F.col(order_col) < n)
        known = dictionary(part, text_col=text_col, most=most)
        seen, unseen = (vectors(d, known, text_col=text_col, keep=["label"]) for d in (part, held))
        model = logistic.fit(seen, size=most)
        accuracy = lambda d, m=model: m.score(d, "label").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        a, b = accuracy(seen), accuracy(unseen)
        out.append({"training_samples": n, "training_accuracy": a, "validation_accuracy": b, "generalization_gap": a - b})
    return out
