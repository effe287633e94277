"""Mixing sources to target weights by nested hash thresholds.

Every document has a uniform hash. A source's budget is met by taking the
documents whose hash lies below a threshold. The threshold is found from
histograms: tokens are summed by (source, top bits), the bucket in which the
running sum crosses the budget is refined by the next bits, and so on for
``levels`` rounds. Only the boundary bucket's documents are looked at again,
nothing is sorted, and a larger budget always takes a superset of a smaller
one's documents. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(id_col: Column, bits: int) -> Column:
    """``bits`` (<= 32) uniform bits from the id's decimal digits."""
    digest = F.sha2(F.coalesce(id_col.cast("string"), F.lit("")), 256)
    full = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.shiftright(full, 32 - bits)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row a source: ``__src``, ``source_size``, ``target``.

    Sources in code point order, null last, take ``weights`` in turn. Filling
    to a common level: source i gets min(max_epochs * size, level * weight),
    and the level is set so that the targets add up to all words. The sources
    that meet their cap are a prefix in the order of cap / weight.
    """
    by = sizes.groupBy("source", "__src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    by = by.withColumn("w", w.cast("long")).withColumn("cap", max_epochs * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    by = by.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    by = by.withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")).cast("double") / F.col("left_w"))
    # The first source in that order whose share at this level stays below its cap fixes the level for it and all later ones.
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    by = by.withColumn("final", F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w"))
    return by.select("__src", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    bits: int = 10,
    levels: int = 3,
) -> DataFrame:
    """One row a document: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` counts words; a null or empty text has 0. ``copies`` says how
    often the mix takes the document, at most ``max_epochs``; ``taken`` is
    ``copies * size``. A null source is a source of its own, the last one.
    Every document gets floor(target / source_size) copies, and those below
    the source's hash threshold one more. Rows that repeat an id share its
    hash. An empty table gives an empty table; extra columns are not read.
    """
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    sizes = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        src.alias("__src"),
        word_count(F.col(text_col)).alias("size"),
        unit_hash(F.col(id_col), bits * levels).alias("h"),
    )
    sizes = scratch.stage(sizes, "mix-sizes")
    goals = source_targets(sizes, weights, max_epochs)
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    goals = goals.withColumn("base", base.cast("long")).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    goals = scratch.stage(goals, "mix-goals")
    edge = goals.select("__src", F.lit(0).cast("long").alias("lo"), F.col("rest"))
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        rows = sizes.select("__src", "size", "h")
        if level:
            # Only the boundary bucket: hashes that agree with lo above this level's bits.
            inside = edge.select("__src", F.shiftright("lo", shift + bits).alias("top"))
            rows = rows.withColumn("top", F.shiftright("h", shift + bits)).join(inside, ["__src", "top"])
        bins = rows.groupBy("__src", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("__src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("below", F.coalesce(F.sum("words").over(run), F.lit(0)))
        bins = bins.join(edge.select("__src", "rest"), "__src").where(F.col("below") <= F.col("rest"))
        # The last bucket that starts within the budget is the boundary bucket.
        cross = bins.groupBy("__src").agg(F.max_by(F.struct("bin", "below", "words"), F.col("bin")).alias("b"), F.max("rest").alias("rest"))
        edge = cross.select(
            "__src",
            F.shiftleft("b.bin", shift).alias("lo"),
            (F.col("rest") - F.col("b.below")).alias("rest"),
            F.col("b.words").alias("words"),
        )
        edge = scratch.stage(edge, "mix-edge")
    # Take the last bucket too if that comes nearer to the budget.
    edge = edge.select("__src", (F.col("lo") + F.when(F.col("words") - F.col("rest") <= F.col("rest"), 1).otherwise(0)).alias("limit"))
    goals = goals.join(edge, "__src", "left")
    out = sizes.join(goals, "__src")
    copies = F.col("base") + F.when((F.col("h") < F.col("limit")) & (F.col("base") < max_epochs), 1).otherwise(0)
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
