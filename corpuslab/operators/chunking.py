"""Documents cut into chunks of words or tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.functions import values as V

# Chunk lengths that documents rotate through.
TARGETS = (50, 100, 250, 500, 1000)


def chunk_documents(docs: DataFrame, *, id_col: str, text_col: str, key: Column, most: int = 12) -> DataFrame:
    """Chunks (id, chunk, target, piece) of rotating target lengths, at most ``most`` a document.

    The first target follows from the key's hash. Offsets are in closed form:
    whole turns of all targets plus the targets of the started turn. A rest
    too short for a chunk of its own joins the last one.
    """
    n, total, least = len(TARGETS), sum(TARGETS), min(TARGETS)
    doubled = F.array(*map(F.lit, TARGETS + TARGETS))
    words = X.words(X.clean_inline(F.col(text_col)))
    # Through a generator, so that the filter below it does not clean and split every text a second time.
    rows = docs.select(F.col(id_col), (V.hash_int(key) % n).cast("int").alias("start"), F.explode(F.array(words)).alias("w"))
    rows = rows.withColumn("size", F.size("w")).where(F.col("size") >= least)

    def bounds(k: Column) -> Column:
        seat = (k % n).cast("int")
        offset = F.floor(k / n) * total + F.aggregate(F.slice(doubled, F.col("start") + 1, seat), F.lit(0), lambda a, x: a + x)
        target = F.get(doubled, F.col("start") + seat)
        end = F.least(offset + target, F.col("size"))
        end = F.when((F.col("size") - end > 0) & (F.col("size") - end < least), F.col("size")).otherwise(end)
        return F.struct((k + 1).cast("long").alias("chunk"), target.alias("target"), offset.cast("int").alias("offset"), end.cast("int").alias("end"))

    turns = F.sequence(F.lit(0), F.floor(F.col("size") / total * n).cast("int") + n)
    rows = rows.withColumn("c", F.filter(F.transform(turns, bounds), lambda c: F.col("size") - c["offset"] >= least))
    # Pieces are cut inside the row, so that the words are not copied for each chunk.
    rows = rows.withColumn("c", V.evenly_spaced(F.col("c"), most))
    piece = lambda c: F.array_join(F.slice("w", c["offset"] + 1, c["end"] - c["offset"]), " ")
    pieces = F.transform("c", lambda c: F.struct(c["chunk"].alias("chunk"), c["target"].alias("target"), piece(c).alias("piece")))
    return rows.select(id_col, F.inline(pieces))


def token_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 512) -> DataFrame:
    """Chunks (id, chunk, tokens, piece) of ``size`` words; pieces concatenate to the text."""
    rows = docs.select(F.col(id_col), F.regexp_extract_all(F.col(text_col), F.lit(r"\A\s+\S+\s*|\S+\s*"), F.lit(0)).alias("t"))
    rows = rows.where(F.size("t") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.size("t") / size).cast("int") - 1)))
    piece = F.slice("t", F.col("chunk") * size + 1, F.lit(size))
    return rows.select(id_col, F.col("chunk").cast("long").alias("chunk"), F.size(piece).cast("long").alias("tokens"), F.array_join(piece, "").alias("piece"))
