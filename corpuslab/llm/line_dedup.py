"""Line dedup over levelled sorted runs of line hashes.

The index is a small log-structured tree kept in the shared folder. A run is a
Parquet table bucketed and sorted by the 128-bit hash of a line's key, holding
each key once with the smallest document that has it. Documents arrive in
batches of ascending id. A batch

1. reduces its own lines to one row a key (map-side combined, so a line that a
   third of all documents share is one row per map task),
2. merge-anti-joins those keys against every run; equal bucketing means that
   the runs are not shuffled again,
3. writes the keys that no run holds as a new run on level 0, and
4. compacts any level that has reached ``fanout`` runs into one run a level up,
   which later batches join in their place; after the last batch nothing would
   read a compacted run, and none is written.

All runs are removed when the last batch is done. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import columns, scratch

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@dataclass
class RunIndex:
    """Runs by level; ``levels[i]`` lists table names, oldest first."""

    spark: SparkSession
    buckets: int
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def runs(self) -> list[str]:
        return [name for level in reversed(self.levels) for name in level]

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def scan(self, name: str) -> DataFrame:
        """A run's rows without its buckets: a join that a hot line skews deals them anew and can be split."""
        return self.spark.read.schema(self.read(name).schema).parquet(self.paths[name])

    def write(self, rows: DataFrame) -> str:
        """Write rows that carry ``h1``, ``h2`` as a bucketed, sorted table."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch.path(self.spark, "run")
        (
            rows.write.format("parquet")
            .option("path", self.paths[name])
            .bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .saveAsTable(name)
        )
        return name

    def owners(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, owner, ...) with ``old``: the owner some run names, or null."""
        out = keys.withColumn("old", F.lit(None).cast("long"))
        for name in self.runs():
            run = self.read(name).where("fresh").select("h1", "h2", F.col("owner").alias("run_owner"))
            out = out.join(run, ["h1", "h2"], "left").withColumn("old", F.least("old", "run_owner")).drop("run_owner")
        return out

    def add(self, name: str) -> None:
        """Put a run on level 0 and compact full levels."""
        level, new = 0, name
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            merged = None
            for old in self.levels[level]:
                rows = self.read(old).where("fresh").select("h1", "h2", "owner")
                merged = rows if merged is None else merged.unionByName(rows)
            merged = merged.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
            new = self.write(merged.withColumn("fresh", F.lit(True)))
            for old in self.levels[level]:
                self.drop(old)
            self.levels[level] = []
            level += 1

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        for name in list(self.paths):
            self.drop(name)


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2) of the lines of ``rows`` (id, row, text) that are long enough."""
    keyed = rows.select("id", "row", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = keyed.select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """One row ``(id, row, gone array<int>)`` for each text that loses lines; ``row`` is the text's hash."""
    spark = docs.sparkSession
    rows = docs.select(columns.col(id_col).alias("id"), columns.col(text_col).alias("text")).withColumn("row", F.xxhash64("text"))
    steps = [i / batches for i in range(1, batches)]
    cuts = rows.agg(F.percentile_approx("id", F.array(*map(F.lit, steps)), 1000).alias("c")).first()["c"] if steps else []
    cuts = sorted(set(cuts or []))
    # Texts are cut once; batches read their part of the line hashes, which lie in a folder each.
    batch = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = _lines(rows.where("id is not null"), min_chars).withColumn("batch", batch)
    at = scratch.path(spark, "lines")
    lines.write.partitionBy("batch").parquet(at)
    staged = spark.read.schema(lines.schema).parquet(at)
    index = RunIndex(spark, scratch.parts(spark), fanout)
    lost = None
    for number in range(len(cuts) + 1):
        lines = staged.where(F.col("batch") == number).drop("batch")
        own = lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
        seen = index.owners(own)
        name = index.write(
            seen.select(
                "h1",
                "h2",
                F.coalesce("old", "owner").alias("owner"),
                F.col("old").isNull().alias("fresh"),
                (F.col("old").isNotNull() | (F.col("owner") < F.col("last"))).alias("shared"),
            )
        )
        shared = index.scan(name).where("shared").select("h1", "h2", "owner")
        hits = lines.join(shared, ["h1", "h2"]).where(F.col("id") != F.col("owner")).select("id", "row", "pos")
        hits = scratch.stage(hits, "line-hits")
        lost = hits if lost is None else lost.unionByName(hits)
        if number < len(cuts):
            index.add(name)
    index.close()
    scratch.remove(spark, at)
    return lost.groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, plus ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and stands in two
    or more documents stays only in the document with the smallest id, with
    all its repeats there. A null or empty text is one empty line; its text
    becomes the empty string. A null id owns nothing and loses nothing.
    Rows that repeat an id count as one document; each keeps its own text.
    An empty table gives an empty table. Columns of ``docs`` named ``n_lines``
    or ``n_dropped`` are replaced; all others stay, whatever their names.
    """
    drops = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, batches=batches, fanout=fanout)
    key, row, gone, lines = columns.fresh(docs, "key", "row", "gone", "lines")
    text = columns.col(text_col)
    side = docs.withColumns({key: columns.col(id_col), row: F.xxhash64(text), lines: text_lines(text)})
    side = side.select(*columns.cols(columns.without(docs.columns, text_col)), key, row, lines)
    out = side.join(drops.select(F.col("id").alias(key), F.col("row").alias(row), F.col("gone").alias(gone)), [key, row], "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(gone, F.array().cast("array<int>")))
    left = F.when(F.col(gone).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(F.col(lines), i)), "\n"))
    new = {text_col.lower(): left, "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    names = [*docs.columns, *columns.without(["n_lines", "n_dropped"], *docs.columns)]
    return out.select(*[new[c.lower()].alias(c) if c.lower() in new else columns.col(c) for c in names])
