"""Files: metadata documents, text folders, JSONL, CSV, Parquet splits; sinks with reload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import strip
from corpuslab.functions.values import percentage
from corpuslab.sources import records


def metadata_samples(spark: SparkSession, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """The ``samples`` list of a metadata document, or of one a line; a document without one gives an error."""
    rows = spark.read.schema(f"samples array<struct<{schema}>>").option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return rows.select(F.inline(F.coalesce("samples", F.raise_error(F.lit("metadata holds no samples list")))))


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of ``*.txt`` files below a folder."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return rows.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def notes(spark: SparkSession, path: str, *, text_col: str = "Text", percent_col: str = "AI percent") -> DataFrame:
    """A CSV with quoted line ends and perhaps a byte order mark; ``problem`` says which row is wrong, and how."""
    rows = records.csv_rows(spark, path, required=(text_col, percent_col))
    problem = F.when(strip(F.coalesce(text_col, F.lit(""))) == "", f"{text_col} cannot be empty").when(percentage(F.col(percent_col)).isNull(), f"{percent_col} is not a percentage of 0 to 100")
    return rows.withColumn("problem", records.numbered_problem(problem, F.col("_row")))


def splits(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == name)


def verified_splits(rows: DataFrame, path: str) -> DataFrame:
    """Write by split into a new folder, read it back, and compare the splits."""
    rows.write.partitionBy("split").mode("errorifexists").parquet(path)
    return same_splits(rows, rows.sparkSession.read.parquet(path))


def same_splits(rows: DataFrame, reread: DataFrame) -> DataFrame:
    """(split, written, read, same); ``same`` says that both hold the same rows.

    Rows are compared by their number and the sum and parity of two hashes.
    """
    columns = sorted(c for c in rows.columns if c != "split")

    def marks(d: DataFrame, name: str) -> DataFrame:
        one, two = F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1))
        seen = F.struct(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.bit_xor(two))
        return d.groupBy("split").agg(F.count("*").alias(name), seen.alias(f"__{name}"))

    both = marks(rows, "written").join(marks(reread, "read"), "split", "full")
    return both.select("split", "written", "read", F.coalesce(F.col("__written") == F.col("__read"), F.lit(False)).alias("same"))


def save_splits(rows: DataFrame, path: str) -> DataFrame:
    """(split, written, read) of splits that are not read back as they were written."""
    return verified_splits(rows, path).where(~F.col("same")).drop("same")


def wide_predictions(rows: DataFrame, *, id_col: str, models: list[str]) -> DataFrame:
    """Two columns a model: score and label."""
    out = rows.groupBy(id_col).pivot("model", models).agg(F.first("score").alias("score"), F.first("label").alias("label"))
    return out


def export_prompts(manifest: DataFrame, progress: DataFrame) -> DataFrame:
    """Finished prompts in manifest order."""
    return manifest.join(progress.where(strip(F.col("question")) != ""), "prompt_id").orderBy("position")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace rows of ``table`` with equal keys; the rest stays."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def digests(rows: DataFrame, key: Column, content: Column, depth: int = 12) -> DataFrame:
    """(range, n, total, other): additive digests of the rows in each of 2 ** ``depth`` ranges of the key's hash.

    Sums of two hashes tell multisets apart, repeated rows too, and add up:
    a range's digest is the sum of its halves', so ranges form a tree.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - depth).cast("int")
    wide = lambda seed: F.sum(F.xxhash64(content, F.lit(seed)).cast("decimal(38,0)"))
    return rows.groupBy(place.alias("range")).agg(F.count("*").alias("n"), wide(0).alias("total"), wide(1).alias("other"))


def differences(left: DataFrame, right: DataFrame, *, key: str, content: Column, depth: int = 12) -> DataFrame:
    """(key, in_left, in_right): keys whose rows differ between two tables, with the number of rows of the differing contents.

    Only ranges whose digests differ are compared row by row.
    """
    a, b = (digests(d, F.col(key), content, depth) for d in (left, right))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "total", "other")]
    off = a.alias("a").join(b.alias("b"), "range", "full").where(~(same[0] & same[1] & same[2])).select("range")
    place = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - depth).cast("int")
    kept = lambda d: d.withColumn("range", place).join(F.broadcast(off), "range", "left_semi").select(key, F.xxhash64(content).alias("h"))
    both = kept(left).withColumn("l", F.lit(1)).unionByName(kept(right).withColumn("l", F.lit(0)))
    cells = both.groupBy(key, "h").agg(F.sum("l").alias("in_left"), F.sum(1 - F.col("l")).alias("in_right")).where("in_left <> in_right")
    return cells.groupBy(key).agg(F.sum("in_left").alias("in_left"), F.sum("in_right").alias("in_right"))


def snapshot(rows: DataFrame, path: str, digest: Column, key: str | None = None) -> DataFrame:
    """Freeze rows once; later calls return the frozen rows and fail if new ones differ, naming up to 20 values of ``key``."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        rows.write.mode("errorifexists").parquet(path)
    frozen = spark.read.parquet(path)
    off = differences(frozen.withColumn("__k", F.col(key) if key else digest), rows.withColumn("__k", F.col(key) if key else digest), key="__k", content=digest)
    if bad := off.orderBy("__k").limit(20).collect():
        raise ValueError(f"the snapshot was made from other rows: {', '.join(str(r['__k']) for r in bad)}")
    return frozen


def card_rows(rows: DataFrame) -> DataFrame:
    """(split, examples, bytes) of a dataset."""
    return rows.groupBy("split").agg(F.count("*").alias("examples"), F.sum(F.octet_length("text")).alias("bytes"))


def card(rows: DataFrame) -> str:
    """A Markdown table of splits with rows and bytes of text; one line a split."""
    lines = card_rows(rows).orderBy("split").collect()
    return "\n".join(["| split | rows | bytes |", "| --- | ---: | ---: |", *[f"| {r.split} | {r.examples} | {r.bytes} |" for r in lines]])
