"""Secret scans with corpus-wide ownership frequency.

Candidates are cut out of every text by regular expressions. Their hashes are
then counted over the whole corpus by distinct repositories and owners. A
value that several owners carry is a widely copied example; a value that only
one owner has is a live-looking credential. Base candidates are always
reported; the wider ``token`` pattern adds a span only where its value turns
out to be owner-specific. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import columns, scratch

# Kinds in order, pattern, group of the secret value, least length of that group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("token", r"[A-Za-z0-9_-]{24,}", 0, 24),
)
NAMES = [k for k, *_ in KINDS]
TYPE = "array<struct<kind:int,gap:int,n:int,h1:bigint,h2:bigint,good:boolean>>"
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def matches(text: Column, number: int) -> Column:
    """Matches of one kind in order: the code points between each and the one before, its own, hashes of its value.

    Splitting by the pattern gives the text between matches. Positions follow
    from running sums, which are taken over rows: a sum anew for each match of
    a text would be quadratic in their number.
    """
    _, pattern, group, least = KINDS[number]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    good = lambda v: F.length(v) >= least
    if NAMES[number] == "token":
        good = lambda v: (F.length(v) >= least) & v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("v"))  # one gap more than hits
    found = F.transform(
        F.filter(zipped, lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(
            F.lit(number).alias("kind"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("n"),
            F.xxhash64(x["v"]).alias("h1"),
            F.xxhash64(F.lit(7), x["v"]).alias("h2"),
            good(x["v"]).alias("good"),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(TYPE))


def spans_of(found: DataFrame) -> DataFrame:
    """(row, id, owner, start, kind, end, h1, h2): good spans of ``found`` (row, id, owner, m); of kind token those clear of all base spans.

    A span overlaps a base span if, of the base spans that start before its
    end, one ends after its start; running sums and maxima over a text's
    matches find that in one pass each.
    """
    each = found.select("row", "id", "owner", F.posexplode("m").alias("pos", "x")).select("row", "id", "owner", "pos", "x.*")
    run = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run))
    each = each.where("good").select("row", "id", "owner", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "h1", "h2")
    base = F.col("kind") < 3
    order = Window.partitionBy("row").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), F.when(base, 1).otherwise(0))
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("reach", reach).where(base | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", examples_from: int = 2, copied_from: int = 50
) -> DataFrame:
    """One row a row of ``docs``: id, base counts, ``base_sha256``, ``spans``, ``n_live``, ``n_examples``.

    A repository is a document id and an owner a value of ``owner_col``; nulls
    are one owner. A value with ``examples_from`` or more owners, or in
    ``copied_from`` or more repositories of one owner, is an example; any other
    is live. Null and empty texts have no spans. Repeated rows keep a row each
    and count once as repository. Extra columns are not read, and an empty
    table gives an empty table.
    """
    text = F.coalesce(columns.col(text_col), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        columns.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), columns.col(owner_col).cast("string")), F.lit("")).alias("owner"),
        F.concat(*[matches(text, k) for k in range(len(KINDS))]).alias("m"),
    )
    found = scratch.stage(found, "secret-matches")
    each = scratch.stage(spans_of(found), "secret-spans")
    spread = each.select("h1", "h2", "owner", "id").distinct().groupBy("h1", "h2", "owner").agg(F.count("*").alias("repos"))
    spread = spread.groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.max("repos").alias("repos"))
    told = each.join(spread, ["h1", "h2"])
    live, base = (F.col("owners") < examples_from) & (F.col("repos") < copied_from), F.col("kind") < 3
    span = F.struct("start", "kind", "end")
    told = told.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(base | live, span))).alias("every"),
        *[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(3)],
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_examples"),
    )
    out = found.select("row", "id").join(told, "row", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    none = F.array().cast(f"array<{SPAN}>")
    return out.select(
        F.col("id").alias(id_col),
        count("n0").alias("n_assign"),
        count("n1").alias("n_access"),
        count("n2").alias("n_hex"),
        F.sha2(_joined(F.coalesce("base", none)), 256).alias("base_sha256"),
        _joined(F.coalesce("every", none)).alias("spans"),
        count("n_live").alias("n_live"),
        count("n_examples").alias("n_examples"),
    )


def _joined(spans: Column) -> Column:
    """By start, then kind as listed."""
    name = lambda s: F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
