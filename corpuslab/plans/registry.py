"""Registration of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable:
    """Register ``f(tables) -> DataFrame`` under ``name``."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


class Rows:
    """A small literal relation for both engines."""

    def __init__(self, ddl: str, rows: Sequence[tuple]):
        self.ddl, self.rows = ddl, list(rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    @property
    def sql(self) -> str:
        names = ", ".join(part.split()[0] for part in self.ddl.replace("array<", "array ").split(", "))
        return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in self.rows)}) AS t({names})"


_NAMED = "CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def _exchange_sql(of: str, kind: str, to: str) -> str:
    """CTEs that hand each kind's surplus in a split of ``of`` to the splits that lack it; ``to`` is ``of`` with new folds."""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""{to}_p AS (SELECT *, {kind} AS k, {_NAMED} AS split FROM {of}),
 {to}_g AS (SELECT k, split, tenths * t AS goal FROM (SELECT k, sum(size) AS t FROM {to}_p GROUP BY k), (VALUES ('test', 1), ('train', 8), ('validation', 1)) AS v(split, tenths)),
 {to}_o AS (SELECT d.k, d.split, 10 * coalesce(sum(p.size), 0) - any_value(goal) AS excess FROM {to}_g d LEFT JOIN {to}_p p ON p.k = d.k AND p.split = d.split GROUP BY ALL),
 {to}_i AS (SELECT k, split, greatest(excess, 0) AS spare, sum(greatest(excess, 0)) OVER w - greatest(excess, 0) AS ahead, sum(greatest(-excess, 0)) OVER w - greatest(-excess, 0) AS lo, sum(greatest(-excess, 0)) OVER w AS hi
   FROM {to}_o WINDOW w AS (PARTITION BY k ORDER BY split {before})),
 {to}_b AS (SELECT p.k, p.split, spare, ahead, bucket, sum(size) AS n, 10 * sum(sum(size)) OVER (PARTITION BY p.k, p.split ORDER BY bucket {before}) AS upto
   FROM {to}_p p JOIN {to}_i i ON p.k = i.k AND p.split = i.split WHERE 20 * size <= spare GROUP BY p.k, p.split, spare, ahead, bucket),
 {to}_m AS (SELECT b.k, b.split, b.bucket, r.split AS goes FROM {to}_b b JOIN {to}_i r ON r.k = b.k AND b.ahead + upto - 10 * n >= r.lo AND b.ahead + upto - 10 * n < r.hi WHERE upto <= b.spare),
 {to} AS (SELECT grp, main, most, size, p.bucket, CASE goes WHEN 'test' THEN 0 WHEN 'validation' THEN 1 WHEN 'train' THEN 2 + p.bucket % 8 ELSE fold END::INT AS fold
   FROM {to}_p p JOIN {to}_i i ON p.k = i.k AND p.split = i.split LEFT JOIN {to}_m m ON m.k = p.k AND m.split = p.split AND m.bucket = p.bucket AND 20 * size <= i.spare)"""


def repaired_folds_sql(rows: str, stratum: str, seed: int = 17) -> str:
    """CTEs after which ``f`` has (grp, fold, split): groups of ``rows`` (grp, ``stratum``), dealt over ten folds and repaired, the last search aside."""
    return f"""cells AS (SELECT grp, {stratum}, count(*) AS n FROM {rows} GROUP BY ALL),
 g AS (SELECT grp, max_by({stratum}, (n, {stratum})) AS main, sum(n)::BIGINT AS size, max(n) AS most FROM cells GROUP BY grp),
 o AS (SELECT *, row_number() OVER (ORDER BY main, size DESC, sha256('{seed}:fold:' || grp), grp) - 1 AS place, ('0x' || substr(sha256('{seed}:repair:' || grp), 1, 8))::BIGINT % 4096 AS bucket FROM g),
 dealt AS (SELECT grp, main, most, size, bucket, CASE WHEN (place // 10) % 2 = 0 THEN place % 10 ELSE 9 - place % 10 END AS fold FROM o),
 lumps AS (SELECT * REPLACE (CASE WHEN fold < 2 AND 40 * size > 3 * sum(size) OVER () THEN 2 + bucket % 8 ELSE fold END AS fold) FROM dealt),
 {_exchange_sql("lumps", "main || ':' || (10 * most // size)", "fine")},
 {_exchange_sql("fine", "main", "coarse")},
 f AS (SELECT grp, fold, {_NAMED} AS split FROM coarse)"""
