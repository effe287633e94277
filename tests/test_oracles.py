"""Every query of the reference's own operators against its DuckDB oracle, on sf0.001."""

import os
import sys

import duckdb
import pytest

import corpuslab.plans.files
import corpuslab.plans.loops
import corpuslab.plans.models
import corpuslab.plans.relational
import corpuslab.plans.scalars  # noqa: F401  (the five register their queries)
from corpuslab.plans.registry import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from verify import TABLES, canon  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - {"bld01_dataset"}))
def test_equals_oracle(spark, con, name):
    got, want = canon(QUERIES[name](spark, SF).toPandas()), canon(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_build_equals_oracle_and_raises_on_too_few_rows(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got, want = canon(QUERIES["bld01_dataset"](spark, "/root/testdata/sf0.01").toPandas()), canon(con.execute(ORACLES["bld01_dataset"]).df())
    assert len(got) > 300 and got.equals(want)
    with pytest.raises(ValueError, match="strata too thin"):  # 71 rows: the gates of the build refuse them
        QUERIES["bld01_dataset"](spark, SF)
