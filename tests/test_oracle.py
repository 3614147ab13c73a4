"""Every query with a SQL twin returns the same rows as that SQL in another engine."""

from pathlib import Path

import duckdb
import pytest
from compare import rows

from panelweave.plans import catalog

# neither rows in Python nor products of two tables belong in these plans
KERNELS = ("gap_fill_kernel", "forecast_from_fall")  # one Arrow function each
UNWANTED = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct")


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in UNWANTED if p in plan and not (name in KERNELS and p == "ArrowEvalPython")]
    ours = df.toPandas()
    theirs = duck.sql(catalog.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    brute_force = {"gap_fill_fitted"}  # tests/test_smoothing.py
    assert set(catalog.QUERIES) - brute_force == set(catalog.ORACLE)
