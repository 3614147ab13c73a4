"""Every corpus query with a SQL twin returns the same rows as that SQL in another engine."""

from pathlib import Path

import duckdb
import pytest
from compare import rows

import __spark_entry__ as contract
from panelweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    ours, theirs = queries.QUERIES[name](spark, small).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_registered_with_the_rest():
    found = contract.queries()
    assert [sum(n.startswith(f"op{i}_") for n in found) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in found
    assert set(queries.ORACLE) <= set(contract.oracle_sql())
