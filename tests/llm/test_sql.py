"""The queries of the subpackage that have SQL, against DuckDB."""

import duckdb
import pytest

from corpusloom.llm import queries as module


@pytest.mark.parametrize("name", module.oracle_sql())
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = module.queries()[name](spark, sf)
    found = con.execute(module.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(found.fetchall())
