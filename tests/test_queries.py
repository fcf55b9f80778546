"""Every registered query runs; where there is SQL, DuckDB gives the same rows."""

import duckdb
import pytest

from corpusloom import oracles
from corpusloom import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", engine.queries())
def test_query(spark, duck, sf, name):
    df = engine.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in oracles.ORACLES:
        assert rows
        return
    found = duck.execute(oracles.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)


def test_pruning_and_pushdown(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(engine.url_normalize(spark, sf))
    assert "PushedFilters: [IsNotNull(url), StringStartsWith(url,https)]" in plan(
        spark.read.parquet(f"{sf}/pages.parquet").where("url LIKE 'https%'").select("page_id")
    )


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("missing", ["corpusloom.llm", "corpusloom.llm.queries", "xxhash", "corpus_pipeline"])
def test_entry_without_modules(missing, monkeypatch):
    """Whatever of the subpackage or of what it needs is missing, the engine's queries stay."""
    import sys

    import __spark_entry__ as e

    there = any(k.startswith("op1_") for k in e.queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("corpusloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # importing it raises
    assert set(engine.queries()) <= set(e.queries()) and set(oracles.ORACLES) <= set(e.oracle_sql())
    assert "pipeline" not in e.queries() and (there and missing == "corpus_pipeline") == any(k.startswith("op1_") for k in e.queries())
