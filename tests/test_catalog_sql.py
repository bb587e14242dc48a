"""Every registered catalogue query against its DuckDB SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lumenlake.plans import catalog, catalog_more  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLES:  # a tokenizer's merges are no SQL
        assert name == "prompt_ids" and got
        return
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_plans_stay_in_the_engine(spark, sf_dir):
    """Filters and columns reach the scan; browsing needs no shuffle of the table."""
    plan = catalog.QUERIES["browse_filters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang)" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "TakeOrdered" in plan
