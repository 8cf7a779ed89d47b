"""The registered queries against their SQL, and properties of operators that SQL cannot express."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for k, f in __spark_entry__.queries().items() if not k.startswith("op") and k != "pipeline"}
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def cells(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else str(v) if isinstance(v, float) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    mine, theirs = cells(got.columns, got.collect()), cells(names, want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns and out.limit(1).count() == 1


def test_entry_imports_without_the_language_model_operators():
    assert QUERIES and SQL
