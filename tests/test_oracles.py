"""Every registered catalog query against its DuckDB oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from catalog_engine.plans import queries, queries_inputs, queries_tables, queries_text  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, int) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i].item() if hasattr(r[i], "item") else r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())
