import glob
import importlib
import math
import os

import pytest

from newsloom.plans import load

CORE = load()


def norm(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_same_as_sql(spark, folder, duck, name):
    df = CORE.queries[name](spark, folder)
    columns = sorted(df.columns)
    table = duck.execute(CORE.sql[name]).to_arrow_table()
    assert sorted(table.column_names) == columns
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[c]) for c in columns) for r in table.to_pylist()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_runs(spark, folder, name):
    assert CORE.queries[name](spark, folder).count() >= 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert {"p2_found"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
