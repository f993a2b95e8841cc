"""Every registered query of the library against its DuckDB twin, at the smallest scale."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from pulsegrid.plans import registry

DATA = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value + 0.0:.6f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    rows = registry.queries()[name](spark, DATA)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(rows.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in rows.collect())
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
