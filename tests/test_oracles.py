"""Every registered query against its SQL in DuckDB, and entry()."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def cells(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def compare(spark, name):
    df = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in names)
    assert cells(df.select(*names).collect()) == cells(con.sql(f"SELECT {quoted} FROM want").fetchall())


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    compare(spark, name)


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql()])
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


def test_streaming_equals_batch(spark):
    q = entry.queries()
    assert cells(q["streaming_search"](spark, SF).collect()) == cells(q["max_matches"](spark, SF).collect())


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "qi", "ql", "width"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
