"""The driver's contract: every query runs on the smallest tables, and equals its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for p in SF.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    sql, wrong = entry.oracle_sql(), []
    assert set(sql) <= set(entry.queries())
    for name, f in entry.queries().items():
        df = f(spark, str(SF))
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        if name in sql:
            r = con.execute(sql[name])
            cols = [c[0] for c in r.description]
            if sorted(cols) != sorted(df.columns) or rows(cols, r.fetchall()) != got:
                wrong.append(name)
    assert not wrong


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
