"""Every registered query plans; checks have the same names; the flagship returns rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.catalog import entries
from tools.check import TABLES, rows_of

CHECKED = sorted(entries.sql())


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert {f"op{n}" for n in range(1, 14)} >= {n.partition("_")[0] for n in q if n[2:3].isdigit()}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["symbol", "trade_date", "ts"] and df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = rows_of(entry.queries()[name](spark, sf).toArrow())
    con.execute(f"CREATE VIEW checked AS {entry.oracle_sql()[name]}")
    want = rows_of(con.sql("SELECT * FROM checked").to_arrow_table())
    assert got[0] == want[0] and got[1] == want[1]
