import importlib.util
import os
from decimal import Decimal
from numbers import Number

import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = entry.SMALL


def test_contract():
    names = set(entry.queries())
    assert "p3_found" in names and set(entry.oracle_sql()) <= names
    has_llm = importlib.util.find_spec("placeweave.llm") is not None
    assert has_llm == any(n.startswith("p1_") for n in names)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_core_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    from placeweave.plans import queries as core

    sql = core.oracle_sql()
    for name, q in core.queries().items():
        if name in sql:
            mine, theirs = q(spark, SMALL).toPandas(), con.execute(sql[name]).df()
            assert sorted(mine.columns) == sorted(theirs.columns) and len(mine) == len(theirs), name
            assert shown(mine) == shown(theirs), name


def shown(df) -> list:
    """Rows as sorted texts, numbers of any type alike."""

    def cell(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (Number, Decimal)) and not isinstance(v, bool):
            return f"{float(v):.5f}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))
