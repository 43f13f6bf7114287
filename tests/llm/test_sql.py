"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from spindrift.llm.queries import QUERIES, SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    text = lambda rows, names: sorted(tuple("~" if r[names.index(c)] is None else str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert text(df.collect(), df.columns) == text(found.fetchall(), columns)
