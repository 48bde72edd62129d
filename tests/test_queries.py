"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow.dataset as ds
import pytest

from paperloom.plans import delivery, queries, stored  # delivery and stored add their queries to theirs

assert delivery.NOW and stored.NOW
DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.register(f.stem, ds.dataset(str(f)).to_table())
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in queries.ORACLE_SQL:
        rel = duck.sql(queries.ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "source", "n_chars"]
    assert set(e.oracle_sql()) <= set(e.queries())
