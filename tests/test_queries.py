"""Each query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fenland.plans import registry

D = "/root/testdata/sf0.001"


def rows(frame, columns):
    def plain(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(r[c]) for c in columns) for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "documents"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    found = con.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    df = registry.queries()[name](spark, D)
    assert sorted(df.columns) == columns
    got = [r.asDict() for r in df.collect()]
    assert rows(got, columns) == rows(want, columns)


def test_entry_has_all_queries(spark):
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
