"""Queries that SQL can express, against DuckDB on the driver's tables."""

import duckdb
import pytest

from skyfuse.llm import registry

SF = "/root/testdata/sf0.001"


def comparable(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(int(v) if isinstance(v, bool) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert comparable(tuple(r) for r in got.select(*columns).collect()) == comparable(cursor.fetchall())
