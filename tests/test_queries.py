"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

from skyfuse.plans import registry

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: float(f"{v:.9g}") + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return [names[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in data), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(registry.oracle_sql()[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want


def test_every_query_is_registered_once():
    names = [f.__name__ for f in registry._QUERIES]
    assert len(names) == len(set(names))
    assert set(registry.oracle_sql()) <= set(names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
