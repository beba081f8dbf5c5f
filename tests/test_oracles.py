"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lakeloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: None of these has SQL; they are tested elsewhere and must return rows here.
FREE = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    frame = registry.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    theirs = duck.sql(registry.ORACLES[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=repr)


@pytest.mark.parametrize("name", FREE)
def test_returns_rows(spark, sf, name):
    assert not registry.QUERIES[name](spark, sf).isEmpty()
