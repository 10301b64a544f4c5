"""Every query of the catalogue that has SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from tracelake.plans import catalogue, oracles, span_oracles, span_queries

QUERIES, ORACLES = catalogue.QUERIES | span_queries.QUERIES, oracles.ORACLES | span_oracles.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, table):
    return sorted(tuple(str(x) for x in r) for r in table[names].astype(object).where(table[names].notna(), None).itertuples(index=False))


def plain(table):
    return table.apply(lambda c: c.astype(float).round(6) if c.dtype.kind in "iuf" else c)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(names, plain(got)) == rows(names, plain(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
