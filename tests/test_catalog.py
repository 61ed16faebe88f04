"""Every catalogue query equals its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import pytest

from patchloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.collect(), df.columns) == _rows(want.fetchall(), want.columns)


def test_every_query_has_sql():
    assert set(catalog.queries()) - {"q_token_counts"} == set(catalog.oracle_sql())  # merges have no SQL: tests/test_tokens.py
