"""Every query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidelog.plans.oracle import ORACLE_SQL
from tidelog.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(round(r[i], 6) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in data]
    return sorted(columns), sorted(flat, key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())
