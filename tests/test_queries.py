"""Registered queries agree with their SQL on the smallest data."""

import math
import os

import duckdb
import pytest

from memlattice.plans import catalogue

SF = "/root/testdata/sf0.001"
RUNS, ORACLES = catalogue.QUERIES | catalogue.FIXTURES, catalogue.ORACLES | catalogue.FIXTURE_ORACLES
#: Every registered query and fixture; those without SQL must give rows.
ALL = sorted(RUNS)


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", ALL)
def test_query_matches_sql(spark, con, name):
    out = RUNS[name](spark, SF)
    if name not in ORACLES:
        assert out.count() > 0
        return
    want = con.sql(ORACLES[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert tidy(out.columns, [tuple(r) for r in out.collect()]) == tidy(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and set(catalogue.FIXTURE_ORACLES) <= set(catalogue.FIXTURES)
