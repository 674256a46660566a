"""Every query with an SQL twin equals it on the smallest sample tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from episodica.catalog import all_builders, all_oracles
from episodica.catalog.registry import runner
from tests.conftest import TABLES

QUERIES, ORACLES = {name: runner(name) for name in all_builders()}, all_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def comparable(rows, order):
    def plain(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return float(v) if isinstance(v, (int, float)) else v

    out = [tuple(plain(r[c]) for c in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql_twin(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    expected = comparable([dict(zip(names, r)) for r in cur.fetchall()], order)
    assert comparable([r.asDict() for r in df.collect()], order) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_twin(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_contract_has_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
