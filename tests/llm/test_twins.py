"""The corpus queries that have an SQL twin equal it on the smallest sample tables."""

import duckdb
import pytest

from episodica.llm import queries
from tests.test_oracle import comparable

TWINS = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_equals_sql_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cur = con.execute(TWINS[name])
    order = sorted(d[0] for d in cur.description)
    expected = comparable([dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()], order)
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == order
    assert comparable([r.asDict() for r in df.collect()], order) == expected
