"""Every registered query beside its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from compare import digest
from trackloom.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rel = db.execute(SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, df.collect()) == digest(cols, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    """The same rows twice, and some; tests of the operators say that they are right."""
    df = QUERIES[name](spark, SF)
    rows = digest(df.columns, df.collect())
    assert rows[0] > 0
    again = QUERIES[name](spark, SF)
    assert digest(again.columns, again.collect()) == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
