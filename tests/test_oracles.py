"""Each query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(rows):
    def one(x):
        return "null" if x is None else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = plans.queries()[name](spark, SF)
    out = db.execute(plans.oracle_sql()[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(df.select(*[f"`{n}`" for n in names]).collect()) == canon(out.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
