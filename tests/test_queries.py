"""Every query that has SQL, against an independent engine, on the smallest tables."""

import duckdb
import pytest

from assize.jobs import hearings, oracle as sql, queries, records
from assize.jobs.queries import flagship

QUERIES, ORACLE_SQL = queries.QUERIES | hearings.QUERIES | records.QUERIES, sql.ORACLE_SQL | hearings.ORACLE_SQL | records.ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as from '{SF}/{name}.parquet'")
    return con


def rows_of(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return columns, sorted(repr(tuple(str(x) for x in r)) for r in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, oracle, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(oracle.sql(ORACLE_SQL[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0
