"""Every registered query beside its SQL, on tables in which all keys used are unique."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            v = "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
        return f"{type(v).__name__}:{v}"

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert contract.entry(spark).count() == 15


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    mine = shape(df.columns, df.collect())
    assert mine[1], "no rows"
    if name in SQL:
        rel = duck.execute(SQL[name])
        assert mine == shape([d[0] for d in rel.description], rel.fetchall())
