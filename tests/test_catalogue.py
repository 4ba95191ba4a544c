"""Every query of the catalogue against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodeframe.plans import catalogue, code_queries, version_queries

ALL = catalogue.QUERIES | code_queries.QUERIES | version_queries.QUERIES
SQL = catalogue.ORACLE_SQL | code_queries.ORACLE_SQL | version_queries.ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module", params=["sf0.001"])
def sides(request):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{request.param}/{t}.parquet')")
    return f"/root/testdata/{request.param}", con


@pytest.mark.parametrize("name", list(ALL))
def test_query_equals_sql(spark, sides, name):
    sf_dir, con = sides
    got = ALL[name](spark, sf_dir)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    values = want.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, values)
    assert values or sf_dir.endswith("0.001")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
