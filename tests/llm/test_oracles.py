"""The SQL of the operators that have one, over the whole tables, against the plain versions."""

import duckdb

from lodeframe.llm import queries
from tests.llm import brute


def test_sql_equals_plain_versions():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    docs, items = con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert sorted(con.execute(queries.ORACLE_SQL["op2_decontaminate"]).fetchall()) == sorted(brute.contamination(docs, items))
    assert sorted(con.execute(queries.ORACLE_SQL["op8_jaccard_join"]).fetchall()) == sorted((k, *v) for k, v in brute.near_components(docs).items())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
