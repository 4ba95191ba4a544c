"""The prefix trie against a plain version and its SQL, with the awkward rows."""

import random

import duckdb
import pytest

from lodeframe.llm import prefix_trie as pt
from tests.llm import brute

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, _node string"


def result(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-60, 120), 90):
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 13])):
            out.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None, ""]), rng.choice(["a b", "a", "", None, "é ü", "c  d\te"])))
    return [*out, *out[:10], (None, 0, "user", "lost"), (0, 0, "user", "a b"), (20, 1, "user", "a b")]


def test_odd_rows(spark):
    rows = made(3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want = sorted(brute.trie(rows), key=repr)
    assert result(pt.conversation_trie(df)) == want
    assert result(pt.conversation_trie(df.repartition(5).orderBy("text"))) == want
    assert max(w[1] for w in want) > 8 and any(w[0] is not None and w[0] < 0 for w in want)


def test_long_conversation_common_turns_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(pt, "BUCKET_BITS", 3)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400, 20) for t in range(5)] + [(1000, t, "user", f"turn {t % 7}") for t in range(150)] + [(3, 0, "user", "w " * 500_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert result(pt.conversation_trie(df)) == sorted(brute.trie(rows), key=repr)
    assert pt.conversation_trie(df.limit(0)).count() == 0
    assert pt.conversation_trie(df.where("conv_id = 3")).count() == len(brute.trie(rows[-1:]))


def test_sql_equals_plain_version():
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.01/conversations.parquet')")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({pt.OP13_SQL})").fetchall()
    assert sorted(got, key=repr) == sorted(brute.trie(rows), key=repr)


@pytest.mark.parametrize("sf", ["0.001"])
def test_op13_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(pt.op13_prefix_trie(spark, f"/root/testdata/sf{sf}")) == sorted(brute.trie(rows), key=repr)
