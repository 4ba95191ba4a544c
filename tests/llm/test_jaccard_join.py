"""The near-duplicate join against all pairs."""

import random

import pytest

from lodeframe.llm import jaccard_join
from lodeframe.llm.components import components
from tests.llm import brute


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n string")
    got = jaccard_join.join_near(docs).collect()
    want = brute.near_components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    return want


def test_odd_rows(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, base), (9, base), (3, base.upper()), (7, base + " tail"), (1, None), (2, ""), (4, " \n"), (6, "one two"), (8, "ONE two"), (10, "one two three"), (11, "x " * 50), (12, "x " * 70), (13, base[: len(base) // 2])]
    want = check(spark, rows)
    assert want[7][1] == 3 and want[8][1] == 6 and want[1] == (0, 1)
    assert jaccard_join.join_near(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (2, "other text here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.join_near(docs).collect())
    assert got == [(0, 1, 0), (0, 2, 2), (2, 1, 2), (2, 2, 2), (2, 2, 2)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_families_near_the_threshold(spark, seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 300)}"
    common = [word() for _ in range(30)]
    rows = []
    for family in range(12):
        base = [word() for _ in range(rnd.randint(20, 120))] + (common if family % 3 == 0 else [])
        for _ in range(rnd.choice([1, 2, 5, 25])):
            text = list(base)
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join(common + [word() for _ in range(rnd.randint(0, 8))]) for _ in range(30)]
    rnd.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_op8_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op8_jaccard_join(spark, sf).collect()}
    assert got == brute.near_components(docs)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(7, 8), (8, 9), (9, 7), (3, 3)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 7, 8: 7, 9: 7}
