"""Repeats of 100 bytes against a scan of all strings."""

import random

import numpy as np
import pytest

from lodeframe.llm import suffix_dedup, suffix_index
from tests.llm import brute


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    return docs, sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs, digest=True, **options).collect())


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_planted_repeats(spark, seed):
    rnd = random.Random(seed)
    letters = "ab" if seed == 4 else "abcdefghij é€"
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [make(n) for n in (99, 100, 101, 140, 300, 900)]
    rows = []
    for i in range(60):
        text = make(rnd.randint(0, 400))
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, 3) and rnd.randint(0, len(p) // 2)
            text += p[cut:] + make(rnd.randint(0, 50))
        rows.append((i * 3, text))
    rows += [(500 + i, rows[7][1]) for i in range(20)] + [(700, "x" * 5000), (701, "xy" * 400)]
    rnd.shuffle(rows)
    assert run(spark, rows, block_bytes=4000)[1] == brute.repeats(rows)


def test_odd_rows(spark):
    a, b = "q" * 99, "".join(chr(97 + k % 26) + str(k) for k in range(60))
    rows = [(1, None), (2, ""), (3, a), (4, a), (5, b), (6, b), (7, b[:99]), (8, "z" + b[:100] + "z")]
    assert run(spark, rows)[1] == brute.repeats(rows)
    docs = spark.createDataFrame([(5, b), (5, b), (None, b), (None, "w" * 10)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs, digest=True).collect())
    assert got == [(0, 10, 0), (0, len(b), len(b)), (5, len(b), 0), (5, len(b), len(b))]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    spans = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame([(5, b), (8, "z" + b[:100] + "z")], "doc_id long, text string")).collect()}
    assert spans[8].removed_from == [1] and spans[8].removed_to == [101] and spans[8].kept == b"zz" and spans[5].removed_from == []


def test_op9_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in suffix_dedup.op9_suffix_dedup(spark, sf).collect()) == brute.repeats(docs)


def test_family_keeps_few_levels_and_first_owners():
    rnd = np.random.default_rng(1)
    family, first = suffix_dedup.Family(), {}
    batches = []
    for rank in range(64):
        keys = np.unique(rnd.integers(0, 4000, 100).astype(np.uint64))
        docs = rnd.integers(0, 50, len(keys)).astype(np.int64)
        batches.append((keys, docs))
        for k, d in zip(keys.tolist(), docs.tolist()):
            first[k] = min(first.get(k, (d, rank)), (d, rank))
        family.add(keys, keys, docs, rank)
        assert len(family.levels) <= 10
    for rank, ((keys, docs), states) in enumerate(zip(batches, family.states)):
        assert [s == suffix_dedup.REPEAT for s in states] == [first[k] != (d, rank) for k, d in zip(keys.tolist(), docs.tolist())]


def test_batches_in_turn_give_the_result_of_one(spark, tmp_path):
    """Levels are stored, sorted by text and few; a new batch is compared with all earlier ones."""
    rnd = random.Random(11)
    make = lambda n: "".join(rnd.choice("abcdefghij é€") for _ in range(n))
    passages = [make(n) for n in (99, 100, 130, 400)]
    rows = []
    for i in range(120):
        text = make(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            text += p[rnd.randint(0, len(p) // 3) :] + make(rnd.randint(0, 40))
        rows.append((i, text))
    rows[50:52] = [(50, None), (51, "")]
    want = {r[0]: r for r in brute.repeats(rows)}
    index = suffix_index.SuffixIndex(spark, str(tmp_path / "index"))
    cuts = [0, 40, 55, 70, 71, 72, 100, 120]
    for a, b in zip(cuts, cuts[1:]):
        batch = spark.createDataFrame([(*r, 1) for r in rnd.sample(rows[a:b], b - a)], "doc_id long, text string, place int")
        got = index.add(batch).collect()
        assert sorted(r.doc_id for r in got) == list(range(a, b))
        for r in got:
            n_bytes, n_removed, n_spans, sha = want[r.doc_id][1:]
            assert (r.n_bytes, sum(y - x for x, y in zip(r.removed_from, r.removed_to)), len(r.removed_from)) == (n_bytes, n_removed, n_spans)
            assert suffix_dedup.hashlib.sha256(r.kept).hexdigest() == sha
        number, levels = index.state()
        sizes = [n for _, n in levels]
        assert all(n * 2 <= m for m, n in zip(sizes, sizes[1:]))
    assert number == 7 and index.level(*(n for n, _ in levels)).count() == sum(sizes)
    assert index.add(batch.limit(0)).count() == 0
    first = [bytes(r.suffix) for r in spark.read.parquet(f"{tmp_path}/index/{levels[0][0]}").orderBy(suffix_dedup.F.spark_partition_id()).collect()]
    assert first == sorted(first)
    # Ids that come again in a later batch: the earlier batch is earlier.
    known = max((t for _, t in rows if t), key=len)
    twice = index.add(spark.createDataFrame([(0, known)], "doc_id long, text string")).first()
    assert twice.kept == b"" and twice.removed_to == [len(known.encode())]


def test_rows_longer_than_a_chunk(spark, monkeypatch):
    rnd = random.Random(12)
    make = lambda n: "".join(rnd.choice("abcdefghij é€") for _ in range(n))
    passage = make(150)
    rows = [(1, make(900) + passage + make(2000) + passage), (2, make(50) + passage[10:] + make(1200)), (3, passage * 9)]
    block = suffix_dedup.Block
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    docs = suffix_dedup.pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    table = suffix_dedup._ask_segments((suffix_dedup.pa.scalar(0),), docs, 2)
    assert table.num_rows and len(block(docs).p1)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(block(docs).p1, block(docs).p2)])
    at = block(docs).at
    assert sorted(starts) == [k for a, b in zip(at, at[1:]) for k in range(a, b - 99)]
    shards = 3
    served = suffix_dedup._serve(suffix_dedup._ask_segments((suffix_dedup.pa.scalar(0),), docs, shards))
    asked = suffix_dedup._ask_strings((suffix_dedup.pa.scalar(0),), docs, served, shards)
    got = suffix_dedup._finish(docs, suffix_dedup._serve(asked), shards, True)
    assert [tuple(r.values()) for r in got.to_pylist()] == brute.repeats(rows)
