"""Alignment of two tokenizers against texts that are encoded whole, with the awkward rows."""

import random

import pytest

from lodeframe.llm import token_alignment as ta
from tests.llm import brute

FILES = (f"{ta.TOKENIZERS}/byte_bpe_50k.json", f"{ta.TOKENIZERS}/piece_bpe_32k.model")
BITS = ["a", "it's", " ", "  ", "\n", "\t", "\r\n", " ", "  ", "　", "é", "naïve", "日本", "한", "🎉", "▁", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x41>", "123", "4,5", "!?", "\x00", "\x1c", "\x85", "é", "ﬁ", "İ", "​", "﻿", "don't", "I'LL", "of the", "ation", " ", "ß", "Ω", "\x7f"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", *ta.NEW).collect()), key=repr)


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_odd_texts(spark, most):
    docs = [(k, t) for k, t in enumerate([None, "", " ", "  ", "a", "a", " a", "a ", "▁", "x▁ y", "\n", *texts(400, 1)])] + [(None, "same id"), (None, "same id"), (3, "again")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_a int, N_LINKS string")
    got = ta.align_tokens(df, broadcast_pairs=most)
    assert got.columns == ["doc_id", "text", *ta.NEW]
    want = sorted(brute.alignment(docs, ta.pair_of(*FILES)), key=repr)
    assert result(got) == want
    assert {x[1] for x in want if x[0] in (0, 1, 8, 9)} == {0}
    assert ta.align_tokens(df.limit(0)).count() == 0


def test_long_texts_in_slices(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join(rng.choice(["the", "ation", "é", "x" * 40, "日本語", "a  b", "\n"]) for _ in range(300_000))
    docs = [(1, long), (2, "y" * 200_000), (3, "short one"), (4, long[:1000])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(long) > 2 * ta.SLICE
    assert result(ta.align_tokens(df, keep=["doc_id"])) == sorted(brute.alignment(docs, ta.pair_of(*FILES)), key=repr)


def test_rows_in_small_slices(monkeypatch):
    monkeypatch.setattr(ta, "SLICE", 7)
    monkeypatch.setattr(ta, "REMEMBERED", 50)
    import numpy as np

    pair = ta.Pair(*FILES)
    docs = list(enumerate(texts(60, 2)))
    data = [t.encode() for _, t in docs]
    found = ta.Rows(len(docs))
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    ta.align_rows(pair, *ta.spaced(np.frombuffer(b"".join(data), np.uint8), at), found)
    want = brute.alignment(docs, pair)
    assert list(zip(found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.n_links.tolist(), strict=True)) == [w[1:5] for w in want]
    assert [d.hexdigest() if d else "" for d in found.digest] == [w[7] for w in want]


def test_op12_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(ta.op12_token_alignment(spark, sf)) == sorted(brute.alignment(docs, ta.pair_of(*FILES)), key=repr)
