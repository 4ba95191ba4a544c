"""LM scores against a dictionary model, secret scans by held-out accuracy, and the pipeline stage by stage."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeframe.llm import lm_scoring, quality_rules, secrets, toxicity
from lodeframe.llm.decontaminate import find_contamination
from tests.llm import brute

ALPHABET = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")


def halves(spark, ids):
    """id -> 0 or 1."""
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r.id: r.h for r in frame.select("id", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(2)).alias("h")).collect()}


def plain_losses(lists, half):
    """lists: (id, words). half: id -> 0 or 1 of wanted documents. (id, n, target loss, background loss) of each."""
    uni, bi = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for i, w in lists:
        for k in ([half[i]] if i in half else []) + [2]:
            uni[k].update(w)
            bi[k].update(zip(w, w[1:]))
    v = max(len(uni[2]), 2**lm_scoring.WORD_BITS)
    out = []
    for i, w in lists:
        losses = []
        for models in (((1 - half[i],) if i in half else (0, 1)), (2,)):
            of = lambda counts, x: sum(counts[m][x] for m in models)  # noqa: B023, E731
            space = sum(uni[m].total() for m in models) + lm_scoring.ADD * v
            total = 0.0
            for a, b in zip([None, *w], w):
                p1 = (of(uni, b) + lm_scoring.ADD) / space
                total -= math.log(p1 if a is None else (of(bi, (a, b)) + lm_scoring.MU * p1) / (of(uni, a) + lm_scoring.MU))
            losses.append(total / max(len(w), 1))
        out.append((i, len(w), *losses))
    return out


def test_losses_equal_a_dictionary_model(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(40)], k=rnd.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (None, "w1 w2"), (5, "W1 w2, w3"), (102, "...")]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, score string, _row int, half int")
    wanted = [1, 2, 3, 5, 8, 8, 9, 12, 77777]
    labels = spark.createDataFrame([(w,) for w in wanted] + [(None,)], "doc_id long")
    half = halves(spark, set(wanted))
    assert set(half.values()) == {0, 1}
    want = [(i or -1, n, a, b, a - b) for i, n, a, b in plain_losses([(i, brute.ITEM_WORD.findall((t or "").translate(brute.UPPER))) for i, t in rows], half)]
    scored = lm_scoring.score_documents(docs, labels)
    assert {(r._row, r.half) for r in scored.collect()} == {(1, 2)}
    got = [(r.doc_id or -1, r.n_tokens, r.loss_target, r.loss_background, r.score) for r in scored.collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-4, abs=1e-5)
    assert {r.score for r in lm_scoring.score_documents(docs.where("text = ''"), labels).collect()} == {0.0}
    assert lm_scoring.score_documents(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("shard_tokens", [1 << 23, 5000])
def test_every_word_and_pair_has_its_own_count(spark, shard_tokens):
    """More distinct words than 2**WORD_BITS, and as many pairs; some common words. Held against exact counts."""
    rnd = random.Random(6)
    lists = [(i, [f"x{(i * 1200 + j) // 2}" if j % 4 else rnd.choice(("the", "of")) for j in range(1200)]) for i in range(600)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in lists], "doc_id long, text string").repartition(4)
    want = plain_losses(lists, halves(spark, range(0, 600, 3)))
    assert len({w for _, ws in lists for w in ws}) > 2**lm_scoring.WORD_BITS
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, spark.range(0, 600, 3).withColumnRenamed("id", "doc_id"), shard_tokens=shard_tokens).collect()}
    assert len(got) == 600
    for i, n, target, background in want[::37]:
        assert got[i].n_tokens == n and (got[i].loss_target, got[i].loss_background) == pytest.approx((target, background), rel=1e-6)


def test_target_like_documents_score_lower(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices([f"{'a' if i % 2 else 'b'}{k}" for k in range(60)], k=40))) for i in range(400)]
    got = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long")).collect()
    held = [r for r in got if r.doc_id >= 200]
    assert max(r.score for r in held if r.doc_id % 2) < min(r.score for r in held if not r.doc_id % 2)
    assert all(r.selected == (r.score < 0) for r in got)


def test_candidates_equal_a_plain_scan(spark):
    texts = [None, "", "short a1", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é', "é" * 3 + "AbCdEfGhIjKlMnOpQrStUv", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 60_000 + "1", "a/b_c-d+e=f1 22222222222222222222"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])], "doc_id long, text string")
    want = []
    for i, t in [*enumerate(texts), (3, texts[3]), (-1, texts[3])]:
        for m in re.finditer(rb"[A-Za-z0-9+/=_-]{12,}", (t or "").encode()):
            s = m.group()
            if re.search(rb"[0-9]", s) or (len(s) >= 20 and re.search(rb"[A-Z]", s[1:]) and re.search(rb"[a-z]", s)):
                want.append((i, *m.span()))
    got = secrets.scan_secrets(docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.end) for r in got.collect()) == sorted(want)
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_held_out_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.learn_model(docs, secrets.labelled_findings())
    forest = secrets.train_forest(spark, secrets.labelled_findings(), model)
    held = secrets.labelled_findings(1500, seed=99)
    rows = [(*secrets._features(b.encode()[-48:], c.encode(), a.encode()[:48], model), float(y)) for b, c, a, y in held if len(c) >= secrets.MIN_LENGTH]
    frame = secrets.VectorAssembler(inputCols=list(secrets.NAMES), outputCol="features").transform(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*secrets.NAMES, "label"))))
    got = forest.transform(frame).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in got]) > 0.97


def test_dictionary_is_of_common_words_of_the_corpus(spark):
    rows = [(i, f"common Words stand here{'' if i % 2 else ' rarely'} abc {'once' if i == 7 else ''}") for i in range(4100)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.learn_model(docs, secrets.labelled_findings(400))
    assert all(map(model.knows, ("common", "words", "stand", "here", "rarely"))) and not any(map(model.knows, ("once", "absent", "abc")))
    odds = secrets.learn_neighbours(secrets.labelled_findings())
    assert odds["token"] > 0.5 > 0 > odds["sha256"]


def test_assigned_values_of_any_length_and_alphabet(spark):
    values = ["P@ssw0rd!2024", "qzkvjwxp", "TrQvbnZkLpWx", "a#7", "kvzq$wpx%é", "vqkzjxwpbnmtrgfdsqwz"]
    forms = ['password = "{}" x', "client_secret: '{}'", "x AUTH_TOKEN={} y", '{{"apiKey": "{}"}}', "userPassword => `{}`"]
    rows = [(i, f.format(v), v) for i, (f, v) in enumerate((f, v) for f in forms for v in values)] + [(900, 'monkey = "abc" note: short', None), (901, 'token = "', None), (902, "key=" * 30_000, None)]
    got = {}
    for r in secrets.scan_secrets(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.start, r.end] = r.is_secret
    for i, t, v in rows[:-3]:
        a = t.encode().index(v.encode())
        assert (a, a + len(v.encode())) in got[i], (t, got.get(i))
    assert 900 not in got and 901 not in got and len(got[902]) <= 2
    sure = [got[i][t.index(v), t.index(v) + len(v)] for i, t, v in rows[:-3] if v == "P@ssw0rd!2024"]
    assert sum(sure) >= 4, sure


def test_planted_tokens_are_secrets_and_numbers_are_not(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = Counter()
    for r in secrets.op10_secret_scan(spark, sf).collect():
        raw = texts[r.doc_id].encode()
        found, before = raw[r.start : r.end].decode(), raw[: r.start].decode()
        if re.fullmatch("[0-9a-f]{40}", found) and before.endswith('token = "'):
            seen["token", r.is_secret] += 1
        elif re.fullmatch("[0-9]{16}", found):
            seen["number", r.is_secret] += 1
    assert seen["token", True] and not seen["token", False] and seen["number", False] and not seen["number", True]


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        made.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = docs.collect(), out.collect()
        if name != "sharding":
            assert out.columns == docs.columns and set(after) <= set(before)
        if name == "jaccard_join":
            comps = brute.near_components([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted(d for d, (_, c) in comps.items() if d == c)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert {r.doc_id for r in after} == {x[0] for x in brute.contamination([(r.doc_id, r.text) for r in before], items) if not x[5]}
        if name == "sharding":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
        assert after
        docs = out
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.shard) for r in whole) == sorted((r.doc_id, r.shard) for r in after)


CLASHES = "position target rank source_size _size score held_out predicted n_words n_hit items hit_from hit_to shard slot size copy mix _row _id _text _doc h1 label component_id".split()


def test_stages_take_odd_rows(spark, tmp_path):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (3, "word " * 20_000, "en", None, 1), (3, "other words", "en", "t", 2)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(f"own {k}"))
    docs.write.parquet(str(tmp_path / "stored"))
    for frame in (docs, docs.limit(0), spark.read.parquet(str(tmp_path / "stored"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            got = out.collect()
            if name != "sharding":
                assert out.columns == docs.columns
                assert all(r[c] == f"own {k}" for r in got for k, c in enumerate(CLASHES)), name
    assert find_contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 6


@pytest.mark.parametrize("rows_a_file", [0, 7])
def test_slots_are_in_training_order(spark, tmp_path, rows_a_file):
    """The order of the mix, through files, into the slots of a shard; however many files a task writes."""
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 9), f"s{i % 4}") for i in range(800)], "doc_id long, text string, source string")
    corpus_pipeline.mix_sources(spark, docs, "").write.option("maxRecordsPerFile", rows_a_file).parquet(str(tmp_path / "mixed"))
    assert len(list((tmp_path / "mixed").glob("part-*-c001*"))) == (8 if rows_a_file else 0)
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    place, _ = corpus_pipeline.training_order(mixed)
    order = [r.doc_id for r in mixed.select("doc_id", place.alias("p")).orderBy("p").collect()]
    want = [r.doc_id for r in sorted(corpus_pipeline.mix_documents(docs).collect(), key=lambda r: (r.position, r.mix["rank"], r.mix.start))]
    assert order == want
    shards = {}
    for r in sorted(corpus_pipeline.deal_shards(spark, mixed, "").collect(), key=lambda r: r.slot):
        shards.setdefault(r.shard, []).append(r.doc_id)
    where = {d: k for k, ds in shards.items() for d in ds}
    assert all(ds == [d for d in order if where[d] == k] for k, ds in shards.items())


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = ("".join(f"{x}{k} " for k in range(40)) for x in "abc")
    rows = [(None, a), (None, a), (None, a + "end"), (7, b), (7, b), (7, c), (None, b), (9, c), (None, None), (None, ""), (7, "")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter((r.doc_id, r.text) for r in got if r.text) == {(None, a): 1, (7, b): 1, (7, c): 1}
    assert sum(not r.text for r in got) == 3


def test_other_files_come_by_name_and_row(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for k, name in enumerate(("some-c12ab.parquet", "part-1.parquet")):
        pq.write_table(pa.table({"doc_id": [2 * k, 2 * k + 1], "text": ["a", "b"], "source": ["s", "s"]}), str(tmp_path / "docs" / name))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    place, _ = corpus_pipeline.training_order(docs)
    at = {r.doc_id: r.p for r in docs.select("doc_id", place.alias("p")).collect()}
    assert at[1] == at[0] + 1 and at[3] == at[2] + 1 and min(at.values()) >= 1 << 62
    assert corpus_pipeline.deal_shards(spark, docs, "").count() == 4


def test_columns_of_other_cases_and_dotted_ids(spark):
    rows_ = [(f"d{k}", "token = \"a81f0c2de94b7a6655d3c1f0a9b8e7d6c5f4a3b2\" and more words of text", "en", 1, 2, 3, 4) for k in range(4)]
    docs = spark.createDataFrame(rows_, ["doc.id", "text", "lang", "Score", "N_Hit", "Kept", "Held_Out"])
    labels = spark.createDataFrame([("d1", 1, 1), ("d2", 0, 0)], ["doc.id", "toxic", "quality"])
    scored = toxicity.score_toxicity(docs, labels, id_col="doc.id")
    assert len({c.lower() for c in scored.columns}) == len(scored.columns) and scored.count() == 4 and "score" in scored.columns
    assert toxicity.drop_toxic(docs, labels, id_col="doc.id").columns == docs.columns
    found = find_contamination(docs, spark.createDataFrame([(1, "and more words of text")], "item_id long, text string"))
    assert [r.n_hit for r in found.collect()] == [5] * 4 and "N_Hit" not in found.columns
    judged = quality_rules.judge_quality(docs, labels, keep=["doc.id", "Kept", "lang"], id_col="doc.id")
    assert judged.columns[:2] == ["doc.id", "lang"] and judged.columns.count("kept") == 1 and judged.count() == 4
    assert {r.doc_id for r in secrets.scan_secrets(docs, id_col="doc.id").collect()} == {"d0", "d1", "d2", "d3"}
