"""Toxicity by held-out accuracy; quality rules against plain counts and an exact binomial tail."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import quality_rules, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_held_out_rows_are_told_apart(spark):
    got = toxicity.op3_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 50 and right / len(got) > 0.9
    bad, good = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.9


def test_odd_rows_are_scored(spark):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(50)]
    rows = [(i, " ".join(rnd.choices(words, k=20)) + (" you Idiot!" if i % 4 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (900, None), (901, ""), (None, "IDIOT, you"), (902, "w1 " * 40_000 + "you idiot")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (None, 1), (99999, 1), (8, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    out = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == 305 and out[None, "IDIOT, you"].predicted == 1 and out[None, "IDIOT, you"].held_out is False
    assert out[901, ""].score == out[900, None].score < 0.5 and out[902, "w1 " * 40_000 + "you idiot"].predicted == 1
    assert all(out[r].held_out == (brute.crc(str(r[0])) % 5 == 0) for r in rows)
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_l1_leaves_few_weights(spark):
    labels, docs = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    ids, weights = toxicity.fit_model(docs, labels)
    assert len(ids) < 2_000 and all(weights != 0)


TEXTS = [None, "", "  \n\t ", "one", "a b c d e f g h i j", "a b c d e " * 6, "x y\nx y\n \n\nx y \nq", "é# $ü% *|<>& ñ", "r s t u v w " + "z " * 7 + " r s t u v", "n" * 100_000 + " m", " wide space\u0085", "l\u000bm\fn\ro"]


def test_counts_equal_plain_ones(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, "one", 7)], "doc_id long, text string, n_words int")
    got = quality_rules.judge_quality(docs.withColumn("lang", F.lit(None).cast("string")), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = brute.quality_base(TEXTS[r.doc_id])
        assert tuple(r[c] for c in quality_rules.BASE) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)


def test_table_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = quality_rules.op6_quality_rules(spark, SF).collect()
    assert len(got) == len(texts) and all(tuple(r[c] for c in quality_rules.BASE) == brute.quality_base(texts[r.doc_id]) for r in got)


def test_binomial_tail_is_exact(spark):
    for n, k, p in [(10, 0, 0.3), (10, 3, 0.3), (10, 10, 0.3), (2000, 5, 0.005), (500_000, 2400, 0.005)]:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert got == pytest.approx(want, rel=1e-6)


def test_thresholds_keep_the_promised_share(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(8000):
        symbols = 0 if rnd.random() > 0.002 else 12
        rows.append((i, "ab" if i % 2 else "cd", " ".join(["word"[: rnd.randint(2, 4)] + str(rnd.random())[2:8] for _ in range(20)]) + " #" * symbols))
    junk = [(10_000 + i, "ab", " ".join(f"w{rnd.randint(0, 10**6)}##" for _ in range(20))) for i in range(100)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    judged = quality_rules.judge_quality(docs, labels).collect()
    assert {r.n_labelled for r in judged} == {sum(not r.base_failed for r in judged if r.doc_id < 8000 and r.doc_id % 2 == k) for k in (0, 1)}
    got = {r.doc_id: r.kept for r in judged}
    assert sum(not got[r[0]] for r in rows) / len(rows) <= 0.02 and not any(got[r[0]] for r in junk)


def plain_cuts(good, alpha=quality_rules.ALPHA, delta=quality_rules.DELTA):
    """(stratum, rule) -> (n, cut, rejected). good: (stratum, base counts) of good documents."""
    out, strata = {}, sorted({s for s, _ in good})
    for s in strata:
        rows = [dict(zip(quality_rules.BASE, c)) for t, c in good if t == s]
        n = len(rows)
        for rule, cuts in quality_rules.GRID.items():
            out[s, rule] = (n, None, None)
            for cut in cuts:
                top, _, below = quality_rules.RATES[rule].partition(" / ")
                k = sum(r[top] / r[below] > cut for r in rows)
                tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(alpha) + (n - j) * math.log1p(-alpha)) for j in range(k + 1))
                if tail > delta / len(strata) / len(quality_rules.GRID):
                    break
                out[s, rule] = (n, cut, k)
    return out


def test_cutoffs_equal_plain_ones(spark):
    """Rules decide here: each cutoff, its rejections and the verdicts against a plain version."""
    rnd = random.Random(9)
    good = [(s, (50, 50 * rnd.randint(3, 9), int(rnd.expovariate(0.2)), 5 * int(rnd.random() < 0.0007), rnd.choice((0, 0, 0, 6)))) for s, n in (("a", 4500), ("b", 1400), ("c", 300), ("d", 1290)) for _ in range(n)]
    frame = spark.createDataFrame([(s, *c) for s, c in good], "lang string, " + ", ".join(f"{c} long" for c in quality_rules.BASE))
    want = plain_cuts(good)
    got = {(r.lang, r.rule): (r.n, r.cut, r.rejected) for r in quality_rules.threshold_report(frame, "lang").collect()}
    assert got == want
    assert any(v[1] is not None and v[2] for v in want.values()) and all(v[1] is None for k, v in want.items() if k[0] == "c")
    cuts = {r.lang: r.cuts for r in quality_rules.fit_thresholds(frame, "lang").collect()}
    assert all(cuts[s].get(rule) == v[1] for (s, rule), v in want.items())
    assert quality_rules.least_labelled(4) == 1151


def test_quality_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert quality_rules.judge_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_ftrl_equals_a_plain_version(spark):
    """Weights and scores against dictionaries and single numbers."""
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rnd.choices(words, k=6)) + (" vile thing" if i % 5 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows + [(7, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.where("text <> 'other text'"), labels).collect()}
    order = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64(F.lit(5), "doc_id").alias("o")).collect()}

    def feats(text):
        w = text.split()
        return {("1", x) for x in w} | {("2", *p) for p in zip(w, w[1:])} | {("3", *p) for p in zip(w, w[2:])} | {"bias"}

    z, n = {}, {}
    def weight(f):
        pay = 0.0 if f == "bias" else toxicity.L1
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= pay else -(v - math.copysign(pay, v)) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA)

    train = sorted((order[i], int(i % 5 == 0), t) for i, t in rows if brute.crc(str(i)) % 5)
    for _ in range(toxicity.EPOCHS):
        for _, y, text in train:
            w = {f: weight(f) for f in feats(text)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in w:
                old = math.sqrt(n.get(f, 0.0))
                n[f] = n.get(f, 0.0) + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - old) / toxicity.ALPHA * w[f]
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(weight(f) for f in feats(t)))), abs=1e-5)
