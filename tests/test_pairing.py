"""Pairing by weighted sets against a plain greedy version, and where one bucket holds tens of thousands of rows."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import pairing

SETS = {"x": 0.4, "y": 0.35, "z": 0.15}
SCHEMA = "key string, bucket string, x array<string>, y array<string>, z array<string>, kind string"


def plain(a, b, least, same_weight=0.1, other=0.3):
    """Rows (key, bucket, x, y, z, kind). All pairs of a bucket, best first; equal rows are one profile."""

    def profiles(own, others):
        there = {(r[1], p, e) for r in others for p in range(3) for e in r[2 + p]}
        out = {}
        for r in sorted(own):
            sets = tuple(frozenset(e for e in r[2 + p] if (r[1], p, e) in there) for p in range(3))
            out.setdefault((r[1], sets, tuple(len(set(r[2 + p])) for p in range(3)), r[5]), []).append(r[0])
        return out

    pa, pb = profiles(a, b), profiles(b, a)
    pairs = []
    for (ba, sa, na, ka), ra in pa.items():
        for (bb, sb, nb, kb), rb in pb.items():
            if ba == bb:
                score = 0.0
                for p, w in enumerate(SETS.values()):
                    union = na[p] + nb[p] - len(sa[p] & sb[p])
                    score += w * len(sa[p] & sb[p]) / union if union else 0.0
                score = round(score + same_weight * (1.0 if ka == kb else other), 6)
                if score >= least:
                    pairs.append((-score, hashlib.md5(f"{ra[0]}|{rb[0]}".encode()).hexdigest(), ra[0], rb[0], ra, rb))
    left_a, left_b = ({r[0]: list(r) for r in p.values()} for p in (pa, pb))
    out = []
    for s, _, x, y, _, _ in sorted(pairs, key=lambda p: p[:4]):
        while left_a[x] and left_b[y]:
            out.append((left_a[x].pop(0), left_b[y].pop(0), -s))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    names = [f"e{k}" for k in range(25)]
    return [(f"k{seed}{i}", rng.choice(["p", "q", None]), *[rng.sample(names, rng.choice([0, 1, 1, 2, 4])) for _ in range(3)], rng.choice("uv")) for i in range(n)]


@pytest.mark.parametrize("least", [0.2, 0.45, 0.8])
def test_pairs_equal_a_plain_greedy_version(spark, least):
    a, b = made(1, 120), made(2, 130)
    b += [(f"copy{k}", *a[k][1:]) for k in range(0, 40)] + [(f"again{k}", *a[5][1:]) for k in range(4)]
    got = pairing.pair_by_sets(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "key", "bucket", SETS, ["kind"], least, 0.1, 0.3)
    assert sorted((r.key_a, r.key_b, pytest.approx(r.score)) for r in got.collect()) == plain(a, b, least)


def test_nothing_in_common_and_empty_sides(spark):
    a = spark.createDataFrame(made(3, 5), SCHEMA)
    other = a.withColumns({c: F.array(F.lit("new")) for c in SETS})
    for b in (other, a.limit(0)):
        got = pairing.pair_by_sets(a, b, "key", "bucket", SETS, ["kind"], 0.45, 0.1, 0.3)
        assert got.columns == ["key_a", "key_b", "score"] and not got.count()
    with pytest.raises(ValueError):
        pairing.pair_by_sets(a, a, "key", "bucket", SETS, ["kind"], 0.1, 0.1)


def test_twenty_thousand_rows_of_one_bucket(spark):
    """All pairs would be 400 million; every row has the common elements of its kind and an element of its own."""
    n = 20_000
    ids = spark.range(n)

    def side(name, shift):
        own = F.concat(F.lit("own"), ((F.col("id") + shift) % n).cast("string"))
        half = F.when(F.col("id") % 2 == 0, F.array(own)).otherwise(F.array(F.concat(F.lit(name), F.col("id").cast("string"))))
        return ids.select(F.concat(F.lit(name), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), F.lit("Ljava/lang/Object;").alias("bucket"), F.array(F.lit("()V")).alias("x"), half.alias("y"), F.array(F.lit("<init>")).alias("z"), F.lit("class").alias("kind"))

    start = time.time()
    got = pairing.pair_by_sets(side("a", 0), side("b", 2), "key", "bucket", SETS, ["kind"], 0.45, 0.1, 0.3).collect()
    assert len(got) == len({r.key_a for r in got}) == len({r.key_b for r in got}) == n
    best = {r.key_a: r.key_b for r in got if r.score == 1.0}
    assert len(best) == n // 2 and all((int(x[1:]) - int(y[1:])) % n == 2 for x, y in best.items())
    assert time.time() - start < 240


def test_pairs_are_scored_where_they_are_formed(spark):
    """300 x 300 pairs meet under a common element and few reach the score: only these may be shuffled or written."""
    side = lambda name: spark.range(300).select(F.concat(F.lit(name), "id").alias("_profile"), F.lit("=").alias("_bucket"), F.array(F.lit("e")).alias("k0"), F.lit(1).alias("n0"), F.array((F.col("id") % 60).cast("string")).alias("k1"), F.lit(1).alias("n1"), F.lit("{}").alias("_same"))
    bounds = lambda p: p.select("_bucket", F.lit(0).alias("_part"), F.lit("e").alias("_element"), "_profile", F.lit(0.9).alias("_rest"))
    a, b = side("a"), side("b")
    pairs = pairing.candidate_pairs(bounds(a), bounds(b), (a, b), [0.5, 0.4], 0.1, 0.3, 0.95)
    assert len({(r.pa, r.pb) for r in pairs.collect()}) == pairs.count() == 300 * 5
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    # The last join is the one that forms the pairs: what it gives is scored in place.
    first = plan.index("Join Inner")
    assert "Aggregate" not in plan[:first] and "array_min" in plan[first : plan.index("Join Inner", first + 1)]


@pytest.mark.parametrize(("seed", "names"), [(11, 300), (17, 60)])
def test_rare_elements_and_bits_in_small_blocks_and_steps(spark, monkeypatch, seed, names):
    """Sets of more elements than a mask holds, as groups in blocks of three and steps of 40 pairs."""
    for name, value in {"WORDS": 1, "BLOCK": 3, "PAIRS": 40}.items():
        monkeypatch.setattr(pairing, name, value)
    rng = random.Random(seed)
    names = [f"e{k}" for k in range(names)]
    row = lambda key: (key, "p", *[sorted(set(rng.choices(names, [1 / (k + 1) for k in range(len(names))], k=rng.choice([0, 2, 6, 12])))) for _ in range(3)], rng.choice("uv"))
    a = [row(f"a{k}") for k in range(90)]
    b = [(f"b{r[0]}", r[1], r[2][1:], r[3], r[4], r[5]) for r in a[:30]] + [row(f"b{k}") for k in range(60)]
    got = pairing.pair_by_sets(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "key", "bucket", SETS, ["kind"], 0.3, 0.1, 0.3, levels=(0.7,))
    assert sorted((r.key_a, r.key_b, pytest.approx(r.score)) for r in got.collect()) == plain(a, b, 0.3)


def test_a_score_that_rounds_up_to_the_least(spark):
    """0.4 / 3 + 0.1 is 0.2333333, 0.5 / 3 + 0.1 is 0.2666667: with six digits 0.266667."""
    a = spark.createDataFrame([("a", "p", ["e", "f", "g"], [], [], "u")], SCHEMA)
    b = spark.createDataFrame([("b", "p", ["e"], [], [], "u")], SCHEMA)
    pair = lambda least: pairing.pair_by_sets(a, b, "key", "bucket", {"x": 0.5, "y": 0.4}, ["kind"], least, 0.1, 0.3, levels=()).collect()
    assert [tuple(r) for r in pair(0.266667)] == [("a", "b", 0.266667)] and not pair(0.266668)


def test_profiles_of_one_mask_are_one_group(spark, monkeypatch):
    """300 x 300 profiles have a bit in common and a rare element each: their pairs are formed where they have that element, or as one pair of
    groups."""
    monkeypatch.setattr(pairing, "WORDS", 1)
    n = 300
    side = lambda name: spark.range(n).select(F.concat(F.lit(name), "id").alias("key"), F.lit("p").alias("bucket"), F.array(F.lit("()V")).alias("x"), F.array(F.concat(F.lit("e"), "id")).alias("y"))
    weights = [0.5, 0.4]
    rows = [pairing.materialize(pairing._prepared(side(s), "key", "bucket", {"x": 0.5, "y": 0.4}, ["bucket"]), "rows") for s in "ab"]
    elements = [pairing._elements(r, 2) for r in rows]
    common = pairing._common(elements)
    profiles = [pairing._profiles(r, e, common, weights)[0] for r, e in zip(rows, elements, strict=True)]
    groups = pairing.group_pairs(profiles, weights, 0.1, 0.0, 0.6).collect()
    assert sum(r.n for r in groups if r.score == 0.6) >= (n - 64) ** 2 and len(groups) <= 65**2
    rare = pairing.rare_pairs([pairing._bounds(p, weights) for p in profiles], profiles, weights, 0.1, 0.0, 0.6).collect()
    assert len(rare) == n - 64 and {r.score for r in rare} == {1.0}
