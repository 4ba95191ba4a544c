"""One-to-one pairing of the rows of two tables by a weighted similarity of several sets, without comparing all rows of a bucket.

A score is the sum of the weighted Jaccard similarities of some set columns, and a weight for columns that have to be equal (or a share
of it if they aren't). Rows are paired greedily, best scores first, inside buckets.

1. Profiles. An element that only one side of a bucket has can be in no intersection; of it only the sizes of the sets count. Rows with
   the same other elements and the same sizes score alike against everything, so they are one profile with a number of rows. Thousands
   of rows that differ by names alone are few profiles.
2. Bits and rare elements. The most frequent elements of each set column of a bucket are bits of a profile's mask: what two profiles have
   in common of them is an AND. All others are rare elements, whose numbers ascend with their frequency.
3. Pairs with rare elements in common. An element of a set of n elements adds at most weight / n to a score, so a profile's rare elements
   from a place on and its bits bound what a pair can reach whose first common element stands there. A pair is formed under an element
   only if this bound reaches the least score on both sides, and kept if bits and the numbers of rare elements still allow that score;
   the sets themselves are compared for what is left.
4. Pairs without. These score by their masks alone. Profiles of one mask, equal sizes and equal columns are one group, and each group is
   compared with each of the other side that can reach the least score by its mask, block by block. Where a pair is formed both ways, the
   larger score is the whole one.
5. Levels. Pairs are formed, scored and taken for falling levels of the least score; profiles whose rows are all used leave before the
   next level, so the many pairs of low scores are formed for what is left alone. Pairs of groups are counted by score first, and a level
   is taken in several steps if it would make more than PAIRS pairs.
6. Greedy rounds. Pairs of profiles are taken by score, then by a digest of both names; in one round all those are taken that are the
   best left of both their profiles. A pair takes as many rows as both still have, in order of their keys.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators.ranking import top_k
from lodeframe.tables import materialize

#: Least scores at which pairs are formed, before the caller's own.
LEVELS = (0.85, 0.65)
#: Scores are rounded to six digits.
SLACK = 1e-6
#: Words of 64 bits in the mask of a set column.
WORDS = 2
#: Pairs by masks alone that a step makes, but for those of one STEP of the score.
PAIRS = 16_000_000
STEP = 0.005
#: Groups of a side in a block.
BLOCK = 2_000
AT = ["_bucket", "_part", "_element"]


def _prepared(df: DataFrame, key: str, bucket: str, sets: dict[str, float], same: list[str]) -> DataFrame:
    """_id, _key, _bucket, a set column s0, s1, ... for each of `sets`, and _same."""
    place = F.coalesce(F.concat(F.lit("="), F.col(bucket).cast("string")), F.lit(""))
    arrays = [F.coalesce(F.array_distinct(F.col(c)), F.array().cast("array<string>")).alias(f"s{k}") for k, c in enumerate(sets)]
    return df.where(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_key"), place.alias("_bucket"), *arrays, F.to_json(F.struct(*same)).alias("_same"))


def _elements(df: DataFrame, n: int) -> DataFrame:
    """A row (_id, _bucket, _part, _element) for each element of each set."""
    parts = [df.select("_id", "_bucket", F.lit(k).alias("_part"), F.explode(f"s{k}").alias("_element")) for k in range(n)]
    return reduce(DataFrame.union, parts)


def _common(elements: list[DataFrame]) -> DataFrame:
    """The elements that both sides of a bucket have, with a number _e that ascends with their frequency, and the _bit (from 0) of the most
    frequent."""
    counts = [x.groupBy(*AT).agg(F.count(F.lit(1)).alias(f"_n{s}")) for s, x in zip("ab", elements, strict=True)]
    both = counts[0].join(counts[1], AT).orderBy(F.col("_na") + F.col("_nb"))
    both = materialize(both.withColumn("_e", F.monotonically_increasing_id()), "pairing-common")
    often = top_k(both, ["_bucket", "_part"], [(F.col("_na") * F.col("_nb")).desc(), "_e"], 64 * WORDS).select("_e", (F.col("rn") - 1).cast("int").alias("_bit"))
    return materialize(both.drop("_na", "_nb").join(often, "_e", "left"), "pairing-bits")


def _masks(n: int) -> list[str]:
    return [f"m{k}_{w}" for k in range(n) for w in range(WORDS)]


def _bits(k: int, end: str = "", other: str | None = None) -> Column:
    """How many bits the mask of set k has, alone or in common with the mask of the other end."""
    words = [F.col(f"m{k}_{w}{end}") if other is None else F.col(f"m{k}_{w}{end}").bitwiseAND(F.col(f"m{k}_{w}{other}")) for w in range(WORDS)]
    return reduce(Column.__add__, [F.bit_count(w) for w in words])


def _most(k: int, weight: float) -> Column:
    """What an element of set k adds to a score at most."""
    return F.when(F.col(f"n{k}") > 0, F.lit(weight) / F.col(f"n{k}")).otherwise(F.lit(0.0))


def _profiles(df: DataFrame, elements: DataFrame, common: DataFrame, weights: list[float]) -> tuple[DataFrame, DataFrame]:
    """Profiles: _p, ascending with the least key _name, _bucket, _same, sizes n0, n1, ..., masks m0_0, ..., rare elements t0, t1, ... and
    their numbers r0, r1, ..., the number of rows _left, the group _g (its least _p) and what bits add to a score at most (_reach).
    Members: _key, _p and _rank (from 0) of each row."""
    n = len(weights)
    bit = lambda k, w: (F.col("_part") == k) & F.col("_bit").between(64 * w, 64 * w + 63)
    masks = [F.bit_or(F.when(bit(k, w), F.expr("shiftleft(1L, _bit % 64)"))).alias(f"m{k}_{w}") for k in range(n) for w in range(WORDS)]
    rare = [F.sort_array(F.collect_list(F.when((F.col("_part") == k) & F.col("_bit").isNull(), F.col("_e")))).alias(f"t{k}") for k in range(n)]
    own = elements.join(common, AT).groupBy("_id").agg(*masks, *rare)
    rows = df.select("_id", "_key", "_bucket", "_same", *[F.size(f"s{k}").alias(f"n{k}") for k in range(n)]).join(own, "_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in _masks(n)} | {f"t{k}": F.coalesce(f"t{k}", F.array().cast("array<bigint>")) for k in range(n)})
    alike = ["_bucket", "_same", *[f"n{k}" for k in range(n)], *_masks(n)]
    like = [*alike, *[f"t{k}" for k in range(n)]]
    rows = materialize(rows.withColumn("_like", F.sha2(F.to_json(F.struct(*like)), 256)), "pairing-rows")
    least = rows.groupBy("_like").agg(F.min(F.struct("_key", "_id")).alias("_first"), F.count(F.lit(1)).alias("_left"))
    made = rows.join(least.select(F.col("_first._id").alias("_id"), "_left"), "_id").withColumnRenamed("_key", "_name").drop("_id")
    made = made.orderBy("_name").withColumn("_p", F.monotonically_increasing_id())
    made = made.withColumn("_g", F.min("_p").over(Window.partitionBy(*alike))).withColumns({f"r{k}": F.size(f"t{k}") for k in range(n)})
    profiles = materialize(made.withColumn("_reach", reduce(Column.__add__, [_most(k, w) * _bits(k) for k, w in enumerate(weights)])), "pairing-profiles")
    rank = F.row_number().over(Window.partitionBy("_like").orderBy("_key")) - 1
    return profiles.drop("_like"), rows.select("_key", "_like", rank.alias("_rank")).join(profiles.select("_like", "_p"), "_like").drop("_like")


def _bounds(profiles: DataFrame, weights: list[float]) -> DataFrame:
    """_p, _e and _rest, what a rare element and all that come after it add to a score at most."""
    each = reduce(DataFrame.union, [profiles.select("_p", "_reach", F.explode(f"t{k}").alias("_e"), _most(k, w).alias("_w")) for k, w in enumerate(weights)])
    later = Window.partitionBy("_p").orderBy(F.desc("_e")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("_p", "_e", (F.sum("_w").over(later) + F.col("_reach")).alias("_rest"))


def _sum_of(weights: list[float], same_weight: float, other: float, common: list[Column]) -> Column:
    """The score of sides a and b with so many elements in common, before it is rounded: that takes longer than all the rest."""
    out = F.lit(0.0)
    for k, (w, c) in enumerate(zip(weights, common, strict=True)):
        union = F.col(f"n{k}_a") + F.col(f"n{k}_b") - c
        out = out + F.lit(w) * F.when(union > 0, c / union).otherwise(F.lit(0.0))
    return out + F.lit(same_weight) * F.when(F.col("_same_a") == F.col("_same_b"), 1.0).otherwise(F.lit(other))


def _counted(pairs: DataFrame, common: list[Column]) -> tuple[DataFrame, list[Column]]:
    """Pairs with these numbers, each made once, and their columns. Spark makes them anew wherever a filter or a sum names them, in methods too
    large to be compiled, but not behind an explode."""
    pairs = pairs.withColumn("_c", F.explode(F.array(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(common)]))))
    return pairs, [F.col(f"_c.c{k}") for k in range(len(common))]


def score_of(weights: list[float], same_weight: float, other: float) -> Column:
    """The score of profiles with whole sets k0, k1, ... in columns ending in _a and _b."""
    return F.round(_sum_of(weights, same_weight, other, [F.size(F.array_intersect(f"k{k}_a", f"k{k}_b")) for k in range(len(weights))]), 6)


def candidate_pairs(a: DataFrame, b: DataFrame, profiles: tuple[DataFrame, DataFrame], weights: list[float], same_weight: float, other: float, least: float) -> DataFrame:
    """(pa, pb, score) of all pairs of profiles with whole sets that have a score of at least `least`. a, b: the bounded elements of both
    sides.

    Sets go with the elements, and a pair is scored where it is formed, under the least element that both sides can be met by. So what is
    shuffled grows with the elements, and of the pairs only those that reach the least score leave their task."""
    need = least - same_weight - SLACK
    tag = F.concat(F.col("_part").cast("string"), F.lit(":"), F.col("_element"))
    rows = []
    for x, p, s in zip((a, b), profiles, "ab", strict=True):
        own = x.where(F.col("_rest") >= need).select("_bucket", "_part", "_element", F.col("_profile").alias(f"p{s}"))
        under = own.groupBy(f"p{s}").agg(F.collect_list(tag).alias(f"under_{s}"))
        side = p.select(F.col("_profile").alias(f"p{s}"), *[F.col(c).alias(f"{c}_{s}") for c in p.columns if c not in ("_profile", "_bucket", "_left", "_like")])
        rows.append(own.join(under, f"p{s}").join(side, f"p{s}"))
    once = F.array_min(F.array_intersect("under_a", "under_b")) == tag
    met = rows[0].join(rows[1], ["_bucket", "_part", "_element"]).where(once)
    return met.select("pa", "pb", score_of(weights, same_weight, other).alias("score")).where(F.col("score") >= least)


def _ends(df: DataFrame, end: str, columns: list[str]) -> DataFrame:
    """p{end} and other columns with the end of a side."""
    return df.select(F.col("_p").alias(f"p{end}"), *[F.col(c).alias(f"{c}_{end}") for c in columns])


def rare_pairs(bounds: list[DataFrame], profiles: list[DataFrame], weights: list[float], same_weight: float, other: float, least: float) -> DataFrame:
    """(pa, pb, score) of all pairs with a score of at least `least` whose first common element is a rare one; others with rare elements in
    common may be there too. What is shuffled for the pairs that are formed is two numbers of each that its masks and sizes allow."""
    n = len(weights)
    slim = ["_same", *[f"{c}{k}" for k in range(n) for c in "nr"], *_masks(n)]
    sides = []
    for x, p, s in zip(bounds, profiles, "ab", strict=True):
        own = x.where(F.col("_rest") >= least - same_weight - SLACK).select("_e", F.col("_p").alias(f"p{s}"))
        sides.append(own.join(_ends(p, s, slim), f"p{s}"))
    bits = [_bits(k, "_a", "_b") for k in range(n)]
    met, most = _counted(sides[0].join(sides[1], "_e"), [b + F.least(f"r{k}_a", f"r{k}_b") for k, b in enumerate(bits)])
    met = met.where(_sum_of(weights, same_weight, other, most) >= least - SLACK).select("pa", "pb").distinct()
    for p, s in zip(profiles, "ab", strict=True):
        met = met.join(_ends(p, s, ["_same", *[f"{c}{k}" for k in range(n) for c in "nt"], *_masks(n)]), f"p{s}")
    met, common = _counted(met, [b + F.size(F.array_intersect(f"t{k}_a", f"t{k}_b")) for k, b in enumerate(bits)])
    return met.select("pa", "pb", F.round(_sum_of(weights, same_weight, other, common), 6).alias("score")).where(F.col("score") >= least)


def group_pairs(profiles: list[DataFrame], weights: list[float], same_weight: float, other: float, least: float) -> DataFrame:
    """(ga, gb, score, n) of all pairs of groups with a score of at least `least` by their masks, and their number of pairs of profiles."""
    n = len(weights)
    columns = ["_bucket", "_same", *[f"n{k}" for k in range(n)], *_masks(n)]
    groups = [p.where(F.col("_reach") + same_weight >= least - SLACK).groupBy("_g", *columns).agg(F.count(F.lit(1)).alias("_n")) for p in profiles]
    blocks = [g.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"_blocks_{s}")) for g, s in zip(groups, "ab", strict=True)]
    grid = blocks[0].join(blocks[1], "_bucket")
    sides = []
    for g, s, o in zip(groups, "ab", "ba", strict=True):
        placed = g.join(grid, "_bucket").withColumn(f"_block_{s}", F.pmod(F.xxhash64("_g"), F.col(f"_blocks_{s}")).cast("int"))
        placed = placed.withColumn(f"_block_{o}", F.explode(F.sequence(F.lit(0), F.col(f"_blocks_{o}") - 1)))
        sides.append(placed.select("_bucket", "_block_a", "_block_b", F.col("_g").alias(f"g{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("_n", *columns[1:])]))
    met, common = _counted(sides[0].join(sides[1], ["_bucket", "_block_a", "_block_b"]), [_bits(k, "_a", "_b") for k in range(n)])
    score = _sum_of(weights, same_weight, other, common)
    met = met.where(score >= least - SLACK).withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    return met.select("ga", "gb", "score", (F.col("_n_a") * F.col("_n_b")).alias("n"))


def _next_level(groups: DataFrame, least: float, before: float | None) -> float:
    """The least score down to which groups make PAIRS pairs at most, or those of one STEP."""
    unit = round(STEP * 1e6)
    found = groups if before is None else groups.where(F.col("score") < before)
    counts = found.groupBy(F.floor(F.round(F.col("score") * 1e6) / unit).alias("step")).agg(F.sum("n").alias("n")).collect()
    total, level = 0, None
    for step, number in sorted(((r.step, r.n) for r in counts), reverse=True):
        total += number
        if total > PAIRS and level is not None:
            return max(least, level)
        level = step * unit / 1e6
    return least


def _take(pairs: DataFrame) -> list[DataFrame]:
    """Greedy rounds over all pairs: (pa, pb, score, _order) with the rows that each side has left (left_a, left_b) and has used (from_a,
    from_b). Returns tables (pa, pb, score, from_a, from_b, n), one for each round. A round is one plan: its pairs carry what it changes."""
    taken = []
    while True:
        best = [F.row_number().over(Window.partitionBy(f"p{s}").orderBy(F.desc("score"), "_order", "pa", "pb")) for s in "ab"]
        now = pairs.withColumns({"_a": best[0], "_b": best[1]}).withColumn("n", F.when((F.col("_a") == 1) & (F.col("_b") == 1), F.least("left_a", "left_b")))
        used = {s: F.coalesce(F.max("n").over(Window.partitionBy(f"p{s}")), F.lit(0)) for s in "ab"}
        now = now.withColumns({f"used_{s}": u for s, u in used.items()})
        stored = materialize(now.drop("_a", "_b"), "pairing-round")
        taken.append(stored.where("n IS NOT NULL").select("pa", "pb", "score", "from_a", "from_b", "n"))
        rest = stored.where("n IS NULL AND left_a > used_a AND left_b > used_b")
        if not rest.take(1):
            return taken
        pairs = rest.select("pa", "pb", "score", "_order", *[e for s in "ab" for e in ((F.col(f"left_{s}") - F.col(f"used_{s}")).alias(f"left_{s}"), (F.col(f"from_{s}") + F.col(f"used_{s}")).alias(f"from_{s}"))])


def pair_by_sets(a: DataFrame, b: DataFrame, key: str, bucket: str, sets: dict[str, float], same: list[str], least: float, same_weight: float = 0.0, other: float = 0.0, levels: Iterable[float] = LEVELS) -> DataFrame:
    """(key_a, key_b, score): rows of a and b in the same bucket (null is one), each used once, with a score of at least `least`.

    sets: array<string> columns and their weights. same: columns that add same_weight if all are equal on both sides, else `other` of it.
    """
    weights, n = list(sets.values()), len(sets)
    if least - same_weight <= SLACK:
        raise ValueError("the least score must be more than what equal columns give alone")
    sides = [materialize(_prepared(x, key, bucket, sets, same), "pairing-input") for x in (a, b)]
    elements = [_elements(x, n) for x in sides]
    common = _common(elements)
    made = [_profiles(x, e, common, weights) for x, e in zip(sides, elements, strict=True)]
    profiles, members = [m[0] for m in made], [m[1] for m in made]
    bounds = [materialize(_bounds(p, weights), "pairing-bounds") for p in profiles]
    left = [p.select("_p", "_name", "_g", "_left", F.lit(0).cast("long").alias("_used")) for p in profiles]
    scored, taken = (weights, same_weight, other), []
    for level in [*(x for x in levels if x > least), least]:
        open_ = [p.drop("_left").join(x.select("_p"), "_p", "left_semi") for p, x in zip(profiles, left, strict=True)]
        rare = materialize(rare_pairs(bounds, open_, *scored, level), "pairing-rare")
        now = None
        while now != level:
            open_ = [p.drop("_left").join(x.select("_p"), "_p", "left_semi") for p, x in zip(profiles, left, strict=True)]
            groups = group_pairs(open_, *scored, level)
            now = _next_level(groups, level, now)
            pairs = groups.where(F.col("score") >= now).drop("n")
            for x, s in zip(left, "ab", strict=True):
                pairs = pairs.join(x.select(F.col("_g").alias(f"g{s}"), F.col("_p").alias(f"p{s}")), f"g{s}")
            pairs = pairs.select("pa", "pb", "score").union(rare.where(F.col("score") >= now)).groupBy("pa", "pb").agg(F.max("score").alias("score"))
            for x, s in zip(left, "ab", strict=True):
                pairs = pairs.join(x.select(F.col("_p").alias(f"p{s}"), F.col("_name").alias(f"_name_{s}"), F.col("_left").alias(f"left_{s}"), F.col("_used").alias(f"from_{s}")), f"p{s}")
            rounds = _take(pairs.withColumn("_order", F.md5(F.concat_ws("|", "_name_a", "_name_b"))).drop("_name_a", "_name_b"))
            taken += rounds
            if now > least:
                sums = materialize(reduce(DataFrame.union, rounds).select("pa", "pb", "n"), "pairing-used")
                more = [sums.groupBy(F.col(f"p{s}").alias("_p")).agg(F.sum("n").alias("_n")) for s in "ab"]
                got = F.coalesce("_n", F.lit(0))
                left = [materialize(x.join(m, "_p", "left").where(F.col("_left") > got).select("_p", "_name", "_g", (F.col("_left") - got).alias("_left"), (F.col("_used") + got).alias("_used")), "pairing-left") for x, m in zip(left, more, strict=True)]
    runs = reduce(DataFrame.union, taken)
    each = runs.select("pa", "pb", "score", "from_a", "from_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_i"))
    for m, s in zip(members, "ab", strict=True):
        named = m.select(F.col("_p").alias(f"p{s}"), F.col("_rank").cast("long").alias(f"_rank_{s}"), F.col("_key").alias(f"key_{s}"))
        each = each.withColumn(f"_rank_{s}", F.col(f"from_{s}") + F.col("_i")).join(named, [f"p{s}", f"_rank_{s}"])
    return each.select("key_a", "key_b", "score")
