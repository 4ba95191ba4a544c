"""Comparison of two versions: features, unchanged keys, pairs of equal structure, best fuzzy pairs and a one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.text import jaccard
from lodeframe.operators.ranking import first_wins
from lodeframe.tables import materialize

#: Weights of the parts of a score, and what is left of the last part if interfaces or kinds differ.
WEIGHTS = {"shape": 0.30, "strings": 0.33, "fields": 0.15, "names": 0.12, "interfaces": 0.10}
OTHER_INTERFACES = 0.3


def feature_hash(rows: DataFrame, key: list[str], signature: Column, out: str = "sig_hash") -> DataFrame:
    """For each key a digest of its sorted signatures."""
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(signature)).alias("_s")).select(*key, F.sha2(F.array_join("_s", "|"), 256).alias(out))


def unchanged(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def added_removed(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    gone = a.select(*key).distinct().join(b.select(*key), key, "left_anti").withColumn("kind", F.lit("removed"))
    return gone.unionByName(b.select(*key).distinct().join(a.select(*key), key, "left_anti").withColumn("kind", F.lit("added")))


def exact_pairs(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys of a and b that are the only ones of their digest on their side."""
    one = lambda df, name: df.groupBy(digest).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(name)).where("_n = 1").drop("_n")
    return one(a, "key_a").join(one(b, "key_b"), digest)


def candidates(a: DataFrame, b: DataFrame, key: str, bucket: str, score: Column, least: float) -> DataFrame:
    """Pairs in the same bucket with a score of at least `least`. In `score`, columns of a end in _a, those of b in _b."""
    left = a.select(F.col(bucket), *[F.col(c).alias(f"{c}_a") for c in a.columns if c != bucket])
    right = b.select(F.col(bucket), *[F.col(c).alias(f"{c}_b") for c in b.columns if c != bucket])
    return left.join(right, left[bucket].eqNullSafe(right[bucket])).drop(right[bucket]).withColumn("score", score).where(F.col("score") >= least)


def best_of(pairs: DataFrame, key: str = "key_b", other: str = "key_a") -> DataFrame:
    """The best pair of each key."""
    return first_wins(pairs, [key], [F.col("score").desc(), other])


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs (key_a, key_b, score) so that each key is used once: round by round, the pairs that are the best of both their keys.

    This is the greedy assignment by (score descending, key_a, key_b): a pair that is best for both its keys would be taken before any
    other pair of either. The rounds end as each takes at least the best pair of all that are left.
    """
    keep = lambda df: materialize(df, "assignment")
    left = keep(pairs.select("key_a", "key_b", "score"))
    out = left.limit(0)
    while left.take(1):
        best_a = first_wins(left, ["key_a"], [F.col("score").desc(), "key_b"])
        best_b = first_wins(left, ["key_b"], [F.col("score").desc(), "key_a"])
        taken = keep(best_a.join(best_b.select("key_a", "key_b"), ["key_a", "key_b"], "left_semi"))
        out = out.unionByName(taken)
        left = keep(left.join(taken.select("key_a"), "key_a", "left_anti").join(taken.select("key_b"), "key_b", "left_anti"))
    return out


def class_score(shape: str = "named") -> Column:
    """The score of two classes from columns sigs, shapes, strings, field_names, method_names, interfaces and kind of both sides.

    shape "named" compares method signatures with their names, "structural" without.
    """
    sigs = "sigs" if shape == "named" else "shapes"
    same = (F.size("interfaces_a") == F.size("interfaces_b")) & (F.col("kind_a") == F.col("kind_b"))
    parts = {"shape": jaccard(F.col(f"{sigs}_a"), F.col(f"{sigs}_b")), "strings": jaccard(F.col("strings_a"), F.col("strings_b")), "fields": jaccard(F.col("field_names_a"), F.col("field_names_b")), "names": jaccard(F.col("method_names_a"), F.col("method_names_b")), "interfaces": F.when(same, 1.0).otherwise(OTHER_INTERFACES)}
    out = F.lit(0.0)
    for name, part in parts.items():
        out = out + F.lit(WEIGHTS[name]) * part
    return F.round(out, 6)
