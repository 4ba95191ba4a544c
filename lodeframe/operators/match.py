"""Structural match: semi-joins on evidence, relational division, orphans, the inverted index and its ranks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from lodeframe.operators.ranking import top_k
from lodeframe.tables import materialize


def semi_all(base: DataFrame, evidences: list[DataFrame], on: list[str]) -> DataFrame:
    """Rows of base that every evidence has a row for."""
    return reduce(lambda df, e: df.join(e.select(*on), on, "left_semi"), evidences, base)


def having_all(facts: DataFrame, key: list[str], value: str, wanted: list) -> DataFrame:
    """Keys that have every wanted value (relational division), in one pass over the facts."""
    return facts.where(F.col(value).isin(*wanted)).groupBy(*key).agg(F.countDistinct(value).alias("_n")).where(F.col("_n") == len(set(wanted))).select(*key)


#: Rows of both sides in one task of orphans().
ORPHAN_ROWS = 1 << 20


def orphans(left: DataFrame, right: DataFrame, on: list[str], left_kind: str, right_kind: str) -> DataFrame:
    """Keys that only one side has, with the side's kind. Both sides are dealt once into tasks of so many rows, which Spark doesn't put
    together again and no side is sent to all, so a task's memory doesn't grow with the tables."""
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), (left.count() + right.count()) // ORPHAN_ROWS + 1)
    left, right = (df.select(*on).repartition(parts, *on).hint("merge") for df in (left, right))
    one = left.join(right.select(*on), on, "left_anti").select(*on, F.lit(left_kind).alias("kind"))
    return one.unionByName(right.join(left.select(*on), on, "left_anti").select(*on, F.lit(right_kind).alias("kind")))


def reverse_top_k(refs: DataFrame, string_col: str, method_col: str, order: list[str], k: int, least: int = 1) -> DataFrame:
    """For each string the number of methods that refer to it and the first k of them. refs: one row for each reference. Pairs are made
    once, so they are counted by rows and their shuffle serves both the counts and the ranks."""
    more = [c for c in dict.fromkeys(order) if c not in (string_col, method_col)]
    pairs = refs.groupBy(string_col, method_col).agg(*[F.min(c).alias(c) for c in more]) if more else refs.select(string_col, method_col).distinct()
    counts = pairs.groupBy(string_col).agg(F.count(method_col).alias("method_count")).where(F.col("method_count") >= least)
    return top_k(pairs, [string_col], [*order, method_col], k).join(counts, string_col)


def anchor_rank(refs: DataFrame, string_col: str, method_col: str) -> DataFrame:
    """Strings by how few methods refer to them: the best anchors first."""
    return refs.groupBy(string_col).agg(F.countDistinct(method_col).alias("method_count")).select(string_col, "method_count").orderBy("method_count", F.length(string_col), string_col)


def with_arity(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """Keys with exactly n rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n)


SPACE = r"\s+"


def contained_in(needles: DataFrame, hay: DataFrame, needle_col: str, hay_col: str) -> DataFrame:
    """Pairs of which the needle's text stands in the hay's.

    What stands between the first and the last space of a needle are whole words of any text that holds it. Only numbers of texts meet
    words: each needle is looked up by the one of its inner words that the fewest texts have, and the texts are joined back for the
    comparison. Needles without an inner word are compared with each text; they must be few, and their size is checked before they are
    sent out.
    """
    words = F.split(F.col(needle_col), SPACE)
    inner = F.array_distinct(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""))
    told = materialize(needles.where(F.length(needle_col) > 0).withColumns({"_needle": F.monotonically_increasing_id(), "_words": inner}), "needles")
    texts = materialize(hay.where(F.length(hay_col) > 0).withColumn("_row", F.monotonically_increasing_id()), "hay")
    index = told.where(F.size("_words") > 0).select("_needle", F.explode("_words").alias("_word"))
    own = texts.select("_row", F.explode(F.array_distinct(F.split(F.col(hay_col), SPACE))).alias("_word"))
    met = materialize(own.join(sized_broadcast(index.select("_word").distinct()), "_word"), "contained-words")
    rarest = index.join(count_by(met, ["_word"], "_n"), "_word").groupBy("_needle").agg(F.min(F.struct("_n", "_word"))["_word"].alias("_word"))
    pairs = met.join(rarest, "_word").select("_row", "_needle")
    fits = F.col(hay_col).contains(F.col(needle_col))
    found = texts.join(pairs, "_row").join(told.drop("_words"), "_needle").where(fits).select(*hay.columns, *needles.columns)
    short = told.where(F.size("_words") == 0).select(*needles.columns)
    if not short.take(1):
        return found
    return found.unionByName(texts.select(*hay.columns).join(sized_broadcast(short), fits))


#: Bytes of rows up to which a side is sent to every executor.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, lists and structs by 64, anything else by 16."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    others = sum(64 if isinstance(f.dataType, (ArrayType, MapType, StructType)) else 16 for f in df.schema)
    return sum(texts, F.lit(others))


def sized_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows hold at most `most` bytes, else as it is."""
    size = df.select(row_bytes(df).alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def count_by(df: DataFrame, keys: list, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_counts(base: DataFrame, key: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """base with the number of rows of each table that have its key, 0 if there are none."""
    counted = reduce(lambda df, kv: df.join(count_by(kv[1], key, kv[0]), key, "left"), tables.items(), base)
    return counted.fillna(0, list(tables))


def with_overloads(df: DataFrame, key: list[str], out: str) -> DataFrame:
    """df with the number of its rows that share a row's key; null is a key. Counted before anything is joined, so no key's rows meet in
    one task."""
    counts = count_by(df, [F.col(c).alias(f"_k{n}") for n, c in enumerate(key)], out)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(key)])
    return df.join(counts, same, "left").select(*df.columns, out)


def probe(refs: DataFrame, sides: list[tuple[DataFrame, str]]) -> DataFrame:
    """References that every side has the key of, with the sides' columns: the probe of an inverted index. Filter the sides before."""
    return reduce(lambda df, side: df.join(side[0], side[1]), sides, refs)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table; a Parquet table answers from its footers."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def ref_count(owners: DataFrame, session: str, owner: str) -> DataFrame:
    return owners.groupBy(session).agg(F.countDistinct(owner).alias("owners"))


def decode(col: Column, names: dict) -> Column:
    """The name of a code; null for codes without one."""
    return reduce(lambda out, kv: out.when(col == kv[0], F.lit(kv[1])), list(names.items())[1:], F.when(col == next(iter(names)), F.lit(next(iter(names.values())))))
