"""Orders, limits and windows. Every order ends in a natural key, so that ties fall the same way on each run."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.errors import bad_argument
from lodeframe.tables import materialize

DEFAULT_LIMIT, MOST = 50, 200


def clamp_limit(limit: int | str | None, default: int = DEFAULT_LIMIT, most: int = MOST) -> int:
    try:
        n = int(limit if limit is not None else default)
    except (TypeError, ValueError) as e:
        raise bad_argument(f"limit must be a number, not {limit!r}") from e
    return default if n <= 0 else min(n, most)


def top_k(df: DataFrame, part: list[str], order: list, k: int, rank_col: str = "rn") -> DataFrame:
    """The first k rows of each part. Spark stops a part's sort early (WindowGroupLimit) before and after the shuffle."""
    return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(rank_col) <= k).withColumn(rank_col, F.col(rank_col).cast("long"))


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first by order."""
    return top_k(df, key, order, 1, "_rn").drop("_rn")


def content_groups(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """Rows of equal content as one: its digest (sha), the least key and the number of copies."""
    return df.groupBy(F.sha2(F.col(text_col).cast("binary"), 256).alias("sha")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, key, [F.col(c).desc() for c in order])


def within_budget(df: DataFrame, text_col: str, order: list, budget: int, part: list[str] | None = None) -> DataFrame:
    """The leading rows whose bytes add up to the budget at most, with their running sum.

    No part is run through in one task: rows are dealt into ranges of (part, order), bytes are added up for each range, and only ranges
    that begin within the budget are looked at row by row. Non-string texts and nulls count no bytes.
    """
    part = part or []
    sized = df.withColumn("bytes", F.octet_length(text_col).cast("long"))
    ranged = materialize(sized.repartitionByRange(*part, *order).withColumn("_range", F.spark_partition_id()), "budget")
    sums = ranged.groupBy(*part, "_range").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum").where(F.col("_before") <= budget)
    inside = Window.partitionBy(*part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.col("_before") + F.sum(F.coalesce("bytes", F.lit(0))).over(inside)
    # A null part is a part.
    starts = starts.toDF(*[f"_k{k}" for k in range(len(part) + 1)], "_before")
    same = reduce(and_, [ranged[c].eqNullSafe(starts[f"_k{k}"]) for k, c in enumerate([*part, "_range"])])
    found = ranged.join(starts, same).withColumn("running", running).where(F.col("running") <= budget)
    return found.select(*sized.columns, "running")
