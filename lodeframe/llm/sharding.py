"""Sharding by longest-processing-time scheduling: groups that stay together, sorted by size, go to the least-loaded shard.

Documents with equal texts are one group, known by the 128-bit digest of the text. All groups, large and small, are scheduled: the
driver needs only how many groups there are of each size, as groups of one size can stand for each other. Distinct sizes add up to the
whole table at most, so there are less than sqrt(2 * bytes) of them (245,000 for 30 GB). From the largest size down, a heap hands a run
of equal groups to the least-loaded shards; a long run is cut by a search for the level that it fills the shards to, which gives what the
heap would give group by group. Each group then takes the shard of its place among the groups of its size.

Slots number the rows of a shard without gaps, in order of a hash of id and text, or in an order that the caller gives. Places and slots
are running sums in two levels (common.running_sum): no shard, size or group of copies is in one task.

Defined cases: a null text has size 1 and all null texts are a group; empty texts are another; an empty table gives an empty result;
repeated rows get different slots of one shard; groups of equal size are in order of their digest's hash; a text of any length is one
row, of which only size and digests are kept; columns of docs that are named like a result don't matter, as the result has its own only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import join_heavy, load, materialize, named, range_shift, running_sum

SHARDS = 16
#: A run of this many groups for each shard is cut by a search; shorter ones go through the heap.
LONG_RUN = 8


def _level(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` equal groups each shard gets if each goes to the least-loaded one (of equals, the first)."""
    low, high = min(loads), min(loads) + size * count
    taken = lambda top: [max(0, (top - held) // size + 1) for held in loads]
    while low < high:
        mid = (low + high) // 2
        if sum(taken(mid)) >= count:
            high = mid
        else:
            low = mid + 1
    # Groups that start below the level are all given; those that start at it go to the first shards that are there.
    given = taken(low - 1)
    for k, held in enumerate(loads):
        if sum(given) < count and held + given[k] * size == low:
            given[k] += 1
    return given


def longest_first(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """sizes: (size, number of groups). For each size, largest first: the size, shards, and for each of them the place after the last of its
    groups among the groups of that size."""
    loads, out = [0] * shards, []
    heap = [(0, k) for k in range(shards)]
    for size, count in sorted(sizes, reverse=True):
        if count >= LONG_RUN * shards:
            given = dict(enumerate(_level(loads, size, count)))
            for k, n in given.items():
                loads[k] += n * size
            heap = [(held, k) for k, held in enumerate(loads)]
            heapq.heapify(heap)
        else:
            given = {}
            for _ in range(count):
                held, k = heap[0]
                loads[k] = held + size
                heapq.heapreplace(heap, (held + size, k))
                given[k] = given.get(k, 0) + 1
        some = sorted(k for k, n in given.items() if n)
        out.append((size, some, np.cumsum([given[k] for k in some]).tolist()))
    return out


def _schedule(spark: SparkSession, groups: DataFrame, shards: int) -> DataFrame:
    """(bytes, shards, upto) of each group size."""
    counted = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    plan = longest_first(list(zip(counted["bytes"].to_pylist(), counted["n"].to_pylist(), strict=True)), shards)
    schema = pa.schema([("bytes", pa.int64()), ("shards", pa.list_(pa.int32())), ("upto", pa.list_(pa.int64()))])
    columns = [list(c) for c in zip(*plan, strict=True)] if plan else [[], [], []]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    return spark.createDataFrame(table)


def assign_shards(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id", order: tuple[Column, int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs. order: (a long column, a number of bits) for slots in that column's
    order, where a few thousand rows share a value of column >> bits."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = docs.sparkSession
    text, raw = named(text_col), named(text_col).cast("binary")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(23), named(id_col), text), 1) if order is None else order[0]
    rows = docs.select(
        named(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.md5(raw), F.lit("null")).alias("_group"),
        key.alias("_order"),
        F.spark_partition_id().alias("_part"),
        F.lit(1).cast("long").alias("_one"),
    )
    slim = materialize(rows, "sharding-rows")
    each = slim.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("_copies"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(29), "_group"), 1)
    groups = materialize(each.select("*", place.alias("_place"), F.lit(0).alias("_part"), F.lit(1).cast("long").alias("_one")), "sharding-groups")
    told = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_copies"), F.lit(0))).first()

    ranked = running_sum(groups, ["bytes"], "_place", "_one", "_rank", range_shift(told[0])).select("_group", "_copies", "bytes", "_rank")
    # Sizes that a large part of all groups has meet the schedule by the heavy path.
    schedule = _schedule(spark, groups, shards).withColumn("_groups", F.element_at("upto", -1))
    with_plan = join_heavy(ranked, schedule, "bytes", told[0], "_groups")
    shard = F.get("shards", F.size(F.filter("upto", lambda end: end <= F.col("_rank"))))
    placed = materialize(with_plan.select("_group", "_copies", shard.alias("shard")), "sharding-placed")

    dealt = join_heavy(slim, placed, "_group", told[1], "_copies")
    dealt = materialize(dealt.select("doc_id", "size", "text_crc32", "shard", "_order", "_part", "_one"), "sharding-dealt")
    shift = range_shift(told[1]) if order is None else order[1]
    return running_sum(dealt, ["shard"], "_order", "_one", "slot", shift).select("doc_id", "size", "text_crc32", "shard", "slot")


def as_rows(placed: DataFrame) -> DataFrame:
    """The result columns of the registered queries."""
    return placed.select(
        "doc_id",
        "size",
        F.coalesce("text_crc32", F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_rows(assign_shards(load(spark, sf_dir, "documents")))
