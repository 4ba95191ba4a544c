"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target number of words: `share` times all words, by weight, at most `cap` times the source's own words; what a
source can't take is shared again by weight until no target is above its cap (the water level is found in closed form from one sorted
pass over the sources). Weights and schedules repeat over the sources in code-point order, a null source last.

Inside a source the documents stand in order of a hash of their id and text, which depends on nothing else. A target of r times the
source is floor(r) passes over all of it and a last pass that ends where the target is reached. Documents are copied whole: the plan
counts the document at that end in part, so that planned words add up to the rounded target, and the mix has it once more if at least
half of it is planned. Words that the mix takes so miss a target by at most half of that one document; `taken` of the mix counts
what is really in it.

A word's place in this sequence, divided by the target, is the source's cumulative demand; the integral of the source's weight
schedule over training time is inverted at that demand, which gives the training position, and documents are range-sorted by it.

Sizes are counted once, as the table is written to the shared folder. Running sums never gather a source, or the copies of one
document, in one task (common.running_sum).

Defined cases: a null text or one without words has size 0 and takes no words; a source without words has target 0; an empty table
gives an empty result; repeated rows follow each other and are taken one by one; equal positions are in order of source, place and
hash; a text of any length is one document, and counted where it stands. The input row travels as one struct, so no column of it is
mistaken for one of the operator's; input columns that are named like a column of the result (mix, copy, position) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import load, materialize, named, packed, range_shift, running_sum, shuffle_parts, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Weight over training time, as (time, weight) knots with straight lines between them: early, even, late.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
WORD = r"[^\x20\x09-\x0D]+"
NEW = ("mix", "copy", "position")


def _areas(knots) -> list[float]:
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if not t1 > t0 or min(w0, w1) < 0:
            raise ValueError("knots need rising times and weights that are not negative")
        out.append(out[-1] + (w0 + w1) / 2 * (t1 - t0))
    if not out[-1] > 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    return out


def invert_demand(knots, demand: Column) -> Column:
    """The time at which the integral of the schedule has reached `demand`, a share from 0 to 1 of the whole integral."""
    areas = _areas(knots)
    c = demand * F.lit(areas[-1])
    out = F.lit(float(knots[-1][0]))
    for k in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope = (w1 - w0) / (2 * (t1 - t0))
        own = F.greatest(c - F.lit(areas[k]), F.lit(0.0))
        root = F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(float(w0 * w0)) + own * F.lit(4 * slope), F.lit(0.0)))
        time = F.lit(float(t0)) + F.when(root > 0, 2 * own / root).otherwise(F.lit(0.0))
        out = F.when(c <= F.lit(areas[k + 1]), time).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (_source, source, source_size), a row for each source. Returns _source, source_size, rank (from 0) and target."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # One row for each source: the only windows over a whole table are over these rows.
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_most", F.col("source_size") * F.lit(float(cap))).withColumn("_level", F.col("_most") / F.col("_w"))
    before = Window.orderBy("_level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    open_ = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_rest", rest).withColumn("_open", open_)
    level = F.when(F.col("_rest") / F.col("_open") <= F.col("_level"), F.col("_rest") / F.col("_open"))
    ranked = ranked.withColumn("_lambda", level).withColumn("_lambda", F.max("_lambda").over(every))
    target = F.when(F.col("_lambda").isNull(), F.col("_most")).otherwise(F.least("_most", F.col("_lambda") * F.col("_w")))
    return ranked.select("_source", "source_size", "rank", target.alias("target"))


def _planned(docs: DataFrame, keep: list[str], source_col: str, text_col: str, id_col: str, weights, share: float, cap: float) -> DataFrame:
    """_doc, mix and _order of each row."""
    text, source = named(text_col), named(source_col).cast("string")
    order = F.shiftrightunsigned(F.xxhash64(F.lit(17), named(id_col), text), 1)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(
        packed(docs, keep),
        size.alias("_size"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("_source"),
        order.alias("_order"),
        F.spark_partition_id().alias("_part"),
    )
    stored = materialize(sized, "mixing-sized")
    totals = stored.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    name = F.when(F.col("_source") != "n", F.substring("_source", 2, 1 << 30))
    totals = materialize(totals.withColumn("source", name), "mixing-sources")
    rows = totals.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    placed = running_sum(stored, ["_source"], "_order", "_size", "_start", range_shift(rows))
    # A row for each source, joined by key: AQE broadcasts it while it is small.
    out = placed.join(source_targets(totals, weights, share, cap), "_source")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("_passes", passes)
    out = out.withColumn("_want", F.round(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long"))
    out = out.withColumn("_extra", F.least("_size", F.greatest(F.lit(0), F.col("_want") - F.col("_start"))))
    mix = F.struct(
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_passes") * F.col("_size") + F.col("_extra")).alias("taken"),
        "rank",
        F.col("_passes").alias("passes"),
        F.col("_start").alias("start"),
        F.col("_extra").alias("extra"),
        (F.col("_start") < F.col("_want")).alias("open"),
    )
    return out.select("_doc", mix.alias("mix"), "_order")


def plan_mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs with a struct column mix: size, source_size, target, taken, rank, passes (whole passes over the source), start (words of
    the source before this document), extra (words taken of it in the last pass) and open (whether the last pass reaches it)."""
    planned = _planned(docs, docs.columns, source_col, text_col, id_col, weights, share, cap)
    return planned.select(*unpacked(docs.columns, ("mix",)), "mix")


def _position(copy: Column, schedules) -> Column:
    """Where copy number `copy` of a planned document stands in training time."""
    m = F.col("mix")
    at = copy * m["source_size"] + m["start"] + F.when(copy < m["passes"], m["size"]).otherwise(m["extra"]) / 2
    demand = F.least(F.lit(1.0), F.when(m["target"] > 0, at / m["target"]).otherwise(F.lit(0.0)))
    place = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        place = F.when(m["rank"] % len(schedules) == k, invert_demand(knots, demand)).otherwise(place)
    return place


def _times() -> Column:
    """How often the mix has a planned document: the one at the end of a source's last pass if at least half of it is planned."""
    m = F.col("mix")
    return m["passes"] + F.when(m["open"] & (m["extra"] * 2 >= m["size"]), 1).otherwise(0)


def mix_documents(docs: DataFrame, schedules=SCHEDULES, parts: int | None = None, rest: bool = False, keep: list[str] | None = None, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The documents of the mix in training order, as often as they are taken, with their `position` in training time (0 to 1), the number
    of the `copy` (from 0) and `mix` of the plan, where `taken` is the words of this copy. The one document at the end of a source's last
    pass is there if at least half of it is planned. Partitions are ranges of positions, sorted. rest: documents that the mix doesn't take
    are there too, with null copy and position, before the others. keep: the columns of docs that are returned, all if not given."""
    keep = docs.columns if keep is None else keep
    planned = _planned(docs, keep, source_col, text_col, id_col, weights, share, cap)
    explode = F.explode_outer if rest else F.explode
    copies = planned.withColumn("copy", explode(F.when(_times() > 0, F.sequence(F.lit(0), _times() - 1))))
    taken = F.when(F.col("copy").isNotNull(), F.col("mix.size")).otherwise(F.lit(0))
    placed = copies.withColumn("position", F.when(F.col("copy").isNotNull(), _position(F.col("copy"), schedules))).withColumn("mix", F.col("mix").withField("taken", taken))
    order = ["position", "mix.rank", "mix.start", "_order"]
    ranged = placed.repartitionByRange(parts or shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select(*unpacked(keep, NEW), "mix", "copy", "position")


def mix_schedule(docs: DataFrame, schedules=SCHEDULES, parts: int | None = None, keep: list[str] | None = None, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row for each document, taken or not, with `mix` of the plan, where `taken` is the words of all its copies, and the `positions` of
    those copies in training time (none: an empty array). Partitions are ranges of the first position, sorted, null first. An input
    column named `positions` is left out, as `mix` is."""
    keep = docs.columns if keep is None else keep
    planned = _planned(docs, keep, source_col, text_col, id_col, weights, share, cap)
    copies = F.when(_times() > 0, F.sequence(F.lit(0), _times() - 1)).otherwise(F.array().cast("array<int>"))
    placed = planned.withColumn("positions", F.transform(copies, lambda copy: _position(copy, schedules)))
    placed = placed.withColumn("mix", F.col("mix").withField("taken", _times() * F.col("mix.size"))).withColumn("_first", F.get("positions", F.lit(0)))
    order = ["_first", "mix.rank", "mix.start", "_order"]
    ranged = placed.repartitionByRange(parts or shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select(*unpacked(keep, ("mix", "positions")), "mix", "positions")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document in order of its first position, with the words that the mix takes of it in all and where its copies stand."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_schedule(docs, keep=["doc_id"])
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "positions")
