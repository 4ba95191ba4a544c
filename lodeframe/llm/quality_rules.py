"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects a document if one of its rates is above a cutoff. Cutoffs come from a labelled holdout: for a stratum (language) and
a rule, cutoffs of a fixed grid are tested from the most lenient to the strictest. A cutoff holds if its false rejection rate among
good documents is at most `alpha` with the needed confidence, by the exact binomial tail (Clopper-Pearson): P(Bin(n, alpha) <= k) is
at most delta / (strata * rules) for k rejections among n good documents. Dividing delta corrects for the number of strata and rules
(Bonferroni); along the grid the first failure ends the test, which needs no more correction (fixed-sequence testing). So, with
confidence 1 - delta, no rule rejects more than `alpha` of the good documents of any stratum. A rule without enough labelled documents
gets no cutoff and rejects nothing: with k = 0 a cutoff needs least_labelled() good documents in its stratum (1,151 for four languages
and rules). Strata are not pooled to reach that number, as a cutoff of the whole would promise nothing for a stratum;
`threshold_report` gives the number, the cutoff and its rejections for each stratum and rule, and each judged row has the number of good
labelled documents of its stratum (n_labelled).

Defined cases: a null text is an empty one; texts without words have all counts 0 and fail the base rule; a null stratum is a stratum;
null labels are passed over and a document that is labelled good twice counts once per row of it; without labels only the base rule
rejects; an empty table gives an empty result; repeated rows are judged alike; a rate equal to a cutoff is not above it; a text of any
length is one row, of which one array of words is held at a time; columns of docs that are not in `keep` are left out, and those in it
must not be named like a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import load, materialize, named, packed, unpacked

ALPHA = 0.005
DELTA = 0.05
SPACE = r"[\x20\x09-\x0D]+"
#: Rule -> cutoffs from lenient to strict. The rates are in RATES.
GRID = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_share": (0.2, 0.19, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05),
    "dup_lines_per_word": (0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02),
    "word_length": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0),
}
RATES = {
    "symbols_per_word": "n_symbols / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_lines_per_word": "n_dup_lines / n_words",
    "word_length": "word_chars / n_words",
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of `keep` and the five base counts of each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0)
    one = docs.select(
        *keep,
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.filter(F.split(text, SPACE, -1), lambda w: w != "").alias("_words"),
    )
    n = F.size("_words")
    word = F.col("_words")
    keys = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(word[i], word[i + 1], word[i + 2], word[i + 3], word[i + 4]))).otherwise(F.array().cast("array<long>"))
    two = one.select(*keep, "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), n.cast("long").alias("n_words"), keys.alias("_keys"))
    # Most documents repeat no window: their keys are not sorted.
    repeats = F.size(F.array_distinct("_keys")) < F.size("_keys")
    three = two.select(*keep, *(c for c in BASE if c != "n_repeat_words"), F.when(repeats, F.array_sort(F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).alias("_ordered"))
    found = F.filter(F.transform("_ordered", lambda x, j: F.when((F.get("_ordered", j - 1)["k"] == x["k"]) | (F.get("_ordered", j + 1)["k"] == x["k"]), x["i"])), lambda i: i.isNotNull())
    covered = F.aggregate(F.array_sort(found), F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return three.select(*keep, *(c for c in BASE if c != "n_repeat_words"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly, term by term in logarithms."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    step = lambda s, j: F.struct((s["l"] + F.log((n - j + 1) / j) + F.lit(odds)).alias("l"), (s["t"] + F.exp(s["l"] + F.log((n - j + 1) / j) + F.lit(odds))).alias("t"))
    start = F.struct(first.alias("l"), F.exp(first).alias("t"))
    return F.when(k >= n, F.lit(1.0)).when(k <= 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda s: s["t"]))


def least_labelled(strata: int, alpha: float = ALPHA, delta: float = DELTA, rules: int = len(GRID)) -> int:
    """Good documents without which no cutoff of a stratum can hold."""
    return math.ceil(math.log(delta / (strata * rules)) / math.log1p(-alpha))


def threshold_report(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA, grid: dict = GRID) -> DataFrame:
    """good: the stratum and base counts of good documents. A row (stratum, rule, n, strata, cut, rejected) for each stratum with documents
    and each rule; cut and rejected (how many of the n good documents it rejects) are null if no cutoff holds."""
    # A row for each document and rule says how many of the rule's cutoffs it is above. Cutoffs fall, so those are the last ones.
    each = [F.struct(F.lit(r).alias("rule"), F.expr(RATES[r]).alias("rate"), F.array(*map(F.lit, cuts)).alias("cuts")) for r, cuts in grid.items()]
    rates = good.select(stratum, F.inline(F.array(*each)))
    above = F.size(F.filter("cuts", lambda c: F.col("rate") > c))
    found = rates.groupBy(stratum, "rule", "cuts", above.alias("above")).agg(F.count(F.lit(1)).alias("docs"))
    told = found.groupBy(stratum, "rule", "cuts").agg(F.sum("docs").alias("n"), F.collect_list(F.struct("above", "docs")).alias("found"))
    # A row for each stratum and rule: the window over all of them only counts strata.
    told = told.withColumn("strata", F.size(F.collect_set(F.coalesce(F.concat(F.lit("s"), F.col(stratum)), F.lit("n"))).over(Window.partitionBy())))
    steps = told.select(stratum, "rule", "n", "strata", "found", F.size("cuts").alias("all"), F.posexplode("cuts").alias("step", "cut"))
    rejected = F.aggregate(F.filter("found", lambda x: x["above"] >= F.col("all") - F.col("step")), F.lit(0).cast("long"), lambda s, x: s + x["docs"])
    tests = steps.select(stratum, "rule", "n", "strata", "step", "cut", rejected.alias("k"))
    level = F.lit(float(delta)) / (F.col("strata") * len(grid))
    holds = F.when(F.col("k") < F.col("n") * F.lit(alpha), binomial_tail(F.col("n"), F.col("k"), alpha) <= level).otherwise(F.lit(False))
    tried = tests.withColumn("holds", holds)
    before = Window.partitionBy(stratum, "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = tried.withColumn("all_hold", F.min("holds").over(before))
    pick = lambda c: F.max_by(c, F.when(F.col("all_hold"), F.col("step"))).alias
    held = F.max("all_hold")
    best = passed.groupBy(stratum, "rule", "n", "strata").agg(held.alias("_held"), pick("cut")("cut"), pick("k")("rejected"))
    return best.select(stratum, "rule", "n", "strata", *[F.when(F.col("_held"), F.col(c)).alias(c) for c in ("cut", "rejected")])


def fit_thresholds(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA, grid: dict = GRID) -> DataFrame:
    """A row (stratum, n, cuts map rule -> cutoff, without the rules that have none) for each stratum with good documents."""
    cuts = F.filter(F.collect_list(F.struct("rule", "cut")), lambda x: x["cut"].isNotNull())
    return threshold_report(good, stratum, alpha, delta, grid).groupBy(stratum, "n").agg(F.map_from_entries(cuts).alias("cuts"))


def judge_quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA, grid: dict = GRID) -> DataFrame:
    """The columns of `keep` (the id if not given), the base counts, base_failed, kept and failed_rules of each document."""
    keep = [id_col] if keep is None else keep
    source = docs.select(named(id_col).alias("_id"), F.coalesce(F.concat(F.lit("s"), named(stratum_col).cast("string")), F.lit("n")).alias("_stratum"), packed(docs, keep), named(text_col).alias("_text"))
    own = ["_id", "_stratum", "_doc"]
    counts = materialize(measure(source, own, "_text"), "quality-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    good_ids = labels.where(named(label_col) == 1).select(named(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    good = counts.where("NOT base_failed").join(good_ids, "_id", "left_semi")
    cuts = materialize(fit_thresholds(good, "_stratum", alpha, delta, grid), "quality-cuts")
    judged = counts.join(cuts, "_stratum", "left")
    broken = F.filter(F.array(*[F.when(F.expr(f"n_words > 0 AND {RATES[r]} > cuts['{r}']"), F.lit(r)) for r in grid]), lambda x: x.isNotNull())
    judged = judged.withColumn("failed_rules", broken)
    kept = (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept")
    labelled = F.coalesce("n", F.lit(0)).cast("long").alias("n_labelled")
    return judged.select(*unpacked(keep, (*BASE, "base_failed", "kept", "failed_rules", "n_labelled")), *BASE, "base_failed", kept, "failed_rules", labelled)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "failed_rules", "n_labelled")
