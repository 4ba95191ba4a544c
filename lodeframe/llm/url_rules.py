"""URL filters: association rules over URL tokens, mined by FP-growth from labelled pages, beside a fixed list of host and path rules.

Tokens of a URL are its scheme, each suffix of its host, its path segments (digits folded) and the names of its query parameters.
Tokens that stand in exactly the same labelled pages are one item, so long combinations that always go together are not mined subset by
subset, and tokens of too few bad pages for any rule are left out; neither changes which rules hold. FP-growth mines combinations of
items that occur with the label on a part of the labelled pages. A rule of any length needs MIN_PAGES bad pages, support and confidence,
and is dropped if a rule of fewer items inside it is at least as confident. What is left is tried on the labelled pages that mining has
not seen: a rule stays if its bad pages there are more than chance gives, by the exact binomial tail at LEVEL divided by the number of
rules. Where labels say nothing about URLs, no rule stays.

Rules are matched by an inverted index: each rule stands under the tokens of its rarest item alone, a page looks up its own tokens, and
the remaining items of a found rule are then compared. Each distinct token set is matched once.

Fixed rules come first: the longest rule that fits a URL's host (or a domain above it) and the start of its path decides.

Defined cases: a null URL, or one without "://", has empty host and path, no tokens, and is allowed; without labelled pages, or without
a bad one, nothing is mined and the fixed rules alone decide; an empty table gives an empty result; repeated pages are judged alike; a
page with both labels counts under both; of rules that fit, the most confident gives the confidence; of equal tokens the first by length
and code point names an item; a very long URL is one row like any other; columns of pages that are named like a result are left out.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import join_heavy, load, materialize, named, packed, unpacked
from lodeframe.llm.quality_rules import binomial_tail

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT = 0.0005
MIN_CONFIDENCE = 0.6
#: Bad pages that a rule needs, whatever the number of labelled pages is.
MIN_PAGES = 8
#: A page is used to try rules, not to mine them, if the hash of its id is 0 modulo TRY_FOLDS.
TRY_FOLDS = 3
LEVEL = 0.01
NEW = ("host", "path", "rule", "verdict", "confidence")
#: The token that stands for the label among the items.
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens; empty if there is no host."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, k, n), ".")))
    segments = F.transform(F.split(path, "/"), lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "0")))
    query = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1), lambda s: F.concat(F.lit("query="), s))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^(.*?)://", 1)))
    tokens = F.array_distinct(F.filter(F.concat(scheme, suffixes, segments, query), lambda t: t != "path="))
    return F.when(host != "", tokens).otherwise(F.array().cast("array<string>"))


RULE = "tokens array<string>, items array<array<string>>, confidence double, support double, lift double"


def _items(labelled: DataFrame) -> DataFrame:
    """(token, item, alternatives): tokens of the same pages are one item, named by one of them. Tokens of fewer than MIN_PAGES bad pages
    are left out, as no rule can have one."""
    pages = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "id", "bad"))
    each = labelled.select("id", "bad", F.explode("tokens").alias("token"))
    told = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("k"), pages(1).alias("x"), pages(2).alias("y"))
    same = told.where(F.col("k") >= MIN_PAGES).groupBy("n", "k", "x", "y").agg(F.sort_array(F.collect_list(F.struct(F.length("token"), "token")))["token"].alias("alternatives"))
    return same.select(F.explode("alternatives").alias("token"), F.col("alternatives")[0].alias("item"), "alternatives")


def candidate_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled: (id, tokens array<string>, bad boolean), a row for each page and label. The pruned rules items -> bad, as RULE: tokens
    (one for each item), items (all tokens of each), confidence, support, lift."""
    spark = labelled.sparkSession
    total = labelled.count()
    items = materialize(_items(labelled), "url-items")
    if not total or not items.take(1):
        return spark.createDataFrame([], RULE)
    each = labelled.select("id", "bad", F.explode("tokens").alias("token")).join(items, "token").groupBy("id", "bad").agg(F.collect_set("item").alias("items"))
    sets = labelled.select("id", "bad").distinct().join(each, ["id", "bad"], "left")
    own = F.coalesce("items", F.array().cast("array<string>"))
    sets = sets.select(F.when(F.col("bad"), F.concat(own, F.array(F.lit(BAD)))).otherwise(own).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_PAGES / total), minConfidence=min_confidence).fit(sets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift"), "url-rules")
    inner = rules.select(F.col("tokens").alias("_t"), F.col("confidence").alias("_c"), F.col("tokens")[0].alias("_token"))
    # A rule loses to any rule of which the items are a proper part of its own: it has the first of them, so an equi-join finds them.
    lost = rules.withColumn("_token", F.explode("tokens")).join(inner, "_token")
    lost = lost.where((F.size("_t") < F.size("tokens")) & (F.size(F.array_except("_t", "tokens")) == 0) & (F.col("_c") >= F.col("confidence")))
    kept = rules.join(lost.select("tokens").distinct(), "tokens", "left_anti")
    names = items.select("item", "alternatives").distinct()
    full = kept.withColumn("item", F.explode("tokens")).join(names, "item").groupBy("tokens", "confidence", "support", "lift")
    return full.agg(F.sort_array(F.collect_list("alternatives")).alias("items")).select("tokens", "items", "confidence", "support", "lift")


def try_rules(rules: DataFrame, labelled: DataFrame, level: float = LEVEL) -> DataFrame:
    """The rules that hold on labelled pages which mining has not seen, with tried (pages that fit) and tried_bad."""
    told = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("k")).first()
    number = rules.count()
    if not number or not told.k:
        return rules.limit(0).withColumn("tried", F.lit(0).cast("long")).withColumn("tried_bad", F.lit(0).cast("long"))
    share = min(told.k / told.n, 1 - 1e-9)
    sets = labelled.groupBy(F.array_sort("tokens").alias("_set")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("k"))
    seen = fitting(sets, rules).join(sets, "_set").groupBy("tokens").agg(F.sum("n").alias("tried"), F.sum("k").alias("tried_bad"))
    # P(Bin(tried, share) >= tried_bad), as the lower tail of what is not bad.
    chance = binomial_tail(F.col("tried"), F.col("tried") - F.col("tried_bad"), 1 - share)
    return rules.join(seen.where((F.col("tried_bad") > 0) & (chance <= level / number)), "tokens")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled: (id, tokens array<string>, bad boolean). The rules that mining finds on one part of it and that hold on the other."""
    labelled = materialize(labelled.select("id", "tokens", "bad").distinct(), "url-labelled")
    tried = F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(TRY_FOLDS)) == 0
    rules = materialize(candidate_rules(labelled.where(~tried), min_support, min_confidence), "url-candidates")
    return materialize(try_rules(rules, labelled.where(tried)), "url-held")


def fitting(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(_set, tokens, confidence) of each rule that fits a token set. sets: a row for each distinct `_set`."""
    counts = sets.select(F.explode("_set").alias("token")).groupBy("token").count()
    parts = rules.select("tokens", "items", "confidence", F.posexplode("items").alias("at", "alternatives"))
    each = parts.select("tokens", "items", "confidence", "at", F.explode("alternatives").alias("token")).join(counts, "token", "left")
    sums = each.groupBy("tokens", "items", "confidence", "at").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    rarest = sums.groupBy("tokens", "items", "confidence").agg(F.min(F.struct("n", "at"))["at"].alias("at"))
    index = rarest.select("tokens", "items", "confidence", F.explode(F.expr("items[at]")).alias("token"))
    found = sets.select("_set", F.explode("_set").alias("token")).join(index, "token")
    fits = found.where(F.forall("items", lambda alternatives: F.arrays_overlap(alternatives, "_set")))
    return fits.select("_set", "tokens", "confidence").distinct()


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, mined: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and confidence (of the best mined rule that fits)."""
    url = named(url_col)
    told = pages.select(packed(pages), host_of(url).alias("host"), path_of(url).alias("path"), F.array_sort(url_tokens(url)).alias("_set"))
    told = materialize(told, "url-pages")
    sets = told.groupBy("_set").agg(F.count(F.lit(1)).alias("_pages"))
    best = fitting(sets, mined).groupBy("_set").agg(F.max("confidence").alias("confidence"))
    known = materialize(sets.join(best, "_set", "left"), "url-sets")
    number = known.agg(F.coalesce(F.sum("_pages"), F.lit(0))).first()[0]
    # A token set that many pages share meets its verdict where the pages stand.
    judged = join_heavy(told, known, "_set", number, "_pages").withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(F.col("_fixed.verdict"), own).alias("verdict")
    return judged.select(*unpacked(pages.columns, NEW), "host", "path", F.col("_fixed.rule").alias("rule"), verdict, "confidence")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels reach pages by number (a page is the raw form of the document of that id); quality 0 is bad."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    labels = load(spark, sf_dir, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad")).distinct()
    labelled = pages.join(labels, "page_id").select(F.col("page_id").alias("id"), url_tokens(F.col("url")).alias("tokens"), "bad")
    return judge_urls(pages, mine_rules(labelled)).select("page_id", "host", "path", "rule", "verdict", "confidence")
