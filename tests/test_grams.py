"""The index of character n-grams, and how much of the stored tables probes read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import filters, grams
from lodeframe.plans.index import Index
from lodeframe.plans.tools import Engine
from lodeframe.sources import ingest

TEXTS = ["", "ab", "Sign_In_Clicked", "sign in", "https://a.b/c?d=1", "ΑΣ end", "İstanbul", "naïve Café", "a\nb c", "x" * 300, "key=VALUE", "KEY=value;", "日本語のテキスト", "tail", "aXb--cXd", None]
NEEDLES = ["sign", "SIGN_in", "a.b/c", "café", "σ e", "日本語", "istanbul", "xxxx", "VALUE", "zzz"]
PATTERNS = [r"sign.in", r"[Ss]ign_(In|Out)_\w+", r"^key=(VALUE|value)", r"(?:abc|tail)$", r"a+b", r"https?://[a-z.]+/c\?d=\d", r"x{3,}", r"(?i)SIGN", r"Caf.", r"a?b?c?", r"end|", r"\Qa.b\E", r"(foo)*tail", r"(foo)+tail", r"\bin\b", "ΑΣ"]


@pytest.fixture(scope="module")
def pool(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "value string")
    return df.select(ingest.string_id(F.col("value")).alias("id"), "value", F.lower("value").alias("lc")).where("value IS NOT NULL")


def test_candidates_hold_every_match(spark, pool):
    index = grams.postings(pool, [], "id", "lc")
    known = pool.collect()
    for how, texts in (("contains", NEEDLES), ("prefix", NEEDLES + ["Sign_", "KEY"]), ("regex", PATTERNS)):
        for text in texts:
            want = grams.wanted(text, how)
            found = {r.value for r in filters.text_filter(pool, "value", text, how, 0, "lc").collect()}
            if want is not None:
                ids = {r.id for r in grams.candidates(index, want).collect()}
                assert found <= {r.value for r in known if r.id in ids}, (how, text)


def test_what_patterns_want():
    assert grams.of_pattern(r"sign.in") == [{"sig", "ign"}]
    assert grams.of_pattern(r"(Key|Val)ue") is not None and len(grams.of_pattern(r"(Key|Val)ue")) == 2
    assert grams.of_pattern(r"(abcd)+x") == [{"abc", "bcd"}]
    for p in (r"a?b?c?", r"end|", r"\Qabc\E", r"(?i)abc", r"[abc]def*|x", r"(foo)*ta", r"abc\x41", "("):
        assert grams.of_pattern(p) is None, p
    assert grams.of_contains("ab") is None and grams.either([{"abc"}], None) is None
    assert len(grams.grams_of("".join(map(chr, range(97, 123))))) <= grams.MOST_GRAMS


def test_random_patterns(spark, pool):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abAB ") for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, t.lower()) for k, t in enumerate(texts)], "id long, value string, lc string")
    index = grams.postings(df, [], "id", "lc").cache()
    for _ in range(6):
        pattern = "".join(rng.choice(["abc", "ab", "(ab|ba)", "a+", "b*", "(aba)?", ".", "[ab]", "bab"]) for _ in range(3))
        want = grams.of_pattern(pattern)
        if want is not None:
            ids = {r.id for r in grams.candidates(index, want).collect()}
            assert {k for k, t in enumerate(texts) if re.search(pattern, t)} <= ids, pattern
    index.unpersist()


def scanned(df, table: str) -> int:
    """Rows that the scans of a table gave to the plan, after row groups were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        own = 0
        if "Scan parquet" in node.nodeName() and f"/{table}" in node.verboseStringWithSuffix(1000):
            own = node.metrics().get("numOutputRows").get().value()
        more = [walk(node.children().apply(k)) for k in range(node.children().size())]
        if node.nodeName().endswith("QueryStage"):
            more.append(walk(node.plan()))
        return own + sum(more)

    return walk(plan)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """30,000 strings and calls in small row groups."""
    index = Index(spark, str(tmp_path_factory.mktemp("stored")))
    rows = spark.range(30_000)
    refs = rows.select(F.lit("s").alias("session_id"), F.concat(F.lit("La/C"), (F.col("id") % 100).cast("string"), F.lit(";->m"), F.col("id").cast("string"), F.lit("()V")).alias("method_key"), F.concat(F.lit("value number "), F.col("id").cast("string"), F.when(F.col("id") == 777, " Needle").otherwise("")).alias("value"))
    callee = F.concat(F.lit("Lb/D"), F.hash("id").cast("string"), F.lit(";->n()V"))
    edges = refs.select("session_id", F.col("method_key").alias("caller_key"), F.lit(1).alias("kind"), F.lit("n").alias("callee_name"), F.lit("()").alias("callee_params"), F.lit("V").alias("callee_ret"), F.lit(1).cast("long").alias("hits"), F.col("value")).withColumn("callee_descriptor", F.concat(F.lit("Lb/D"), F.hash("value").cast("string"), F.lit(";->n()V"))).withColumn("callee_owner", F.substring_index("callee_descriptor", "->", 1)).drop("value")
    methods = refs.select("session_id", F.substring_index("method_key", "->", 1).alias("class_descriptor"), F.lit("m").alias("name"), F.lit("()").alias("params_descriptor"), F.lit("V").alias("return_descriptor"), "method_key", *[F.lit(None).alias(c) for c in ("access_flags", "is_static", "is_constructor", "has_refs", "partial", "param_count", "shorty", "regs", "ins_size", "unit_count")])
    classes = methods.select("session_id", F.lit(0).alias("dex_idx"), F.col("class_descriptor").alias("descriptor"), F.lit("C").alias("simple_name"), F.lit("a").alias("package"), F.lit(1).alias("access_flags"), F.lit("Lx;").alias("super_descriptor"), F.array().cast("array<string>").alias("interfaces"), F.lit("app").alias("source"), F.lit("o").alias("origin_file"), F.lit("class").alias("kind"), F.lit(None).alias("source_file")).distinct()
    index.write({"string_refs": refs, "xref_edges": edges, "methods": methods, "classes": classes, **ingest.probed(refs, edges)}, **{"parquet.block.size": 1 << 14, "parquet.page.size": 1 << 12, "parquet.block.size.row.check.min": 100})
    return index


def test_a_search_reads_what_its_grams_stand_in(spark, stored):
    engine = Engine(spark, index=stored)
    stored.session = lambda name, owner=None: name
    hits, pool = engine.string_hits("s", "needle", "contains", "all", 8, 0)
    assert [r["value"] for r in hits.collect()] == ["value number 777 Needle"]
    assert scanned(pool, "strings") < 3000 and scanned(hits, "refs_by_string") < 3000
    postings = grams.candidates(stored.table("string_grams", "s"), grams.of_contains("needle"))
    assert scanned(postings, "string_grams") < stored.table("string_grams", "s").count() / 20
    text = postings._jdf.queryExecution().toString()
    assert "PartitionFilters" in text and "part" in text.split("PartitionFilters", 1)[1][:300]
    exact, _ = engine.string_hits("s", "value number 5", "exact", "all", 8, 0)
    assert exact.count() == 1 and scanned(exact, "refs_by_string") < 3000


def test_callers_read_the_row_groups_of_their_callee(spark, stored):
    engine = Engine(spark, index=stored)
    callee = stored.table("xref_edges", "s").where(F.col("caller_key").endswith(";->m123()V")).first().callee_descriptor
    edges = engine.invocations("s", "callee_descriptor")
    met = grams.probe(edges, spark.createDataFrame([(callee,)], "callee_descriptor string"), "callee_descriptor")
    assert met.count() == 1 and scanned(met, "edges_by_callee") < 3000
    # The copy by callers has no order of callees: nearly all of it is read.
    assert scanned(engine.invocations("s").where(F.col("callee_descriptor") == callee), "xref_edges") > 20_000


def test_a_probe_of_many_keys_is_still_a_filter_of_the_scan(spark, stored):
    keys = stored.table("refs_by_string", "s").orderBy("id").limit(40).select("id")
    met = grams.probe(stored.table("refs_by_string", "s"), keys, "id")
    assert met.count() == 40 and scanned(met, "refs_by_string") < 3000
    joined = grams.probe(stored.table("refs_by_string", "s"), keys, "id", most=10)
    assert joined.count() == 40
