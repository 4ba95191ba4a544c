"""Column functions against plain values."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeframe.errors import EngineError
from lodeframe.functions import descriptors as d
from lodeframe.functions import text
from lodeframe.operators import diff, filters, graph, match, ranking, rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


SPELLINGS = {"a.b.C": "La/b/C;", "a/b/C": "La/b/C;", "La/b/C;": "La/b/C;", "int": "I", "char": "C", "I": "I", "int[]": "[I", "a.B[][]": "[[La/B;", "[I": "[I", "[La/b/C;": "[La/b/C;", "[La.b.C;": "[La/b/C;", " a.B ": "La/B;", "a.B [ ]": "[La/B;"}


def test_descriptors(spark):
    rows = spark.createDataFrame([(k,) for k in SPELLINGS], "s string").select("s", d.normalize_desc(F.col("s")).alias("x")).collect()
    assert {r.s: r.x for r in rows} == SPELLINGS == {k: d.to_desc(k) for k in SPELLINGS}
    lit = F.lit
    assert one(spark, d.binary_name(lit("[[La/b/C;"))) == "a.b.C[][]" and one(spark, d.binary_name(lit("J"))) == "long" and one(spark, d.internal_name(lit("[La/b/C;"))) == "[La.b.C;" and one(spark, d.java_type(lit("La/b/C;"), True)) == "C"
    assert one(spark, d.split_params(lit("(ILjava/lang/String;[J[[La/B;)"))) == ["I", "Ljava/lang/String;", "[J", "[[La/B;"] and one(spark, d.split_params(lit("()"))) == []
    assert one(spark, d.shorty(d.split_params(lit("(I[JLa/B;)")), lit("V"))) == "VILL" and one(spark, d.join_params(F.array(lit("I"), lit("J")))) == "(IJ)"
    assert one(spark, d.java_method(lit("La/B;"), lit("<init>"), lit("(I)"), lit("V"), lit(1))) == "public a.B(int)" and one(spark, d.java_field(lit("x"), lit("[I"), lit(0x1A))) == "private static final int[] x"
    assert one(spark, d.class_for_name(lit("La/B;"), True)) == 'Class.forName("a.B", true, classLoader)'
    assert one(spark, d.method_flag_names(lit(0x10008), lit("<clinit>"))) == ["static", "static-initializer"] and one(spark, d.flag_names(lit(0x10008), d.METHOD_FLAGS)) == ["static", "constructor"] and one(spark, d.method_flag_names(lit(0x10010), lit("run"))) == ["final"] and one(spark, d.method_flag_names(lit(0x10000), lit("<init>"))) == ["constructor"]
    assert [one(spark, d.class_kind(lit(f))) for f in (0x2600, 0x2000, 0x600, 0x4000, 0x400, 1)] == ["interface", "annotation", "interface", "enum", "abstract", "class"]
    assert one(spark, d.simple_name(lit("La/b/C$D;"))) == "C$D" and one(spark, d.package_of(lit("La/b/C;"))) == "a/b" and one(spark, d.package_of(lit("LC;"))) == ""
    forms = one(spark, d.method_forms(lit("La/B;"), lit("go"), lit("(ILa/C;)"), lit("[I"), lit(9)))
    assert forms.java == "public static int[] go(int, a.C)" and forms.javaSimple == "public static int[] go(int, C)" and forms.paramCount == 2 and forms.smali == "La/B;->go(ILa/C;)[I"
    assert one(spark, d.field_forms(lit("La/B;"), lit("f"), lit("J"), lit(1))).reflector == "a.B->f:J"


def test_references():
    assert d.parse_method_ref("La/B;->go(I[J)V") == ("La/B;", "go", ["I", "[J"], "V") and d.parse_method_ref("a.B#go") == ("La/B;", "go", None, None) and d.parse_method_ref("go") == (None, "go", None, None)
    assert d.parse_method_ref("a.B.go(int, String[]): void") == ("La/B;", "go", ["I", "[LString;"], "V") and d.parse_method_ref("a.B-><init>()") == ("La/B;", "<init>", [], None)
    assert d.parse_field_ref("a.B->f:int") == ("La/B;", "f", "I") and d.parse_field_ref("a.B#f") == ("La/B;", "f", None) and d.parse_field_ref("f") == (None, "f", None)
    for bad in ("", "->", "a b c"):
        with pytest.raises(EngineError):
            d.parse_method_ref(bad)


def test_text(spark):
    for s in ("", "aaaa", "abcd", "hello wörld €"):
        want = -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values()) if s else 0
        assert one(spark, text.entropy(F.lit(s))) == pytest.approx(want)
    assert one(spark, text.entropy(F.lit(None).cast("string"))) is None
    sets = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    assert one(spark, text.jaccard(sets("a", "b"), sets("b", "c"))) == pytest.approx(1 / 3) and one(spark, text.jaccard(sets(), sets())) == 0
    assert text.keywords('the "sign in" of com.a.MainActivity 登录按钮 getName') == ["sign in", "登录按钮", "com.a.MainActivity", "getName"]
    pair = F.array(F.struct(F.lit("b").alias("name"), F.lit("2").alias("sha")), F.struct(F.lit("a").alias("name"), F.lit("1").alias("sha")))
    assert one(spark, text.combined_sha(F.slice(pair, 1, 1))) == "2" and len(one(spark, text.combined_sha(pair))) == 64


def test_filters(spark):
    df = spark.createDataFrame([("100%_a", "app", True), ("100xya", "library", None), ("Äb", "system", False)], "s string, source string, e boolean")
    pick = lambda x: sorted(r.s for r in x.collect())
    assert pick(df.where(filters.prefix(F.col("s"), "100%_A"))) == ["100%_a"] and pick(filters.scope_filter(df, "lib")) == ["100xya", "Äb"]
    assert pick(filters.three_valued(df, "e", False)) == ["Äb"] and pick(filters.three_valued(df, "e", None)) == sorted(["100%_a", "100xya", "Äb"])
    assert pick(filters.text_filter(df, "s", "100", "prefix", 6)) == ["100%_a", "100xya"] and pick(filters.text_filter(df, "s", "^100x", "regex")) == ["100xya"]
    for bad in (lambda: filters.scope_filter(df, "odd"), lambda: filters.text_filter(df, "s", "a"), lambda: filters.text_filter(df, "s", "(", "regex"), lambda: filters.name_filter(df, "a", "odd", ["s"]), lambda: ranking.clamp_limit("x")):
        with pytest.raises(EngineError):
            bad()
    assert [ranking.clamp_limit(x) for x in (None, 0, -1, 7, 999)] == [50, 50, 50, 7, 200]


def test_graphs_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")], "src string, dst string")
    got = {(r.src, r.dst): r.hop for r in graph.walk(edges, spark.createDataFrame([("a",)], "src string"), 3).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 2, ("c", "a"): 3}
    tree = edges.toDF("parent", "child")
    assert {r.node: r.depth for r in graph.closure(tree, spark.createDataFrame([("a",)], "parent string")).collect()} == {"b": 1, "c": 2}


def test_assignment_is_the_greedy_one(spark):
    import random

    rnd = random.Random(3)
    pairs = [(f"a{i}", f"b{j}", round(rnd.random(), 1)) for i in range(8) for j in range(8) if rnd.random() < 0.5]
    want, ua, ub = set(), set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in ua and b not in ub:
            want.add((a, b))
            ua.add(a)
            ub.add(b)
    got = diff.one_to_one(spark.createDataFrame(pairs, "key_a string, key_b string, score double")).collect()
    assert {(r.key_a, r.key_b) for r in got} == want


def test_rollup_and_broadcast_bound(spark):
    found = spark.createDataFrame([(1, "v", "w"), (1, "u", "s"), (2, "v", "w"), (3, None, None)], "k int, vendor string, kind string")
    got = {r.k: (r.strong, r.vendors, r.findings, r.confidence) for r in rules.evidence_rollup(found, ["k"], F.col("kind") == "s").collect()}
    assert got == {1: (True, "u,v", 2, "high"), 2: (False, "v", 1, "medium"), 3: (False, "", 0, "none")}
    assert match.sized_broadcast(found, 1) is found


def test_contained_in_equals_a_scan(spark):
    hay = [(1, "one two  three four"), (2, "xone two three fourx"), (3, "a+b (c) [d]\tlast"), (4, None), (5, ""), (6, "two"), (7, "two three"), (8, "née é à la")]
    needles = [(1, "two  three"), (2, "one two three four"), (3, "b (c) [d]"), (4, "two"), (5, ""), (6, None), (7, " two "), (8, "\tlast"), (9, "é à l"), (10, "(c)")]
    got = match.contained_in(spark.createDataFrame(needles, "n int, needle string"), spark.createDataFrame(hay, "h int, text string"), "needle", "text")
    want = sorted((h, n) for h, t in hay for n, x in needles if t and x and x in t)
    assert sorted((r.h, r.n) for r in got.collect()) == want
    assert got.columns == ["h", "text", "n", "needle"]
    few = match.contained_in(spark.createDataFrame([(1, "a b c")], "n int, needle string"), spark.createDataFrame([(1, "x a b c y")], "h int, text string"), "needle", "text")
    assert few.count() == 1


def test_rules_in_the_plan_equal_joined_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "abc"), (2, "xyz"), (3, None), (4, "ab")], "k int, t string")
    dictionary = spark.createDataFrame([(f"p{k}", p, "v", k) for k, p in enumerate(("^a", "z$", "b", "q", "b"))], "rule string, pattern string, vendor string, rank int")
    inline = sorted(tuple(r) for r in rules.scan_rules(rows, "t", dictionary).collect())
    monkeypatch.setattr(rules, "INLINE_RULES", 2)
    joined = rules.scan_rules(rows, "t", dictionary)
    assert inline == sorted(tuple(r) for r in joined.collect()) and len(inline) == 7
    rows = spark.createDataFrame([(1, "an Apache License"), (2, "token = 12 and key=abc;"), (3, None), (4, ""), (5, "ÄPFEL key=zz; TOKEN"), (6, "tokens")], "k int, t string")
    patterns = ["(MIT|Apache) License", "token = [0-9]+", "key=[a-z]+;", "(?i)token", "^toke", "äpfel", "ÄPFEL", "a|token", "[a-z]{6}", "token", "(", None][:10]
    dictionary = spark.createDataFrame([(f"p{k}", p, "v", k) for k, p in enumerate(patterns)], "rule string, pattern string, vendor string, rank int")
    for kind, names in (("regex", ("p0", "p1", "p2")), ("prefix", ())):
        monkeypatch.setattr(rules, "INLINE_RULES", 256)
        want = sorted(tuple(r) for r in rules.scan_rules(rows, "t", dictionary, kind).collect())
        monkeypatch.setattr(rules, "INLINE_RULES", 3)
        for most in (8 << 20, 100):
            monkeypatch.setattr(rules, "AUTOMATON_BYTES", most)
            assert sorted(tuple(r) for r in rules.scan_rules(rows, "t", dictionary, kind).collect()) == want
        assert set(names) <= {w[2] for w in want} and want
    assert rules.scan_rules(rows, "t", dictionary.limit(0)).count() == 0


def test_a_dictionary_like_a_table_is_joined_in_one_pass(spark, monkeypatch):
    n, lengths = 3000, (0, 1, 3, 9, 40)
    texts = spark.range(n).select("id", F.concat(F.lit("Ä;order="), F.col("id").cast("string"), F.lit(";PART="), (F.col("id") % 10).cast("string"), F.lit(";K")).alias("t"))
    own = [(f"o{k}", f"order={k};PART=[0-9]*7;") for k in range(0, n, 2)] + [(f"x{k}", f"order={k};|none{k}|PART=[37]") for k in range(n, n + 300)]
    own += [(f"y{k}", "z" * k + "Kelvin" * (k > 3)) for k in lengths[1:]] + [("both", "order=17;|PART=7;"), ("kelvin", "\u212a+"), ("three", "er="), ("null", None), ("any", ".K$")]
    dictionary = spark.createDataFrame(own, "rule string, pattern string")
    monkeypatch.setattr(rules, "AUTOMATON_BYTES", 1000)
    monkeypatch.setattr(rules, "_pass", None)
    got = sorted((r.id, r.rule) for r in rules.scan_rules(texts, "t", dictionary).collect())
    want = [(k, f"o{k}") for k in range(0, n, 2) if k % 10 == 7] + [(k, f"x{x}") for k in range(n) if k % 10 in (3, 7) for x in range(n, n + 300)]
    want += [(k, "both") for k in range(n) if k % 10 == 7 or k == 17] + [(k, r) for k in range(n) for r in ("three", "any")]
    assert got == sorted(want)


def test_budget_of_each_part_null_parts_too(spark):
    rows = [(p, k, "x" * (k % 4)) for p in ("a", None, "b") for k in range(60)] + [("b", 99, None)]
    got = ranking.within_budget(spark.createDataFrame(rows, "p string, k int, t string"), "t", ["k"], 20, ["p"])
    want = []
    for p in ("a", None, "b"):
        total = 0
        for q, k, t in rows:
            if q == p:
                total += len(t or "")
                if total <= 20:
                    want.append((p or "", k, total))
    assert sorted((r.p or "", r.k, r.running) for r in got.collect()) == sorted(want)
