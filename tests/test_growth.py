"""What plans read, send and keep does not grow faster than their tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodeframe.functions import descriptors as d
from lodeframe.operators import graph, match
from lodeframe.plans.tools import Engine
from lodeframe.sources import ingest


def counted(df, column):
    """(df, an accumulator of the rows that are computed of it)."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def tell(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(tell, StringType()).asNondeterministic()(column)), seen


def test_closure_reads_its_edges_once_and_sends_small_frontiers_alone(spark, monkeypatch):
    edges, seen = counted(spark.range(1, 255).select(F.col("id").cast("string").alias("child"), F.floor(F.col("id") / 2).cast("string").alias("parent")), "child")
    roots = spark.createDataFrame([("1",)], "parent string")
    for most in (10_000, 4):
        monkeypatch.setattr(graph, "FRONTIER_ROWS", most, raising=False)
        before = seen.value
        got = {r.node: r.depth for r in graph.closure(edges, roots).collect()}
        assert got == {str(k): k.bit_length() - 1 for k in range(2, 255)}
        assert seen.value - before == 254


def test_names_of_usual_descriptors_need_no_patterns(spark):
    spelled = ["La/b/C;", "[[La/b/C;", "I", "[J", "", "[", "L;", "L", "Long", "a;", "[La/b", "V;", "La;\n", None]
    df = spark.createDataFrame([(s,) for s in spelled], "s string")
    plan = df.select(d.binary_name(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 32
    got = {r.s: r.b for r in df.select("s", d.binary_name(F.col("s")).alias("b")).collect()}
    want = {"La/b/C;": "a.b.C", "[[La/b/C;": "a.b.C[][]", "I": "int", "[J": "long[]", "": "", "[": "[]", "L;": "", "L": "", "Long": "ong", "a;": "a", "[La/b": "a.b[]", "V;": "V", "La;\n": "a\n", None: None}
    assert got == want


def test_orphans_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(match, "ORPHAN_ROWS", 100, raising=False)
    left, right = spark.range(3000).select((F.col("id") % 2000).alias("k")), spark.range(1000, 3000).select(F.col("id").alias("k")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    found = match.orphans(left, right, ["k"], "l", "r")
    got = Counter((r.k, r.kind) for r in found.collect())
    assert got == Counter({**{(k, "l"): 2 for k in range(1000)}, **{(k, "r"): 1 for k in range(2000, 3000)}, (None, "r"): 1})
    assert found.rdd.getNumPartitions() == 5001 // 100 + 1 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


class Tables:
    """An index of a few tables."""

    def __init__(self, **tables):
        self.tables = tables

    def table(self, name, session_id=None):
        return self.tables[name]

    def session(self, name, owner=None):
        return name


def test_walks_read_edges_once_a_hop(spark):
    n = 60
    rows = [(f"m{k}", f"m{(k * 7 + j) % n}", kind, k + j) for k in range(n) for j in range(3) for kind in (1, 2, 10)]
    edges, seen = counted(spark.createDataFrame(rows, "caller_key string, callee_descriptor string, kind int, hits int"), "caller_key")
    e = Engine(spark, index=Tables(xref_edges=edges, edges_by_callee=edges))
    seeds = spark.createDataFrame([("m1",), ("m2",)], "method_key string")
    for direction, (s, t) in (("callees", (0, 1)), ("callers", (1, 0))):
        before = seen.value
        got = [(r.depth, r.caller_key, r.callee_descriptor, r.hits) for r in e.edges_met("s", seeds, direction, 2).collect()]
        first = {"m1", "m2"}
        second = {r[t] for r in rows if r[2] < 9 and r[s] in first} - first
        assert sorted(got) == sorted((h, r[0], r[1], r[3]) for h, own in ((1, first), (2, second)) for r in rows if r[2] < 9 and r[s] in own)
        assert seen.value - before <= 2 * len(rows)


@pytest.mark.parametrize("most", [10_000, 0])
def test_evidence_reads_methods_and_edges_once(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "FRONTIER_ROWS", most, raising=False)
    methods, seen = counted(spark.createDataFrame([("LA;", f"k{k}", "f", "()", "V", 1, False, False, 0, "V") for k in range(9)], "class_descriptor string, method_key string, name string, params_descriptor string, return_descriptor string, access_flags int, is_static boolean, is_constructor boolean, param_count int, shorty string"), "method_key")
    rows = [(f"k{k}", f"c{j}", kind) for k in range(12) for j in range(k) for kind in (1, 3, 9, 11)]
    edges, met = counted(spark.createDataFrame(rows, "caller_key string, callee_descriptor string, kind int"), "callee_descriptor")
    refs = spark.createDataFrame([(f"k{k}", "x" * j) for k in range(12) for j in range(k)], "method_key string, value string")
    classes = spark.createDataFrame([("LA;", "app", 0)], "descriptor string, source string, dex_idx int")
    e = Engine(spark, index=Tables(classes=classes, string_refs=refs, xref_edges=edges))
    got = {r.method_key: r for r in e.method_items("s", methods, 3).collect()}
    assert set(got) == {f"k{k}" for k in range(9)} and seen.value == 9 and met.value <= len(rows)
    for k in range(9):
        names = sorted(f"c{j}" for j in range(k))[:3] or None
        assert got[f"k{k}"].invokedMethods == got[f"k{k}"].accessedFields == names
        assert got[f"k{k}"].referredStrings == (["x" * j for j in range(k)][::-1][:3] or None)


def test_a_search_of_many_strings_reads_each_table_once(spark):
    # Class names may hold "->"; some methods and classes of references are not in their tables, and a constant has no reference.
    owners = {"LA;": "app", "Lb->c;": "app", "Ld/E;": "library"}
    values = [f"Key_{k}/{'ab'[k % 2]}" for k in range(1200)] + ["other", "A key of no method"]
    rows = [(f"{c};->m{k % 7}{j}()V", v) for k, v in enumerate(values[:-1]) for j, c in enumerate(("LA", "Lb->c", "Ld/E", "Lno/Class"))]
    named = sorted({m for m, _ in rows if not m.endswith("m33()V")} - {"LA;->m50()V"})
    pool = ingest.probed(spark.createDataFrame([("s", *r) for r in rows], "session_id string, method_key string, value string"), None, spark.createDataFrame([("s", values[-1])], "session_id string, value string"))
    strings, seen = counted(pool["strings"], "value")
    refs, met = counted(pool["refs_by_string"], "value")
    methods, known = counted(spark.createDataFrame([(m, m.split(";")[0] + ";") for m in named], "method_key string, class_descriptor string"), "method_key")
    classes = spark.createDataFrame(list(owners.items()), "descriptor string, source string")
    e = Engine(spark, index=Tables(strings=strings, string_grams=pool["string_grams"], refs_by_string=refs, methods=methods, classes=classes))
    for text, how, scope, fits in (("KEY", "contains", "all", lambda v: "key" in v.lower()), ("Key_", "prefix", "app", lambda v: v.startswith("Key_")), ("Key_[0-9]+", "regex", "all", lambda v: v.startswith("Key_"))):
        before = [a.value for a in (seen, met, known)]
        hits, found = e.string_hits("s", text, how, scope, 2, 0)
        got = {r["value"]: (r["len"], r["method_count"], r["methods"]) for r in hits.collect()}
        assert [a.value - b <= n for a, b, n in zip((seen, met, known), before, (len(values), len(rows), len(named)))] == [True] * 3, how
        assert sorted(r["value"] for r in found.collect()) == sorted(v for v in values if fits(v))
        want = {}
        for m, v in rows:
            if fits(v) and m in named and owners.get(m.split(";")[0] + ";") in (("app",) if scope == "app" else ("app", "library")):
                want.setdefault(v, []).append(m)
        assert got == {v: (len(v), len(own), sorted(own)[:2]) for v, own in want.items()}
