"""The query catalogue: each generic operator bound to the driver's tables, with the same query in SQL for DuckDB.

Roles: brands and types of parts are string constants, orders are methods, line items are references from orders to parts and
suppliers, documents are a string pool, their sources are sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.text import entropy, jaccard, quoted_spans
from lodeframe.operators import diff, filters, graph, match, ranking, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(t):
    return match.table_counts({name: t(name) for name in TABLES})


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def source_breakdown(t):
    return match.count_by(t("documents"), ["source", "lang"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_7' OR n_name LIKE '%\\_17' ESCAPE '\\'")
def symbol_exact(t):
    return filters.name_filter(t("nation"), "NATION_7", "exact", ["n_name"], also=F.col("n_name").endswith("_17")).select("n_nationkey", "n_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'red%' ORDER BY length(p_name), p_name, p_partkey LIMIT 200")
def symbol_prefix(t):
    found = filters.name_filter(t("part"), "RED", "prefix", ["p_name"])
    return found.orderBy(F.length("p_name"), "p_name", "p_partkey").limit(200).select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(s_name, '0[1-3]5$|#0+7')")
def symbol_regex(t):
    return filters.name_filter(t("supplier"), "0[1-3]5$|#0+7", "regex", ["s_name"]).select("s_suppkey", "s_name")


@query("SELECT p_partkey, p_brand FROM part WHERE replace(p_brand, '/', '.') ILIKE 'brand#1%'")
def package_filter_override(t):
    return filters.name_filter(t("part"), "not used", "prefix", ["p_name"], "p_brand", "Brand#1").select("p_partkey", "p_brand")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def scope_filter(t):
    return filters.scope_filter(t("documents"), "library", scopes={"all": None, "library": ("src1", "src2")}).select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'license')")
def string_contains(t):
    return filters.text_filter(t("documents"), "text", "LICENSE").select("doc_id", "n_chars")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND length(c_name) >= 10")
def string_exact_minlen(t):
    return filters.text_filter(t("customer"), "c_mktsegment", "BUILDING", "exact").where(F.length("c_name") >= 10).select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[a-z0-9]+@[a-z0-9.]+[.](com|org|net)')")
def string_regex(t):
    return filters.text_filter(t("documents"), "text", "[a-z0-9]+@[a-z0-9.]+[.](com|org|net)", "regex").select("doc_id")


_BRAND_REFS = "SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey"


def _brand_refs(t):
    return t("lineitem").select("l_partkey", "l_orderkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


@query(f"WITH r AS ({_BRAND_REFS}), c AS (SELECT p_brand, count(*) AS method_count FROM r GROUP BY p_brand), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY l_orderkey) AS rn FROM r) SELECT p_brand, l_orderkey, rn, method_count FROM k JOIN c USING (p_brand) WHERE rn <= 8")
def string_reverse_topk(t):
    return match.reverse_top_k(_brand_refs(t), "p_brand", "l_orderkey", [], 8).select("p_brand", "l_orderkey", "rn", "method_count")


@query("SELECT p_type, count(DISTINCT l_orderkey) AS method_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def anchor_rank(t):
    refs = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_type", "l_orderkey")
    return match.anchor_rank(refs, "p_type", "l_orderkey")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE (l_linenumber & 5) = 5 AND (l_linenumber & 2) = 0")
def bitmask_filter(t):
    n = F.col("l_linenumber")
    return t("lineitem").where(filters.flags_set(n, 5) & filters.flags_clear(n, 2)).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) = 3")
def arity_match(t):
    return match.with_arity(t("lineitem"), ["l_orderkey"], 3)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A' AND l_quantity > 30) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_discount < 0.03)")
def semi_all(t):
    lines = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return match.semi_all(t("orders"), [lines.where("l_returnflag = 'A' AND l_quantity > 30"), lines.where("l_returnflag = 'R' AND l_discount < 0.03D")], ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3")
def relational_division(t):
    return match.having_all(t("lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"])


@query("SELECT o_orderkey AS k, 'no_line' AS kind FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT l_orderkey, 'no_order' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)")
def orphans_anti(t):
    return match.orphans(t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")), ["k"], "no_line", "no_order")


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def array_membership(t):
    return t("documents").where(filters.has_element(F.split("text", " "), "the")).select("doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS exported FROM lineitem WHERE l_returnflag = 'A'")
def three_valued(t):
    flag = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return filters.three_valued(t("lineitem").withColumn("exported", flag), "exported", True).select("l_orderkey", "l_linenumber", "l_partkey", "exported")


_SUP = "(SELECT DISTINCT 's' || l_suppkey AS callee, 'o' || l_orderkey AS caller FROM lineitem UNION SELECT DISTINCT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"


def _call_edges(t):
    one = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("callee"), F.concat(F.lit("o"), "l_orderkey").alias("caller"))
    return one.unionByName(t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("callee"), F.concat(F.lit("c"), "o_custkey").alias("caller")))


@query(f"WITH e AS {_SUP}, h1 AS (SELECT callee, caller, 1 AS hop FROM e WHERE callee IN ('s1', 's2')), h2 AS (SELECT DISTINCT e.callee, e.caller, 2 AS hop FROM e JOIN h1 ON e.callee = h1.caller) SELECT * FROM h1 UNION ALL SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.callee = h2.callee AND h1.caller = h2.caller)")
def walk_callers(t):
    edges = _call_edges(t)
    seeds = edges.where(F.col("callee").isin("s1", "s2")).select("callee")
    return graph.walk(edges, seeds, 2, "callee", "caller").select("callee", "caller", "hop")


@query(f"WITH e AS {_SUP}, h1 AS (SELECT callee, caller, 1 AS hop FROM e WHERE caller IN ('c1', 'c4', 'c7')), h2 AS (SELECT DISTINCT e.callee, e.caller, 2 AS hop FROM e JOIN h1 ON e.caller = h1.callee) SELECT * FROM h1 UNION ALL SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.callee = h2.callee AND h1.caller = h2.caller)")
def walk_callees(t):
    edges = _call_edges(t)
    seeds = edges.where(F.col("caller").isin("c1", "c4", "c7")).select("caller")
    return graph.walk(edges, seeds, 2, "caller", "callee").select("callee", "caller", "hop")


@query("WITH RECURSIVE d AS (SELECT p_partkey AS node, 1 AS depth FROM part WHERE p_partkey // 2 = 3 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN d ON p_partkey // 2 = node) SELECT node, depth FROM d")
def hierarchy_closure(t):
    edges = t("part").select(F.col("p_partkey").alias("child"), F.expr("p_partkey DIV 2").alias("parent")).where("child <> parent")
    return graph.closure(edges, edges.where("parent = 3").select("parent"))


@query("WITH RECURSIVE d AS (SELECT p_partkey AS node, 1 AS depth FROM part WHERE p_partkey // 2 = 3 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN d ON p_partkey // 2 = node) SELECT node, depth FROM d")
def hierarchy_closure_in_one_plan(t):
    edges = t("part").select(F.col("p_partkey").alias("child"), F.expr("p_partkey DIV 2").alias("parent")).where("child <> parent")
    return graph.closure_in_one_plan(edges, edges.where("parent = 3").select("parent"))


@query("SELECT l_orderkey, sha256(string_agg(s, '|' ORDER BY s)) AS sig_hash FROM (SELECT l_orderkey, l_linenumber || ':' || l_returnflag || ':' || l_linestatus AS s FROM lineitem) GROUP BY l_orderkey")
def feature_hash(t):
    return diff.feature_hash(t("lineitem"), ["l_orderkey"], F.concat_ws(":", "l_linenumber", "l_returnflag", "l_linestatus"))


_SIG = "SELECT o_orderkey, year(o_orderdate) AS y, sha256(string_agg(s, '|' ORDER BY s)) AS sig_hash FROM orders JOIN (SELECT l_orderkey, l_returnflag || l_linestatus || (l_partkey % 5) AS s FROM lineitem) ON l_orderkey = o_orderkey WHERE year(o_orderdate) IN (1996, 1997) GROUP BY o_orderkey, o_orderdate"


@query(f"WITH f AS ({_SIG}), one AS (SELECT y, sig_hash, min(o_orderkey) AS k FROM f GROUP BY y, sig_hash HAVING count(*) = 1) SELECT a.sig_hash, a.k AS key_a, b.k AS key_b FROM one a JOIN one b ON a.sig_hash = b.sig_hash WHERE a.y = 1996 AND b.y = 1997")
def exact_structure_pairs(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus", F.col("l_partkey") % 5).alias("s"))
    orders = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y")).where(F.col("y").isin(1996, 1997))
    feats = diff.feature_hash(lines.join(orders, "o_orderkey"), ["o_orderkey", "y"], F.col("s"))
    return diff.exact_pairs(feats.where("y = 1996"), feats.where("y = 1997"), "o_orderkey", "sig_hash")


@query("WITH f AS (SELECT o_custkey AS cust, o_orderkey AS k, list(DISTINCT l_partkey % 50) AS s, year(o_orderdate) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate), p AS (SELECT a.k AS key_a, b.k AS key_b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS score FROM f a JOIN f b ON a.cust = b.cust WHERE a.y < 1998 AND b.y >= 1998), r AS (SELECT *, row_number() OVER (PARTITION BY key_b ORDER BY score DESC, key_a) AS rn FROM p WHERE score >= 0.1) SELECT key_a, key_b, score FROM r WHERE rn = 1")
def fuzzy_best(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("s"))
    feats = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("y")).join(lines.groupBy("k").agg(F.collect_set("s").alias("s")), "k")
    score = F.round(jaccard(F.col("s_a"), F.col("s_b")), 6)
    return diff.best_of(diff.candidates(feats.where("y < 1998").drop("y"), feats.where("y >= 1998").drop("y"), "k", "cust", score, 0.1).withColumnsRenamed({"k_a": "key_a", "k_b": "key_b"})).select("key_a", "key_b", "score")


@query("WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997) SELECT o_custkey, 'removed' AS kind FROM a WHERE o_custkey NOT IN (SELECT * FROM b) UNION ALL SELECT o_custkey, 'added' FROM b WHERE o_custkey NOT IN (SELECT * FROM a)")
def added_removed(t):
    of = lambda y: t("orders").where(F.year("o_orderdate") == y)
    return diff.added_removed(of(1996), of(1997), ["o_custkey"])


@query("SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def unchanged(t):
    of = lambda y: t("orders").where(F.year("o_orderdate") == y)
    return diff.unchanged(of(1996), of(1997), ["o_custkey"])


@query("WITH c AS (SELECT doc_id, source, ch, count(*) AS k FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY doc_id, source, ch), n AS (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS n FROM c), h AS (SELECT doc_id, source, -sum((k / n) * log2(k / n)) AS h FROM n GROUP BY doc_id, source) SELECT source, round(avg(h), 4) AS mean_entropy FROM h GROUP BY source")
def string_entropy(t):
    return t("documents").where("text <> ''").select("source", entropy(F.col("text")).alias("h")).groupBy("source").agg(F.round(F.avg("h"), 4).alias("mean_entropy"))


RULES = (("license", "(MIT|Apache) License", "open"), ("mail", "[a-z0-9]+@[a-z0-9.]+", "contact"), ("token", "token = ", "secret"))
_RULES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}', '{v}')" for n, p, v in RULES) + ") AS r(rule, pattern, vendor))"


def _rule_hits(t):
    docs = t("documents")
    return rules.scan_rules(docs.select("doc_id", "source", "text"), "text", docs.sparkSession.createDataFrame(RULES, "rule string, pattern string, vendor string"))


@query(f"SELECT doc_id, rule, vendor FROM documents JOIN {_RULES_SQL} ON regexp_matches(text, pattern)")
def rule_scan(t):
    return _rule_hits(t).select("doc_id", "rule", "vendor")


@query("SELECT l_orderkey, l_linenumber, 'o' || CAST(o_orderkey AS STRING) AS rule FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 10 = 7")
def rule_scan_many(t):
    """A rule for each order, thousands of them, over the texts of all line items."""
    texts = t("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("order="), F.col("l_orderkey").cast("string"), F.lit(";part="), F.col("l_partkey").cast("string"), F.lit(";")).alias("text"))
    key = F.col("o_orderkey").cast("string")
    many = t("orders").select(F.concat(F.lit("o"), key).alias("rule"), F.concat(F.lit("order="), key, F.lit(";part=[0-9]*7;")).alias("pattern"))
    return rules.scan_rules(texts, "text", many).select("l_orderkey", "l_linenumber", "rule")


@query(f"SELECT source, bool_or(rule = 'token') AS strong, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS vendors, count(vendor) AS findings, CASE WHEN bool_or(rule = 'token') THEN 'high' ELSE 'medium' END AS confidence FROM documents JOIN {_RULES_SQL} ON regexp_matches(text, pattern) GROUP BY source")
def evidence_confidence(t):
    return rules.evidence_rollup(_rule_hits(t), ["source"], F.col("rule") == "token")


@query("WITH c AS (SELECT o_orderkey, unnest(['status:' || o_orderstatus, 'priority:' || o_orderpriority]) AS comp FROM orders), k AS (SELECT o_orderkey, split_part(comp, ':', 1) AS kind, split_part(comp, ':', 2) AS name FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o_orderkey) AS rn FROM k WHERE lower(name) LIKE '%o%' OR lower(name) LIKE '%u%') SELECT o_orderkey, kind, name, rn FROM r WHERE rn <= 60")
def component_explode(t):
    parts = F.array(F.struct(F.lit("status").alias("kind"), F.col("o_orderstatus").alias("name")), F.struct(F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("name")))
    each = t("orders").select("o_orderkey", F.inline(parts))
    named = each.where(F.lower("name").contains("o") | F.lower("name").contains("u"))
    return ranking.top_k(named, ["kind"], ["o_orderkey"], 60)


@query("SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (upper(o_orderpriority) LIKE '%URGENT%' OR upper(o_orderpriority) LIKE '%HIGH%') AS dangerous, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM orders")
def security_rollup(t):
    urgent = filters.any_keyword(F.col("o_orderpriority"), ("URGENT", "HIGH"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return t("orders").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), joined("o_orderpriority").alias("priorities"), joined(F.when(urgent, F.col("o_orderpriority"))).alias("dangerous"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT doc_id, bytes, running FROM (SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS bytes, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) WHERE running <= 32768")
def response_budget(t):
    return ranking.within_budget(t("documents").select("doc_id", "source", "text"), "text", ["doc_id"], 32768, ["source"]).select("doc_id", "bytes", "running")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(t):
    return ranking.top_k(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rn")


_LINE = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE}) AS rn FROM lineitem) WHERE rn = 1")
def first_wins(t):
    return ranking.first_wins(t("lineitem"), ["l_orderkey", "l_linenumber"], _LINE.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_dedupe(t):
    return ranking.content_groups(t("documents"), "text", "doc_id")


@query("""SELECT doc_id, unnest(regexp_extract_all(text, '"([^"]{2,80})"', 1)) AS keyword FROM documents""")
def keyword_extract(t):
    return t("documents").select("doc_id", F.explode(quoted_spans(F.col("text"))).alias("keyword"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_args(t):
    return match.count_by(t("events"), ["event_type", F.get_json_object("props", "$.k").cast("int").alias("k")])


@query("SELECT l_orderkey, l_partkey, CASE l_linenumber WHEN 1 THEN 'invoke-virtual' WHEN 2 THEN 'invoke-super' WHEN 3 THEN 'invoke-direct' WHEN 4 THEN 'invoke-static' END AS kind FROM lineitem WHERE l_quantity > 45")
def kind_decode(t):
    names = {1: "invoke-virtual", 2: "invoke-super", 3: "invoke-direct", 4: "invoke-static"}
    return t("lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey", match.decode(F.col("l_linenumber"), names).alias("kind"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)")
def candidate_contains_join(t):
    needles = t("benchmark").select("item_id", F.col("text").alias("needle"))
    return match.contained_in(needles, t("documents").select("doc_id", "text"), "needle", "text").select("doc_id", "item_id")


@query("SELECT source, count(DISTINCT lang) AS owners FROM documents GROUP BY source")
def owner_refcount(t):
    return match.ref_count(t("documents"), "source", "lang")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_upsert(t):
    return ranking.latest(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(open, 0) AS open FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def member_counts(t):
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    open_orders = orders.where("o_orderstatus = 'O'")
    return match.with_counts(t("customer").select("c_custkey"), ["c_custkey"], {"orders": orders, "open": open_orders})


@query("SELECT o_custkey, o_orderpriority, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS overloads, o_orderkey FROM orders")
def overload_count(t):
    counted = match.with_overloads(t("orders"), ["o_custkey", "o_orderpriority"], "overloads")
    return counted.select("o_custkey", "o_orderpriority", "overloads", "o_orderkey")


@query("SELECT l_orderkey AS caller, l_suppkey AS callee, count(*) AS hits FROM lineitem GROUP BY l_orderkey, l_suppkey")
def edge_hits(t):
    return match.count_by(t("lineitem"), [F.col("l_orderkey").alias("caller"), F.col("l_suppkey").alias("callee")], "hits")


@query("SELECT o_orderkey, l_partkey, p_name, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size = 7 AND o_orderstatus = 'F'")
def inverted_index_probe(t):
    parts = t("part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    orders = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    suppliers = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    hits = match.probe(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), [(parts, "l_partkey"), (orders, "l_orderkey"), (suppliers, "l_suppkey")])
    return hits.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "p_name", "s_name")
