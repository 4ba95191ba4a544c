"""The code index's own plans as queries: driver tables are read as the tables of a code index, and each plan of the engine runs over them.

Parts are classes (their keys halved give the super class), line items are methods, fields, string references and calls, suppliers are
components, nations are native libraries, customers are resource entries. MAPPING says so in the part of SQL that Spark and DuckDB share;
the plans are then written once as DataFrames (plans/tools.py) and once more as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import descriptors as d
from lodeframe.functions.text import combined_sha
from lodeframe.operators import grams, match, ranking
from lodeframe.plans import packers
from lodeframe.plans.tools import Engine
from lodeframe.sources import ingest
from lodeframe.tables import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CLASS = "'Lcom/' || lower(p_type) || '/b' || CAST(p_size AS STRING) || '/C' || CAST(p_partkey AS STRING) || ';'"
_NAME = "CASE l_linenumber WHEN 1 THEN '<init>' WHEN 2 THEN '<clinit>' ELSE 'm' || CAST(l_linenumber AS STRING) END"
_PARAMS = "CASE l_suppkey % 5 WHEN 0 THEN '()' WHEN 1 THEN '(I)' WHEN 2 THEN '(Ljava/lang/String;[J)' WHEN 3 THEN '(Lcom/a/B;I)' ELSE '([[Ljava/lang/Object;)' END"
_RETURN = "CASE l_returnflag WHEN 'A' THEN 'V' WHEN 'N' THEN 'Ljava/lang/String;' ELSE '[I' END"
_CALL = "SELECT descriptor AS owner, {name} AS name, {params} AS params, {ret} AS ret, l_orderkey AS o, l_linenumber AS l, l_suppkey AS s, l_linestatus AS st FROM lineitem JOIN classes ON l_partkey = p_partkey".format(name=_NAME, params=_PARAMS, ret=_RETURN)
_KEY = "{0}.owner || '->' || {0}.name || {0}.params || {0}.ret"

#: Each table of the index, as SQL over the driver's tables and those before it. {list} makes an array.
MAPPING = {
    "base": f"SELECT p_partkey, {_CLASS} AS descriptor, p_name FROM part",
    "classes": "SELECT p.p_partkey, CAST(p.p_partkey % 3 AS INT) AS dex_idx, b.descriptor, 'C' || CAST(p.p_partkey AS STRING) AS simple_name, 'com/' || lower(p.p_type) || '/b' || CAST(p.p_size AS STRING) AS package, CASE p.p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1025 WHEN 2 THEN 1537 WHEN 3 THEN 16401 WHEN 4 THEN 9729 ELSE 17 END AS access_flags, CASE WHEN p.p_partkey = 0 THEN 'Ljava/lang/Object;' ELSE u.descriptor END AS super_descriptor, CASE WHEN p.p_partkey % 5 = 0 THEN {list}('Lapi/I' || CAST(p.p_partkey % 3 AS STRING) || ';', 'Lapi/Any;') ELSE {list}('Lapi/Any;') END AS interfaces, CASE p.p_size % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'library' ELSE 'system' END AS source, 'base.apk' AS origin_file, CASE p.p_partkey % 6 WHEN 1 THEN 'abstract' WHEN 2 THEN 'interface' WHEN 3 THEN 'enum' WHEN 4 THEN 'interface' ELSE 'class' END AS kind, CAST(NULL AS STRING) AS source_file FROM part p JOIN base b ON b.p_partkey = p.p_partkey LEFT JOIN base u ON u.p_partkey = CAST(floor(p.p_partkey / 2) AS BIGINT)",
    "calls": _CALL,
    "methods": f"SELECT owner AS class_descriptor, name, params AS params_descriptor, ret AS return_descriptor, {_KEY.format('c')} AS method_key, max(CASE WHEN l <= 2 THEN 65536 ELSE 0 END + CASE st WHEN 'F' THEN 9 ELSE 1 END) AS access_flags, max(st) = 'F' AS is_static, name = '<init>' AS is_constructor, true AS has_refs, false AS partial, CASE params WHEN '()' THEN 0 WHEN '(I)' THEN 1 WHEN '([[Ljava/lang/Object;)' THEN 1 ELSE 2 END AS param_count, 'V' AS shorty FROM calls c GROUP BY owner, name, params, ret",
    "fields": "SELECT owner AS class_descriptor, 'f' || CAST(s % 4 AS STRING) AS name, min(CASE l % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'Ljava/util/List;' ELSE '[B' END) AS type_descriptor, max(CASE st WHEN 'F' THEN 26 ELSE 130 END) AS access_flags, max(CASE st WHEN 'F' THEN 26 ELSE 130 END) <> 130 AS is_static FROM calls GROUP BY owner, s % 4",
    "string_refs": f"SELECT DISTINCT {_KEY.format('c')} AS method_key, 'Key_' || CAST(s AS STRING) || '/' || st AS value FROM calls c",
    "strings": "SELECT DISTINCT value, lower(value) AS lc, length(value) AS len FROM string_refs",
    "xref_edges": f"SELECT caller_key, kind, callee_owner || '->' || callee_name || CASE WHEN kind > 9 THEN ':' ELSE callee_params END || callee_ret AS callee_descriptor, callee_owner, callee_name, CASE WHEN kind > 9 THEN '' ELSE callee_params END AS callee_params, callee_ret, count(*) AS hits FROM (SELECT {_KEY.format('a')} AS caller_key, CASE WHEN a.s % 3 = 0 THEN 10 + a.l % 4 ELSE 1 + a.l % 5 END AS kind, b.owner AS callee_owner, b.name AS callee_name, b.params AS callee_params, b.ret AS callee_ret FROM calls a JOIN calls b ON a.o = b.o AND b.l = a.l + 1) e GROUP BY caller_key, kind, callee_owner, callee_name, callee_params, callee_ret",
    "annotations": "SELECT descriptor AS class_descriptor, CAST(NULL AS STRING) AS method_key, CASE p_partkey % 10 WHEN 0 THEN 'Lnote/Keep;' ELSE 'Lother/note/keep;' END AS descriptor, CAST(p_partkey % 3 AS INT) AS visibility, '{{}}' AS args FROM classes WHERE p_partkey % 5 = 0",
    "components": "SELECT CASE s_nationkey % 4 WHEN 0 THEN 'activity' WHEN 1 THEN 'service' WHEN 2 THEN 'receiver' ELSE 'provider' END AS type, 'com.x.' || s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS exported, CASE WHEN s_suppkey % 2 = 0 THEN 'p.READ' END AS permission, CAST(NULL AS STRING) AS process, true AS enabled FROM supplier",
    "native_libs": "SELECT CASE n_regionkey % 2 WHEN 0 THEN 'arm64-v8a' ELSE 'x86' END AS abi, CASE n_nationkey % 5 WHEN 0 THEN 'libjiagu_' || CAST(n_nationkey AS STRING) || '.so' ELSE 'lib' || lower(n_name) || '.so' END AS name, CAST(n_nationkey AS BIGINT) AS size, 'base.apk' AS origin FROM nation",
    "resource_entries": "SELECT 'com.x' AS pkg, lower(c_mktsegment) AS type, c_name AS name, 1 AS type_id, CAST(c_custkey AS INT) AS entry_id, 'r' || CAST(c_custkey AS STRING) AS id FROM customer",
}


class Mapped:
    """What an engine needs of an index, over the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.tables, self.pooled = spark, {}, False
        self.source = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("part", "lineitem", "supplier", "nation", "customer")}
        for name in MAPPING:
            self.tables[name] = self.mapped(name, self.tables)
        own = ingest.probed(*[self.tables[n].withColumn("session_id", F.lit("s")) for n in ("string_refs", "xref_edges")])
        self.tables |= {name: df.drop("session_id") for name, df in own.items()}

    def mapped(self, name: str, tables: dict[str, DataFrame], distinct: bool = True) -> DataFrame:
        """A table of the index over the driver's tables and `tables`; if not distinct, with the rows that SELECT DISTINCT would drop."""
        sql = MAPPING[name] if distinct else MAPPING[name].replace("SELECT DISTINCT", "SELECT")
        known = {k: v for k, v in {**self.source, **tables}.items() if k in sql}
        text = sql.replace("{list}", "array")
        for k in sorted(known, key=len, reverse=True):
            text = _rename(text, k)
        return self.spark.sql(text, **{f"t_{k}": v for k, v in known.items()})

    def table(self, name: str, session_id: str | None = None) -> DataFrame:
        if name in ("strings", "string_grams") and not self.pooled:
            # The pool is small beside the references that it is made of, and searches read it more than once.
            self.tables["strings"] = materialize(self.tables["strings"], "strings")
            self.tables["string_grams"] = grams.postings(self.tables["strings"], [], "id", "lc")
            self.pooled = True
        return self.tables[name].withColumn("session_id", F.lit("s"))

    def exists(self, name: str) -> bool:
        return True

    def session(self, name: str, owner: str | None = None) -> str:
        return "s"


def _rename(sql: str, table: str) -> str:
    """The table's name after FROM and JOIN as a parameter of spark.sql."""
    for word in ("FROM", "JOIN"):
        parts = f"{sql} ".split(f"{word} {table} ")
        sql = f"{word} {{t_{table}}} ".join(parts).rstrip()
    return sql.replace(f"FROM {table})", f"FROM {{t_{table}}})")


WITH = "WITH " + ", ".join(f"{name} AS ({sql.replace('{list}', 'list_value').replace('{{}}', '{}')})" for name, sql in MAPPING.items()) + " "


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Engine(spark, index=Mapped(spark, sf_dir)))
        ORACLE_SQL[fn.__name__] = WITH + sql
        return fn

    return register


# ---------------------------------------------------------------- names and descriptors


def _java(x: str) -> str:
    """SQL: the Java name of a descriptor."""
    core = f"ltrim({x}, '[')"
    plain = f"CASE {core} WHEN 'V' THEN 'void' WHEN 'I' THEN 'int' WHEN 'J' THEN 'long' WHEN 'B' THEN 'byte' WHEN 'Z' THEN 'boolean' ELSE replace(substr({core}, 2, length({core}) - 2), '/', '.') END"
    return f"({plain} || repeat('[]', length({x}) - length({core})))"


_SPELLED = ("'int'", "' a.b.C' || k", "'a/b/C' || k", "'La/b/C' || k || ';'", "'int[]'", "'[I'", "'a.C' || k || '[] []'", "'[[La.b.C' || k || ';'", "'J'", "'C' || k || '$D'")
_DESCRIPTORS = ("'I'", "'La/b/C' || k || ';'", "'La/b/C' || k || ';'", "'La/b/C' || k || ';'", "'[I'", "'[I'", "'[[La/C' || k || ';'", "'[[La/b/C' || k || ';'", "'J'", "'LC' || k || '$D;'")
_BINARY = ("'int'", "'a.b.C' || k", "'a.b.C' || k", "'a.b.C' || k", "'int[]'", "'int[]'", "'a.C' || k || '[][]'", "'a.b.C' || k || '[][]'", "'long'", "'C' || k || '$D'")
_INTERNAL = ("'int'", "'a.b.C' || k", "'a.b.C' || k", "'a.b.C' || k", "'[I'", "'[I'", "'[[La.C' || k || ';'", "'[[La.b.C' || k || ';'", "'long'", "'C' || k || '$D'")
_SIMPLE = ("'int'", "'C' || k", "'C' || k", "'C' || k", "'int[]'", "'int[]'", "'C' || k || '[][]'", "'C' || k || '[][]'", "'long'", "'C' || k || '$D'")


def _case(values: tuple[str, ...]) -> str:
    return "CASE p % 10 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_TYPES = "(SELECT p_partkey AS p, CAST(p_partkey AS STRING) AS k FROM part) t"


def _spellings(e: Engine) -> DataFrame:
    part = e.index.tables["base"].select(F.col("p_partkey").alias("p"), F.col("p_partkey").cast("string").alias("k"))
    return part.withColumn("spelling", F.expr(_case(_SPELLED)))


@query(f"SELECT p, {_case(_SPELLED)} AS spelling, {_case(_DESCRIPTORS)} AS descriptor FROM {_TYPES}")
def normalize_spellings(e):
    return _spellings(e).select("p", "spelling", d.normalize_desc(F.col("spelling")).alias("descriptor"))


@query(f"SELECT p, {_case(_BINARY)} AS binary_name, {_case(_INTERNAL)} AS internal_name, {_case(_SIMPLE)} AS simple_java, 'Class.forName(\"' || {_case(_BINARY)} || '\")' AS for_name, 'Class.forName(\"' || {_case(_BINARY)} || '\", true, classLoader)' AS for_name_loader FROM {_TYPES}")
def type_names(e):
    desc = d.normalize_desc(F.col("spelling"))
    return _spellings(e).select("p", d.binary_name(desc).alias("binary_name"), d.internal_name(desc).alias("internal_name"), d.java_type(desc, True).alias("simple_java"), d.class_for_name(desc).alias("for_name"), d.class_for_name(desc, True).alias("for_name_loader"))


_LIST = "CASE params_descriptor WHEN '()' THEN '' WHEN '(I)' THEN 'I' WHEN '(Ljava/lang/String;[J)' THEN 'Ljava/lang/String; [J' WHEN '(Lcom/a/B;I)' THEN 'Lcom/a/B; I' ELSE '[[Ljava/lang/Object;' END"
_SHORTY = "CASE return_descriptor WHEN 'V' THEN 'V' ELSE 'L' END || CASE params_descriptor WHEN '()' THEN '' WHEN '(I)' THEN 'I' WHEN '(Ljava/lang/String;[J)' THEN 'LL' WHEN '(Lcom/a/B;I)' THEN 'LI' ELSE 'L' END"


@query(f"SELECT method_key, {_LIST} AS types, params_descriptor AS joined, {_SHORTY} AS shorty FROM methods")
def parameter_lists(e):
    types = d.split_params(F.col("params_descriptor"))
    return e.index.table("methods").select("method_key", F.array_join(types, " ").alias("types"), d.join_params(types).alias("joined"), d.shorty(types, F.col("return_descriptor")).alias("shorty"))


_ARGS = "CASE params_descriptor WHEN '()' THEN '' WHEN '(I)' THEN 'int' WHEN '(Ljava/lang/String;[J)' THEN 'java.lang.String, long[]' WHEN '(Lcom/a/B;I)' THEN 'com.a.B, int' ELSE 'java.lang.Object[][]' END"
_JAVA = f"'public ' || CASE WHEN access_flags % 16 = 9 THEN 'static ' ELSE '' END || CASE WHEN name = '<init>' THEN {_java('class_descriptor')} ELSE {_java('return_descriptor')} || ' ' || name END || '(' || {_ARGS} || ')'"


@query(f"SELECT class_descriptor || '->' || name || params_descriptor || return_descriptor AS smali, {_java('class_descriptor')} || '->' || name || params_descriptor || return_descriptor AS reflector, {_JAVA} AS java, name = '<init>' AS constructor FROM methods")
def method_spellings(e):
    m = e.index.table("methods")
    own = [F.col(c) for c in ("class_descriptor", "name", "params_descriptor", "return_descriptor")]
    forms = d.method_forms(*own, F.col("access_flags"))
    return m.select(forms.alias("f"), "is_constructor").select("f.smali", "f.reflector", "f.java", F.col("is_constructor").alias("constructor"))


_FIELD_WORDS = "CASE access_flags WHEN 26 THEN 'private,static,final' ELSE 'private,transient' END"
_FIELD_JAVA = f"CASE access_flags WHEN 26 THEN 'private static final ' ELSE 'private ' END || {_java('type_descriptor')} || ' ' || name"


@query(f"SELECT class_descriptor || '->' || name || ':' || type_descriptor AS smali, {_java('class_descriptor')} || '->' || name || ':' || type_descriptor AS reflector, {_FIELD_JAVA} AS java, {_FIELD_WORDS} AS modifiers, {_java('type_descriptor')} AS type FROM fields")
def field_spellings(e):
    own = [F.col(c) for c in ("class_descriptor", "name", "type_descriptor", "access_flags")]
    words = F.array_join(d.flag_names(F.col("access_flags"), d.FIELD_FLAGS), ",")
    return e.index.table("fields").select(d.field_forms(*own).alias("f"), words.alias("modifiers")).select("f.smali", "f.reflector", "f.java", "modifiers", "f.type")


@query("SELECT method_key, 'public' || CASE WHEN access_flags % 16 = 9 THEN ',static' ELSE '' END || CASE name WHEN '<init>' THEN ',constructor' WHEN '<clinit>' THEN ',static-initializer' ELSE '' END AS words FROM methods")
def method_flag_words(e):
    return e.index.table("methods").select("method_key", F.array_join(d.method_flag_names(F.col("access_flags"), F.col("name")), ",").alias("words"))


@query("SELECT descriptor, kind, simple_name, package FROM classes")
def class_kinds(e):
    desc = F.col("descriptor")
    return e.index.table("classes").select(desc, d.class_kind(F.col("access_flags")).alias("kind"), d.simple_name(desc).alias("simple_name"), d.package_of(desc).alias("package"))


@query("SELECT name AS library, regexp_replace(name, '[.]so$', '') AS plain FROM native_libs")
def library_names(e):
    full = F.concat(F.lit("lib/"), "abi", F.lit("/"), "name")
    return e.index.table("native_libs").select(F.col("name").alias("library"), packers.library_name(full).alias("plain"))


@query("SELECT source, CASE WHEN count(*) = 1 THEN min(sha256(descriptor)) ELSE sha256(string_agg(simple_name || ':' || sha256(descriptor), chr(10) ORDER BY simple_name)) END AS sha FROM classes GROUP BY source")
def combined_digests(e):
    files = F.collect_list(F.struct(F.col("simple_name").alias("name"), F.sha2("descriptor", 256).alias("sha")))
    return e.index.table("classes").groupBy("source").agg(combined_sha(files).alias("sha"))


# ---------------------------------------------------------------- classes and members

_CLASS_ITEM = f"SELECT c.descriptor, {_java('c.descriptor')} AS \"binaryName\", replace(c.package, '/', '.') AS package, c.kind, c.source, {_java('c.super_descriptor')} AS \"superClass\", array_to_string([replace(substr(i, 2, length(i) - 2), '/', '.') for i in c.interfaces], ',') AS interfaces, coalesce(m.n, 0) AS methods, coalesce(f.n, 0) AS fields FROM classes c LEFT JOIN (SELECT class_descriptor, count(*) AS n FROM methods GROUP BY class_descriptor) m ON m.class_descriptor = c.descriptor LEFT JOIN (SELECT class_descriptor, count(*) AS n FROM fields GROUP BY class_descriptor) f ON f.class_descriptor = c.descriptor"


def _class_items(e: Engine, found: DataFrame) -> DataFrame:
    return e.class_items("s", found).select("descriptor", "binaryName", "package", "kind", "source", "superClass", F.array_join("interfaces", ",").alias("interfaces"), "methods", "fields")


@query(_CLASS_ITEM)
def class_items(e):
    return _class_items(e, e.index.table("classes"))


@query(_CLASS_ITEM + " WHERE c.simple_name = 'C17' OR c.descriptor = 'Lcom/none/C17;'")
def search_classes_exact(e):
    return _class_items(e, e.found_classes("s", "C17", "exact"))


@query(_CLASS_ITEM + " WHERE c.source = 'app' AND (c.descriptor ILIKE 'Lcom/promo%' OR c.package ILIKE 'com/promo%' OR c.simple_name ILIKE 'com.promo%')")
def search_classes_prefix(e):
    return _class_items(e, e.found_classes("s", "com.promo", "prefix", "app"))


@query(_CLASS_ITEM + " WHERE replace(c.package, '/', '.') ILIKE 'com.small.b1%'")
def search_classes_package(e):
    return _class_items(e, e.found_classes("s", "x", "prefix", package_filter="com/small/b1"))


@query(_CLASS_ITEM + " WHERE c.source IN ('library', 'system') AND regexp_matches(c.simple_name, '^C[0-9]?7$')")
def search_classes_regex(e):
    return _class_items(e, e.found_classes("s", "^C[0-9]?7$", "regex", "library"))


@query(_CLASS_ITEM + " WHERE c.descriptor IN (SELECT class_descriptor FROM annotations WHERE descriptor ILIKE '%/keep;')")
def search_classes_annotated(e):
    return _class_items(e, e.found_classes("s", annotated_with="@Keep"))


@query(_CLASS_ITEM + " WHERE c.descriptor IN (SELECT class_descriptor FROM annotations WHERE descriptor = 'Lnote/Keep;')")
def search_classes_annotated_full(e):
    return _class_items(e, e.found_classes("s", annotated_with="note.Keep"))


_METHOD_ITEM = f"SELECT m.method_key AS smali, {_java('m.class_descriptor')} AS class, c.source, c.dex_idx AS \"dexIdx\", m.name, CASE WHEN m.is_constructor THEN 'constructor' ELSE 'method' END AS kind, m.param_count AS \"paramCount\", {_java('m.return_descriptor')} AS \"returnType\" FROM methods m JOIN classes c ON c.descriptor = m.class_descriptor"


def _method_items(e: Engine, found: DataFrame) -> DataFrame:
    return e.method_items("s", found).select("smali", "class", "source", "dexIdx", "name", "kind", "paramCount", "returnType")


@query(_METHOD_ITEM)
def method_items(e):
    return _method_items(e, e.index.table("methods"))


@query(f"SELECT f.class_descriptor || '->' || f.name || ':' || f.type_descriptor AS smali, {_java('f.class_descriptor')} AS class, c.source, f.name, {_java('f.type_descriptor')} AS type, f.is_static AS static FROM fields f JOIN classes c ON c.descriptor = f.class_descriptor")
def field_items(e):
    return e.field_items("s", e.index.table("fields")).select("smali", "class", "source", "name", "type", "static")


@query("SELECT m.method_key, array_to_string(list_slice(list_sort(list(DISTINCT r.value), 'ASC'), 1, 1000), ',') AS strings FROM methods m JOIN (SELECT method_key, value, row_number() OVER (PARTITION BY method_key ORDER BY length(value) DESC, value) AS rn FROM string_refs) r ON r.method_key = m.method_key WHERE r.rn <= 6 GROUP BY m.method_key")
def method_evidence_strings(e):
    items = e.method_items("s", e.index.table("methods"), 6, ("strings",))
    return items.select("method_key", F.array_join(F.sort_array("referredStrings"), ",").alias("strings"))


@query("SELECT method_key, CASE WHEN k <= 9 THEN 'call' ELSE 'field' END AS what, array_to_string(list_slice(list(callee ORDER BY callee), 1, 6), ' ') AS members FROM (SELECT DISTINCT caller_key AS method_key, CASE WHEN kind <= 8 THEN 1 ELSE 10 END AS k, callee_descriptor AS callee FROM xref_edges WHERE kind <> 9) GROUP BY method_key, k")
def method_evidence_members(e):
    items = e.method_items("s", e.index.table("methods"), 6, ("members",))
    both = F.array(*[F.struct(F.lit(what).alias("what"), F.col(c).alias("own")) for what, c in (("call", "invokedMethods"), ("field", "accessedFields"))])
    return items.select("method_key", F.inline(both)).where("own IS NOT NULL").select("method_key", "what", F.array_join("own", " ").alias("members"))


# ---------------------------------------------------------------- strings

_HITS = "SELECT value, len, method_count, array_to_string(list(method_key ORDER BY method_key), ' ') AS methods FROM (SELECT r.value, length(r.value) AS len, r.method_key, count(*) OVER (PARTITION BY r.value) AS method_count, row_number() OVER (PARTITION BY r.value ORDER BY r.method_key) AS rn FROM string_refs r JOIN methods m ON m.method_key = r.method_key JOIN classes c ON c.descriptor = m.class_descriptor WHERE {0}) WHERE rn <= 8 GROUP BY value, len, method_count"


def _hits(e: Engine, *args) -> DataFrame:
    return e.string_hits("s", *args)[0].select("value", "len", "method_count", F.array_join("methods", " ").alias("methods"))


@query(_HITS.format("contains(lower(r.value), 'key_1')"))
def search_by_string_contains(e):
    return _hits(e, "KEY_1", "contains", "all", 8, 0)


@query(_HITS.format("r.value LIKE 'Key\\_2%' ESCAPE '\\' AND c.source = 'app'"))
def search_by_string_prefix(e):
    return _hits(e, "Key_2", "prefix", "app", 8, 0)


@query(_HITS.format("regexp_matches(r.value, '[37]/F$') AND length(r.value) >= 8 AND c.source = 'system'"))
def search_by_string_regex(e):
    return _hits(e, "[37]/F$", "regex", "system", 8, 8)


# ---------------------------------------------------------------- structure

_MATCH = "SELECT m.method_key FROM methods m JOIN classes c ON c.descriptor = m.class_descriptor WHERE {0}"


def _keys(found: DataFrame) -> DataFrame:
    return found.select("method_key")


@query(_MATCH.format("m.params_descriptor = '(Ljava/lang/String;[J)' AND m.return_descriptor = '[I'"))
def match_parameters_and_return(e):
    return _keys(e.matching_methods("s", params=["java.lang.String", "long[]"], return_type="int[]"))


@query(_MATCH.format("m.param_count = 2 AND m.params_descriptor LIKE '%I)' AND c.source = 'app'"))
def match_parameters_with_wildcard(e):
    return _keys(e.matching_methods("s", params="*,int", scope="app"))


@query(_MATCH.format("m.access_flags & 9 = 9 AND regexp_matches(m.name, '^m[3-5]$') AND replace(c.package, '/', '.') ILIKE 'com.large%'"))
def match_modifiers_name_package(e):
    return _keys(e.matching_methods("s", modifiers=["public", "static"], name_pattern="^m[3-5]$", package_prefix="com.large"))


@query(_MATCH.format("m.name = '<init>' AND EXISTS (SELECT 1 FROM string_refs r WHERE r.method_key = m.method_key AND r.value = 'Key_3/O')"))
def match_constructor_with_string(e):
    return _keys(e.matching_methods("s", referred_strings=["Key_3/O"], require_constructor=True))


@query(_MATCH.format("EXISTS (SELECT 1 FROM xref_edges x WHERE x.caller_key = m.method_key AND x.kind BETWEEN 1 AND 8 AND x.callee_name = 'm4') AND EXISTS (SELECT 1 FROM xref_edges x WHERE x.caller_key = m.method_key AND x.kind BETWEEN 10 AND 13 AND x.callee_name = 'm4' AND x.callee_ret = 'V')"))
def match_calls_and_fields(e):
    return _keys(e.matching_methods("s", invoked_methods=["m4"], accessed_fields=["m4:V"]))


@query("SELECT descriptor FROM classes WHERE list_contains(interfaces, 'Lapi/I1;')")
def implementations_direct(e):
    return e.implementations("s", interface="api.I1", transitive=False).select("descriptor")


@query("SELECT descriptor FROM classes WHERE p_partkey IN (SELECT p_partkey FROM (SELECT p_partkey, [CAST(p_partkey >> k AS BIGINT) for k in range(1, 40)] AS up FROM classes) WHERE list_has_any(up, [CAST(5 AS BIGINT)])) AND access_flags & 1536 = 0")
def implementations_below_concrete(e):
    five = e.index.tables["base"].where("p_partkey = 5").select("descriptor").first().descriptor
    return e.implementations("s", super_class=five, include_abstract=False).select("descriptor")


@query("SELECT descriptor FROM classes WHERE source = 'app' AND descriptor IN (SELECT class_descriptor FROM methods WHERE name = 'm3' AND params_descriptor = '(I)')")
def implementations_with_method(e):
    return e.implementations("s", method="m3(int)", scope="app").select("descriptor")


@query("SELECT class_descriptor AS descriptor, array_to_string(list(method_key ORDER BY method_key), ' ') AS sample FROM (SELECT class_descriptor, method_key, row_number() OVER (PARTITION BY class_descriptor ORDER BY name, method_key) AS rn FROM methods) WHERE rn <= 6 GROUP BY class_descriptor")
def sample_members(e):
    return e.sample_members("s").select("descriptor", F.array_join("sampleMembers", " ").alias("sample"))


# ---------------------------------------------------------------- calls

_KIND = "CASE kind WHEN 1 THEN 'invoke-virtual' WHEN 2 THEN 'invoke-super' WHEN 3 THEN 'invoke-direct' WHEN 4 THEN 'invoke-static' WHEN 5 THEN 'invoke-interface' END"
_INVOKE = "i AS (SELECT caller_key, callee_descriptor, kind, hits FROM xref_edges WHERE kind BETWEEN 1 AND 8)"


def _walk(seed: str, source: str, target: str) -> str:
    one = f"h1 AS (SELECT DISTINCT caller_key, callee_descriptor FROM i WHERE {source} IN ({seed}))"
    two = f"h2 AS (SELECT DISTINCT caller_key, callee_descriptor FROM i WHERE {source} IN (SELECT {target} FROM h1) EXCEPT SELECT caller_key, callee_descriptor FROM h1)"
    return f", {_INVOKE}, {one}, {two} SELECT h.depth, {_KIND} AS kind, i.hits, i.caller_key, i.callee_descriptor FROM (SELECT 1 AS depth, * FROM h1 UNION ALL SELECT 2, * FROM h2) h JOIN i ON i.caller_key = h.caller_key AND i.callee_descriptor = h.callee_descriptor"


def seeds(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Engine(spark, index=Mapped(spark, sf_dir)))
        ORACLE_SQL[fn.__name__] = WITH.rstrip() + sql
        return fn

    return register


@seeds(_walk("SELECT method_key FROM methods WHERE name = 'm7' AND params_descriptor = '(I)' AND return_descriptor = 'V'", "callee_descriptor", "caller_key"))
def xref_callers(e):
    start = e.index.table("methods").where("name = 'm7' AND params_descriptor = '(I)' AND return_descriptor = 'V'").select("method_key")
    return e.edges_met("s", start, "callers", 2)


@seeds(_walk("SELECT method_key FROM methods WHERE class_descriptor IN (SELECT descriptor FROM classes WHERE p_partkey < 4)", "caller_key", "callee_descriptor"))
def xref_callees(e):
    few = e.index.tables["classes"].where("p_partkey < 4").select(F.col("descriptor").alias("class_descriptor"))
    return e.edges_met("s", e.index.table("methods").join(few, "class_descriptor").select("method_key"), "callees", 2)


@seeds(f", {_INVOKE} SELECT 1 AS depth, {_KIND} AS kind, hits, caller_key, callee_descriptor FROM i WHERE callee_descriptor IN (SELECT method_key FROM methods WHERE name = 'm6') AND split_part(caller_key, '->', 1) IN (SELECT descriptor FROM classes WHERE source = 'app')")
def xref_callers_in_scope(e):
    return e.edges_met("s", e.index.table("methods").where("name = 'm6'").select("method_key"), "callers", 1, "app")


@seeds(f", {_INVOKE} SELECT DISTINCT method_key FROM (SELECT method_key FROM methods UNION SELECT callee_descriptor FROM i) WHERE contains(method_key, '->m5(I)V')")
def xref_seeds_by_name(e):
    return e.method_seeds("s", "m5(int): void")


# ---------------------------------------------------------------- manifest, resources, packers


@query("SELECT type, name, exported, permission FROM components WHERE type = 'service' AND contains(lower(name), 'supplier#00000000') AND exported = true")
def find_components(e):
    return e.components("s", "SUPPLIER#00000000", "service", True).select("type", "name", "exported", "permission")


@query("SELECT type, name, exported, permission FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name) AS rn FROM components WHERE exported = false) WHERE rn <= 3")
def manifest_components(e):
    found = e.components("s", "", "", False)
    return ranking.top_k(found, ["type"], ["name"], 3).select("type", "name", "exported", "permission")


@query("SELECT type, name, id FROM resource_entries WHERE contains(lower(name), '#00000001') AND type = 'building'")
def search_resources_contains(e):
    return e.found_resources("s", "#00000001", "contains", "building").select("type", "name", "id")


@query("SELECT type, name, id FROM resource_entries WHERE regexp_matches(name, '7[0-5]$')")
def search_resources_regex(e):
    return e.found_resources("s", "7[0-5]$", "regex").select("type", "name", "id")


@query("SELECT method_key, value, 'string' AS via FROM string_refs WHERE contains(value, 'Key_7/F')")
def resource_uses(e):
    return e.resource_uses("s", "Key_7/F")[0]


@query("SELECT name AS detail, 'native' AS type, '360 加固 (jiagu)' AS vendor, 'com.stub.StubApp' AS \"entryClassHint\" FROM native_libs WHERE name LIKE 'libjiagu%'")
def packer_native_evidence(e):
    none = e.spark.createDataFrame([], "session_id string, name string")
    apps = e.spark.createDataFrame([], "session_id string, application string")
    libs = e.index.table("native_libs").select("session_id", "name")
    found = packers.evidence(e.index.table("classes").select("session_id", "descriptor"), libs, none, apps)
    return found.select("detail", "type", "vendor", "entryClassHint")


# ---------------------------------------------------------------- comparison

_FEATURES = "SELECT c.descriptor, CAST(coalesce(m.sigs, '') AS STRING) AS sigs, coalesce(f.fields, '') AS fields, coalesce(s.strings, '') AS strings, substr(sha1(coalesce(m.sigs, '') || '#' || coalesce(f.fields, '') || '#' || coalesce(c.super_descriptor, '')), 1, 16) AS sig_hash FROM classes c LEFT JOIN (SELECT class_descriptor, string_agg(DISTINCT name || params_descriptor || return_descriptor, '|' ORDER BY name || params_descriptor || return_descriptor) AS sigs FROM methods GROUP BY class_descriptor) m ON m.class_descriptor = c.descriptor LEFT JOIN (SELECT class_descriptor, string_agg(DISTINCT name || ':' || type_descriptor, '|' ORDER BY name || ':' || type_descriptor) AS fields FROM fields GROUP BY class_descriptor) f ON f.class_descriptor = c.descriptor LEFT JOIN (SELECT cls, string_agg(value, '|' ORDER BY value) AS strings FROM (SELECT DISTINCT split_part(method_key, '->', 1) AS cls, value FROM string_refs) GROUP BY cls) s ON s.cls = c.descriptor"


@query(_FEATURES)
def class_features(e):
    return e.features("s", "all").select("descriptor", *[F.array_join(c, "|").alias(c) for c in ("sigs", "fields", "strings")], "sig_hash")


@query("SELECT source, count(*) AS classes, CAST(sum(m) AS BIGINT) AS methods FROM (SELECT c.source, coalesce(n, 0) AS m FROM classes c LEFT JOIN (SELECT class_descriptor, count(*) AS n FROM methods GROUP BY class_descriptor) x ON x.class_descriptor = c.descriptor) GROUP BY source")
def session_stats(e):
    counts = match.count_by(e.index.table("methods"), [F.col("class_descriptor").alias("descriptor")])
    found = e.index.table("classes").join(counts, "descriptor", "left")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.coalesce("n", F.lit(0))).alias("methods"))
