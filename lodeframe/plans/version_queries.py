"""Two versions of the code index (code_queries.MAPPING) compared: the second has other names for some classes, and lost some members.

Version 1 is the index but for classes whose number ends in 88, and all classes of a kind have one super class. Version 2 renames the
classes whose number ends in 3 and drops a method of theirs, some strings everywhere, and classes whose number ends in 77.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators import diff
from lodeframe.plans.code_queries import WITH, Mapped
from lodeframe.plans.tools import Engine
from lodeframe.tables import materialize

LOST_METHOD, LOST_STRING = "m4", "5/O"
#: Ends of the classes that a version doesn't have.
ABSENT = {"v1": "88;", "v2": "77;"}
_RENAMED = "/C([0-9]*3);"
_AGAIN = "/R([0-9]*3);"
#: As many classes are sent to all; where there are more, they and the line items are dealt by their key.
SENT = 1_000_000


class Versions(Mapped):
    """Sessions v1 and v2."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        # Both versions' classes are made of this.
        self.tables["classes"] = materialize(self.tables["classes"].drop("super_descriptor"), "mapped-classes")

    def table(self, name: str, session_id: str | None = None) -> DataFrame:
        df = super().table(name).withColumn("session_id", F.lit(session_id))
        if name == "classes":
            df = df.where(~F.col("descriptor").endswith(ABSENT[session_id])).withColumn("super_descriptor", F.concat(F.lit("Lbase/"), "kind", F.lit(";")))
        if session_id == "v2":
            if name == "methods":
                df = df.where(~(F.col("class_descriptor").rlike(_RENAMED) & (F.col("name") == LOST_METHOD)))
            if name == "string_refs":
                df = df.where(~F.col("value").endswith(LOST_STRING))
            for c in ("descriptor", "class_descriptor", "method_key"):
                if c in df.columns and name in ("classes", "methods", "fields", "string_refs"):
                    df = df.withColumn(c, F.regexp_replace(c, _RENAMED, "/R$1;"))
        return df

    def about(self, classes: dict[str, DataFrame]) -> Versions:
        """The versions with members of these classes alone, each as often as line items have it: sets are made of them. Line items of the
        others are left where they are read."""
        named = reduce(DataFrame.union, [df.select(F.regexp_replace("descriptor", _AGAIN, "/C$1;").alias("descriptor")) for df in classes.values()])
        kept = materialize(self.tables["classes"].select("p_partkey", "descriptor").join(named, "descriptor", "left_semi"), "own-mapped-classes")
        few = kept.count() <= SENT
        out = copy.copy(self)
        out.tables = {"calls": materialize(self.mapped("calls", {"classes": F.broadcast(kept) if few else kept}), "mapped-calls")}
        out.tables |= {"fields": self.mapped("fields", out.tables), "string_refs": self.mapped("string_refs", out.tables, distinct=False)}
        out.tables["methods"] = out.tables["calls"].select(F.col("owner").alias("class_descriptor"), "name", F.col("params").alias("params_descriptor"), F.col("ret").alias("return_descriptor"))
        return out

    def session(self, name: str, owner: str | None = None) -> str:
        return name


def diff_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of version 1 and what they are called in version 2."""
    renamed, *_ = Engine(spark, index=Versions(spark, sf_dir)).compare("v1", "v2", scope="all")
    return renamed.select("key_a", "key_b", "score", "how")


def diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchanged, renamed, removed and added classes of the two versions."""
    renamed, fa, fb, same = Engine(spark, index=Versions(spark, sf_dir)).compare("v1", "v2", scope="all")
    alone = lambda df, key: df.select("descriptor").join(same.union(renamed.select(key)), "descriptor", "left_anti")
    parts = {"unchanged": same, "renamed": renamed.select("key_b"), "removed": alone(fa, "key_a"), "added": alone(fb, "key_b")}
    rows = [df.toDF("descriptor").select(F.lit(change).alias("change"), "descriptor") for change, df in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"diff_renamed": diff_renamed, "diff_versions": diff_versions}


def _renamed(column: str, version: int) -> str:
    return column if version == 1 else f"regexp_replace({column}, '{_RENAMED}', '/R\\1;')"


def _features(version: int) -> str:
    """SQL: f1 or f2, a row for each class with its sets."""
    lost = "" if version == 1 else f" WHERE NOT (regexp_matches(class_descriptor, '{_RENAMED}') AND name = '{LOST_METHOD}')"
    kept = "" if version == 1 else f" WHERE value NOT LIKE '%{LOST_STRING}'"
    owner = _renamed("split_part(method_key, '->', 1)", version)
    lists = {"sigs": "name || params_descriptor || return_descriptor", "names": "name"}
    methods = ", ".join(f"list_sort(list(DISTINCT {sql})) AS {n}" for n, sql in lists.items())
    cls = _renamed("class_descriptor", version)
    return f"""f{version} AS MATERIALIZED (
    SELECT c.descriptor, c.super, c.n_interfaces, c.kind, coalesce(m.sigs, []) AS s0, coalesce(t.strings, []) AS s1, coalesce(f.names, []) AS s2, coalesce(m.names, []) AS s3, coalesce(f.fields, []) AS fields
    FROM (SELECT {_renamed("descriptor", version)} AS descriptor, 'Lbase/' || kind || ';' AS super, len(interfaces) AS n_interfaces, kind FROM classes WHERE descriptor NOT LIKE '%{ABSENT[f'v{version}']}') c
    LEFT JOIN (SELECT {cls} AS descriptor, {methods} FROM methods{lost} GROUP BY 1) m USING (descriptor)
    LEFT JOIN (SELECT {cls} AS descriptor, list_sort(list(DISTINCT name || ':' || type_descriptor)) AS fields, list_sort(list(DISTINCT name)) AS names FROM fields GROUP BY 1) f USING (descriptor)
    LEFT JOIN (SELECT {owner} AS descriptor, list_sort(list(DISTINCT value)) AS strings FROM string_refs{kept} GROUP BY 1) t USING (descriptor)
)"""


def _side(k: int) -> str:
    """SQL: o (classes of version k alone) and h (structures that one of them has alone)."""
    other = 3 - k
    return f"""o{k} AS MATERIALIZED (SELECT * FROM f{k} WHERE descriptor NOT IN (SELECT descriptor FROM f{other})),
h{k} AS MATERIALIZED (SELECT s0, fields, super, min(descriptor) AS descriptor FROM o{k} GROUP BY s0, fields, super HAVING count(*) = 1)"""


def _profiles(k: int) -> str:
    """SQL: u (elements of the other version in each bucket) and p (profiles) of version k."""
    other = 3 - k
    lists = ", ".join(f"list_distinct(flatten(list(s{n}))) AS l{n}" for n in range(4))
    kept = ", ".join(f"list_sort(list_filter(s{n}, lambda e: list_contains(coalesce(l{n}, []), e))) AS k{n}, len(s{n}) AS n{n}" for n in range(4))
    like = ", ".join(f"k{n}, n{n}" for n in range(4))
    return f"""u{k} AS MATERIALIZED (SELECT super, {lists} FROM r{other} GROUP BY super),
p{k} AS MATERIALIZED (SELECT super, n_interfaces, kind, {like}, min(descriptor) AS p, list_sort(list(descriptor)) AS members
    FROM (SELECT r.descriptor, r.super, r.n_interfaces, r.kind, {kept} FROM r{k} r LEFT JOIN u{k} USING (super)) GROUP BY super, n_interfaces, kind, {like})"""


def _part(n: int) -> str:
    common = f"len(list_intersect(a.k{n}, b.k{n}))"
    union = f"(a.n{n} + b.n{n} - {common})"
    return f"CASE WHEN {union} > 0 THEN {common} / {union} ELSE 0 END"


_W = [diff.WEIGHTS[n] for n in ("shape", "strings", "fields", "names")]
_SCORE = " + ".join(f"{w} * ({_part(n)})" for n, w in enumerate(_W)) + f" + {diff.WEIGHTS['interfaces']} * CASE WHEN a.n_interfaces = b.n_interfaces AND a.kind = b.kind THEN 1.0 ELSE {diff.OTHER_INTERFACES} END"

#: All pairs, then one after the other in order of score.
_COMPARED = (
    WITH.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""", {_features(1)}, {_features(2)}, {_side(1)}, {_side(2)},
exact AS MATERIALIZED (SELECT a.descriptor AS key_a, b.descriptor AS key_b, CAST(1.0 AS DOUBLE) AS score, 'exact-structure' AS how FROM h1 a JOIN h2 b USING (s0, fields, super)),
r1 AS MATERIALIZED (SELECT * FROM o1 WHERE descriptor NOT IN (SELECT key_a FROM exact)), r2 AS MATERIALIZED (SELECT * FROM o2 WHERE descriptor NOT IN (SELECT key_b FROM exact)),
{_profiles(1)}, {_profiles(2)},
scored AS MATERIALIZED (SELECT a.p AS pa, b.p AS pb, a.members AS ma, b.members AS mb, round({_SCORE}, 6) AS score FROM p1 a JOIN p2 b ON a.super = b.super),
listed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, md5(pa || '|' || pb), pa, pb) AS o FROM scored WHERE score >= 0.45),
each AS MATERIALIZED (SELECT o, score, ka, unnest(mb) AS kb FROM (SELECT o, score, mb, unnest(ma) AS ka FROM listed)),
pairs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o, ka, kb) AS o, score, ka, kb FROM each),
greedy AS (
    SELECT 0 AS step, CAST(NULL AS VARCHAR) AS ka, CAST(NULL AS VARCHAR) AS kb, CAST(NULL AS DOUBLE) AS score, CAST([] AS VARCHAR[]) AS used_a, CAST([] AS VARCHAR[]) AS used_b
    UNION ALL
    SELECT step + 1, x.ka, x.kb, x.score, list_append(used_a, x.ka), list_append(used_b, x.kb) FROM (
        SELECT g.step, g.used_a, g.used_b, arg_min({{'ka': p.ka, 'kb': p.kb, 'score': p.score}}, p.o) AS x
        FROM greedy g JOIN pairs p ON NOT list_contains(g.used_a, p.ka) AND NOT list_contains(g.used_b, p.kb) GROUP BY g.step, g.used_a, g.used_b)
),
renamed AS (SELECT * FROM exact UNION ALL SELECT ka, kb, score, 'fuzzy' FROM greedy WHERE step > 0) """
)
ORACLE_SQL = {
    "diff_renamed": _COMPARED + "SELECT key_a, key_b, CAST(score AS DOUBLE) AS score, how FROM renamed",
    "diff_versions": _COMPARED
    + "SELECT 'unchanged' AS change, descriptor FROM f1 WHERE descriptor IN (SELECT descriptor FROM f2) UNION ALL SELECT 'renamed', key_b FROM renamed UNION ALL SELECT 'removed', descriptor FROM o1 WHERE descriptor NOT IN (SELECT key_a FROM renamed) UNION ALL SELECT 'added', descriptor FROM o2 WHERE descriptor NOT IN (SELECT key_b FROM renamed)",
}
