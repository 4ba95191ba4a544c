"""Predicates over named columns. Each takes a DataFrame and returns one of the same columns, so that Catalyst can push them down."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.errors import bad_argument

#: A scope and the sources that it lets through; None means all.
SCOPES = {"all": None, "app": ("app",), "library": ("library", "system"), "lib": ("library", "system"), "system": ("system",)}


def scope_filter(df: DataFrame, scope: str = "all", col: str = "source", scopes: dict = SCOPES) -> DataFrame:
    if scope not in scopes:
        raise bad_argument(f"unknown scope {scope!r}", f"one of {', '.join(scopes)}")
    return df if scopes[scope] is None else df.where(F.col(col).isin(*scopes[scope]))


def like_escape(text: str) -> str:
    """text with the wildcards of LIKE escaped by a backslash."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def prefix(col: Column, text: str) -> Column:
    """The column starts with text, whatever the case."""
    return F.ilike(col, F.lit(like_escape(text) + "%"), F.lit("\\"))


def checked_regex(pattern: str) -> str:
    """The pattern, if the engine that will run it (java.util.regex) takes it."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise bad_argument(f"bad pattern {pattern!r}: {str(e).splitlines()[0]}", "use classes, groups, alternation, anchors and quantifiers") from e
    return pattern


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def name_filter(df: DataFrame, query: str, kind: str, cols: list[str], package_col: str | None = None, package: str = "", also: Column | None = None) -> DataFrame:
    """kind exact: any column equals query, or `also` holds. prefix: any starts with it (with `package`, only package_col is tested, by that prefix).
    regex: any has a match."""
    if kind == "exact":
        return df.where(any_of([F.col(c) == query for c in cols] + ([] if also is None else [also])))
    if kind == "prefix":
        if package and package_col:
            return df.where(package_prefix(F.col(package_col), package))
        return df.where(any_of([prefix(F.col(c), query) for c in cols]))
    if kind == "regex":
        return df.where(any_of([F.col(c).rlike(checked_regex(query)) for c in cols]))
    raise bad_argument(f"unknown kind {kind!r}", "exact, prefix or regex")


def package_prefix(col: Column, text: str) -> Column:
    """A prefix in either spelling of a package, a/b or a.b."""
    return prefix(F.translate(col, "/", "."), text.replace("/", "."))


def text_filter(df: DataFrame, col: str, text: str = "", match: str = "contains", min_len: int = 0, lower_col: str | None = None) -> DataFrame:
    """contains ignores case; exact and prefix don't; regex is a search. An empty text needs a minimal length."""
    value = F.col(col)
    if match == "contains":
        if len(text) < 2 and not min_len:
            raise bad_argument("contains needs two characters or more", "give a longer text, or minLen")
        found = (F.col(lower_col) if lower_col else F.lower(value)).contains(text.lower()) if text else F.lit(True)
    elif match == "exact":
        found = value == text
    elif match == "prefix":
        found = value.startswith(text)
    elif match == "regex":
        found = value.rlike(checked_regex(text))
    else:
        raise bad_argument(f"unknown match {match!r}", "contains, exact, prefix or regex")
    return df.where(found & (F.length(value) >= min_len)) if min_len else df.where(found)


def flags_set(col: Column, mask: int) -> Column:
    return col.bitwiseAND(mask) == mask


def flags_clear(col: Column, mask: int) -> Column:
    return col.bitwiseAND(mask) == 0


def three_valued(df: DataFrame, col: str, want: bool | None) -> DataFrame:
    """True and False keep the rows that say so; a null is neither. None keeps all."""
    return df if want is None else df.where(F.col(col) == F.lit(want))


def has_element(col: Column, value: str) -> Column:
    return F.coalesce(F.array_contains(col, value), F.lit(False))


def any_keyword(col: Column, words: tuple[str, ...]) -> Column:
    """Any of the words stands in the upper-cased value."""
    return any_of([F.upper(col).contains(w) for w in words])
