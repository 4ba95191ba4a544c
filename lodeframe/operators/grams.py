"""An index of character n-grams for substring and pattern search over a pool of texts.

A posting (gram, id) says that a text has three characters in a row. Postings are dealt into PARTS partitions by the gram and sorted by
gram inside, so a search reads the partitions of its grams, and in them the row groups that can hold these. Texts that have all grams of
a literal are candidates; the caller compares them with the texts themselves.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3
PARTS = 16
#: Grams of one literal that are looked up: enough to be selective; all others are compared with the text anyway.
MOST_GRAMS = 8
#: Pattern syntax that means the same to java.util.regex and to the parser that finds literals. Anything else is not taken apart.
_PLAIN = re.compile(r"(?:[^\\(]|\\[^0-9A-Za-z]|\\[dDwWsSbBntrf]|\((?!\?)|\(\?:)*")

#: What a text has to hold: one of the alternatives, with every gram of it. None: nothing is known.
Wanted = list[frozenset[str]] | None


def part_of(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % PARTS).cast("int")


def postings(texts: DataFrame, key: list[str], id_col: str, text_col: str) -> DataFrame:
    """(key..., gram, id, part) for each gram of each text."""
    places = F.sequence(F.lit(1), F.length(text_col) - (SIZE - 1))
    found = F.array_distinct(F.transform(places, lambda k: F.substring(F.col(text_col), k, F.lit(SIZE))))
    out = texts.where(F.length(text_col) >= SIZE).select(*key, F.explode(found).alias("gram"), F.col(id_col).alias("id"))
    return out.withColumn("part", part_of(F.col("gram")))


def grams_of(literal: str) -> frozenset[str]:
    """At most MOST_GRAMS grams of a literal, evenly spread."""
    every = list(dict.fromkeys(literal[k : k + SIZE] for k in range(len(literal) - SIZE + 1)))
    step = max(1, -(-len(every) // MOST_GRAMS))
    return frozenset(every[::step])


def of_contains(text: str) -> Wanted:
    """For texts that contain this one, as it stands."""
    return [grams_of(text)] if len(text) >= SIZE else None


def _ascii(literal: str) -> list[str]:
    """Runs whose lower case doesn't depend on what stands beside them."""
    return re.findall("[\x00-\x7f]+", literal)


def of_lowered(text: str) -> Wanted:
    """For lower-cased texts whose original contains this one."""
    found = frozenset().union(*map(grams_of, _ascii(text.lower())), frozenset())
    return [found] if found else None


def _literals(tree) -> list[list[str]]:
    """Alternatives of literals that a match of the parsed pattern contains, each in order; a literal of no length ends a run."""
    alternatives: list[list[str]] = [[""]]

    def each(others: list[list[str]]) -> None:
        """Go on with one of the others, which are joined to nothing."""
        nonlocal alternatives
        if len(alternatives) * len(others) > 64:
            others = [[""]]
        alternatives = [[*a, *o, ""] for a in alternatives for o in others]

    for what, value in tree:
        name = str(what)
        if name == "LITERAL":
            alternatives = [[*a[:-1], a[-1] + chr(value)] for a in alternatives]
        elif name == "SUBPATTERN":
            each(_literals(value[3]))
        elif name == "BRANCH":
            each([x for branch in value[1] for x in _literals(branch)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            each(_literals(value[2]))
        else:
            each([[""]])
    return alternatives


def literals_of(pattern: str) -> list[list[str]] | None:
    """Alternatives of literals that every match of the pattern contains; None if the pattern isn't taken apart. Only plain syntax is."""
    if not _PLAIN.fullmatch(pattern):
        return None
    try:
        return _literals(re._parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None


def of_pattern(pattern: str) -> Wanted:
    """For lower-cased texts whose original has a match of the pattern."""
    found = [frozenset().union(*[grams_of(x) for run in own for x in _ascii(run.lower())], frozenset()) for own in literals_of(pattern) or []]
    return found if found and all(found) else None


def wanted(text: str, how: str) -> Wanted:
    """For filters.text_filter: contains (ignoring case), prefix and regex; exact texts have a key of their own."""
    return {"contains": lambda: of_contains(text.lower()), "prefix": lambda: of_lowered(text), "regex": lambda: of_pattern(text)}.get(how, lambda: None)()


def either(*each: Wanted) -> Wanted:
    """What one of several searches wants."""
    return None if any(w is None for w in each) else [a for w in each for a in w]


def candidates(index: DataFrame, want: list[frozenset[str]]) -> DataFrame:
    """(id) of the texts that have all grams of an alternative. index: gram, id and part."""
    every = sorted(frozenset().union(*want))
    parts = sorted({zlib.crc32(g.encode()) % PARTS for g in every})
    met = index.where(F.col("part").isin(*parts) & F.col("gram").isin(*every))
    if len(want) == 1:
        return met.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(every)).select("id")
    holds = [F.size(F.array_except(F.array(*map(F.lit, sorted(a))), "_grams")) == 0 for a in want]
    return met.groupBy("id").agg(F.collect_set("gram").alias("_grams")).where(reduce(lambda x, y: x | y, holds)).select("id")


#: Keys up to which a probe is a filter that the scan uses to skip row groups; more are joined.
PROBE_KEYS = 1000


def few_keys(keys: DataFrame, column: str, most: int = PROBE_KEYS) -> list | None:
    """The keys, or None if there are more than `most`."""
    few = [r[0] for r in keys.select(column).limit(most + 1).collect()]
    return few if len(few) <= most else None


def probe(df: DataFrame, keys: DataFrame, column: str, most: int = PROBE_KEYS) -> DataFrame:
    """Rows of df whose column is one of the keys (one column of that name). A few keys become a filter of the scan, so that a table that is
    clustered by the column, or has Bloom filters of it, is read where they are alone."""
    few = few_keys(keys, column, most)
    return df.join(keys.select(column), column, "left_semi") if few is None else df.where(F.col(column).isin(*few))
