"""Rule dictionaries against tables, and the rollup of what they find."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.operators import grams
from lodeframe.tables import materialize

#: Up to so many rules become parts of one expression; a larger dictionary goes through an automaton.
INLINE_RULES = 256
#: Bytes of patterns in one automaton; a dictionary of more is joined.
AUTOMATON_BYTES = 8 << 20


_SET = r"\[\^?[^\[\]\\&]+\]"
#: Patterns of characters and sets, without alternatives and groups, and what stands between the literals of such a pattern.
_FLAT = re.compile(rf"(?:[^|()\\{{}}\[\]]|{_SET})*")
_BREAK = re.compile(rf"(?:{_SET}|.)[*+?]+|{_SET}|[.^$]", re.DOTALL)


def literal_of(pattern: str, kind: str) -> list[str] | None:
    """Lower-cased literals, ASCII as the pattern has them, of which a text that the rule fits holds one; None if none is known."""
    if kind == "prefix":
        own = max(grams._ascii(pattern), key=len, default="").lower()
        return [own] if len(own) >= grams.SIZE else None
    alternatives = [_BREAK.split(pattern)] if _FLAT.fullmatch(pattern) else grams.literals_of(pattern)
    longest = [max((x for run in own for x in grams._ascii(run)), key=len, default="").lower() for own in alternatives or []]
    return longest if longest and all(len(x) >= grams.SIZE for x in longest) else None


@lru_cache(maxsize=4)
def _automaton(handle):
    """The automaton of all literals; each has the numbers of its rules. Built once in a worker."""
    import ahocorasick

    found: dict[str, list[int]] = {}
    for literal, rule in handle.value:
        found.setdefault(literal, []).append(rule)
    out = ahocorasick.Automaton()
    for literal, own in found.items():
        out.add_word(literal, own)
    out.make_automaton()
    return out


def _matcher(column: str, handle):
    """Adds _rules, the numbers of the rules that may fit, and leaves out rows without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _automaton(handle).iter
        for batch in batches:
            found = [sorted({r for _, own in look(text.lower()) for r in own}) if text else [] for text in batch.column(column).to_pylist()]
            some = pa.array([k for k, own in enumerate(found) if own], pa.int32())
            kept = batch.take(some)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([own for own in found if own], pa.list_(pa.int32()))], names=[*kept.schema.names, "_rules"])

    return run


def _inline(df: DataFrame, fits, few: list[Row], schema: T.StructType) -> DataFrame:
    rule = lambda r: F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in schema])
    found = F.filter(F.array(*[F.when(fits(F.lit(r["pattern"])), rule(r)) for r in few]), lambda r: r.isNotNull())
    return df.select(*df.columns, F.inline(found))


def _none(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.where(F.lit(False)).select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def _pass(df: DataFrame, col: str, known: list[Row], schema: T.StructType, kind: str) -> list[DataFrame]:
    """What the rules of one block find: those with a literal by an automaton, the others as parts of an expression."""
    spark = df.sparkSession
    fits = lambda pattern: F.rlike(F.col(col), pattern) if kind == "regex" else F.col(col).startswith(pattern)
    literals = [(r, literal_of(r["pattern"], kind)) for r in known if r["pattern"] is not None]
    others = [r for r, own in literals if not own]
    out = [_inline(df, fits, others[k : k + INLINE_RULES], schema) for k in range(0, len(others), INLINE_RULES)]
    told = [(r, own) for r, own in literals if own]
    if told:
        handle = spark.sparkContext.broadcast([(x, n) for n, (_, own) in enumerate(told) for x in own])
        met = df.mapInArrow(_matcher(col, handle), T.StructType([*df.schema.fields, T.StructField("_rules", T.ArrayType(T.IntegerType()))]))
        rules = spark.createDataFrame([(n, *r) for n, (r, _) in enumerate(told)], T.StructType([T.StructField("_rule", T.IntegerType()), *schema.fields]))
        met = met.withColumn("_rule", F.explode("_rules")).drop("_rules").join(F.broadcast(rules), "_rule").drop("_rule")
        out.append(met.where(fits(F.col("pattern"))).select(*df.columns, *schema.names))
    return out


#: Lengths of the grams that literals are looked up by: each by the longest that fits into it.
KEY_SIZES = (3, 4, 8, 16, 32)
#: Buckets of the counts that tell rare grams, and the most bits of the filter of all keys.
SKETCH, MOST_BITS = 1 << 20, 1 << 30
CHUNK = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """64-bit hashes of all runs of each length of KEY_SIZES in lower-cased bytes, by where they start."""
    with np.errstate(over="ignore"):
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
        base, size, own = np.uint64(_BASE), 1, low
        out = {}
        while size < KEY_SIZES[-1]:
            if size == 2:
                out[3] = own[:-1] * base + low[2:] if len(low) > 2 else own[:0]
            power = np.uint64(pow(_BASE, size, 1 << 64))
            own = own[:-size] * power + own[size:] if len(own) > size else own[:0]
            size *= 2
            out[size] = own
        # Mixed, so that any bits of a key can serve as an address.
        return {n: _mixed(out[n] + np.uint64(n)) for n in KEY_SIZES}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams_of_literals(literals: list[str]) -> list[np.ndarray]:
    """The grams that may stand for each literal. Literals are hashed end to end."""
    ends = np.cumsum([len(x) for x in literals])
    hashes = gram_hashes(np.frombuffer("".join(literals).encode(), np.uint8))
    sizes = [max(n for n in KEY_SIZES if n <= len(x)) for x in literals]
    return [hashes[n][end - len(x) : end - n + 1] for x, n, end in zip(literals, sizes, ends.tolist(), strict=True)]


def _literals(kind: str):
    """Adds _literals, null if none is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [literal_of(p, kind) or None for p in batch.column("pattern").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "_literals"])

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many grams of literals fall into each bucket."""
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        own = [x for literals in batch.column("_literals").to_pylist() for x in literals]
        if own:
            counts += np.bincount((np.concatenate(_grams_of_literals(own)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])


def _keyed(handle):
    """Adds _own, for each literal the key of its gram that seems to be the rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = handle.value
        for batch in batches:
            lists = batch.column("_literals").to_pylist()
            keys = iter([own[counts[(own % np.uint64(SKETCH)).astype(np.int64)].argmin()] for own in _grams_of_literals([x for literals in lists for x in literals])] if any(lists) else [])
            found = [sorted({int(next(keys).astype(np.int64)) for _ in literals}) for literals in lists]
            kept = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != "_literals"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int64()))], names=[*[n for n in batch.schema.names if n != "_literals"], "_own"])

    return run


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of so many bits."""
    low = np.uint64(bits - 1)
    return (keys & low).astype(np.int64), ((keys >> np.uint64(32)) & low).astype(np.int64)


def _chunks(bits: int):
    """(chunk, place) of each key, twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_places(batch.column("_key").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((both // CHUNK).astype(np.int32)), pa.array((both % CHUNK).astype(np.int32))], names=["chunk", "place"])

    return run


def _chunk_bits(table: pa.Table) -> pa.Table:
    held = np.zeros(CHUNK, np.uint8)
    held[table.column("place").to_numpy()] = 1
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the keys (_key), made in tasks, a byte for each eight places; at most MOST_BITS / 8 bytes."""
    bits = min(MOST_BITS, max(CHUNK, 1 << (16 * n).bit_length()))
    chunks = keys.mapInArrow(_chunks(bits), "chunk int, place int").groupBy("chunk").applyInArrow(_chunk_bits, "chunk int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in chunks.toLocalIterator():
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _keys_met(column: str, handle):
    """Adds _keys, the keys of the filter that a text holds, and leaves out rows without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = handle.value
        for batch in batches:
            texts = batch.column(column).cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            first = ends[0]
            hashes = gram_hashes(np.frombuffer(data, np.uint8)[first : ends[-1]] if data else np.zeros(0, np.uint8))
            at, own = [], []
            for size, h in hashes.items():
                a, b = _places(h, len(held) * 8)
                some = np.flatnonzero((held[a >> 3] >> (a & 7).astype(np.uint8)) & (held[b >> 3] >> (b & 7).astype(np.uint8)) & 1)
                row = np.searchsorted(ends, some + first, "right") - 1
                inside = some + first + size <= ends[row + 1]
                at.append(row[inside])
                own.append(h[some[inside]].view(np.int64))
            pairs = np.unique(np.stack([np.concatenate(at), np.concatenate(own)]), axis=1) if sum(map(len, at)) else np.zeros((2, 0), np.int64)
            some, starts = np.unique(pairs[0], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, pairs.shape[1]), pa.int32()), pa.array(pairs[1], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some, pa.int64())).columns, lists], names=[*batch.schema.names, "_keys"])

    return run


def scan_joined(df: DataFrame, col: str, rules: DataFrame, kind: str) -> DataFrame:
    """As scan_rules, for a dictionary as large as a table: one pass over df, whatever the number of rules.

    Each literal of a rule has a key, the hash of its rarest gram. A text's grams that a filter of all keys lets through meet the rules by
    their key, and these are tried. The driver and a worker hold the counts of grams and the filter, both of bounded size; a filter that is
    too small for its keys lets more through. Rules without a literal are tried on each text.
    """
    spark = df.sparkSession
    fits = lambda pattern: F.rlike(F.col(col), pattern) if kind == "regex" else F.col(col).startswith(pattern)
    of = lambda schema, **more: T.StructType([*schema.fields, *[T.StructField(n, T.ArrayType(t)) for n, t in more.items()]])
    # A dictionary in few files is dealt out: taking patterns apart is most of the work.
    dealt = rules.where("pattern IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists = materialize(dealt.mapInArrow(_literals(kind), of(rules.schema, _literals=T.StringType())), "rule-literals")
    told = lists.where("_literals IS NOT NULL")
    counts = np.zeros(SKETCH, np.int64)
    for batch in told.mapInArrow(_sketch, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    keyed = materialize(told.mapInArrow(_keyed(spark.sparkContext.broadcast(counts)), of(rules.schema, _own=T.LongType())), "rule-keys")
    each = keyed.withColumn("_key", F.explode("_own"))
    held = spark.sparkContext.broadcast(key_filter(each.select("_key"), each.count()))
    met = df.mapInArrow(_keys_met(col, held), of(df.schema, _keys=T.LongType())).withColumn("_key", F.explode("_keys"))
    once = F.array_min(F.array_intersect("_own", "_keys")) == F.col("_key")
    found = met.join(each, "_key").where(once & fits(F.col("pattern"))).select(*df.columns, *rules.columns)
    others = lists.where("_literals IS NULL").drop("_literals")
    few = others.limit(INLINE_RULES + 1).collect()
    if not few:
        return found
    return found.unionByName(_inline(df, fits, few, rules.schema) if len(few) <= INLINE_RULES else df.crossJoin(others).where(fits(F.col("pattern"))))


def scan_many(df: DataFrame, col: str, rules: DataFrame, kind: str, bytes_: int) -> DataFrame:
    """As scan_rules, for any number of rules (of so many bytes): a text runs through one automaton of the longest literal of each rule, and
    the rules whose literal it holds are then tried. A dictionary of more than AUTOMATON_BYTES meets the texts by a join (scan_joined), so
    what the driver and a worker hold has a bound and the texts are read once. Rules without a literal take INLINE_RULES in a pass."""
    if bytes_ > AUTOMATON_BYTES:
        return scan_joined(df, col, rules, kind)
    out = _pass(df, col, rules.collect(), rules.schema, kind)
    return reduce(DataFrame.unionByName, out) if out else _none(df, rules.schema)


def scan_rules(df: DataFrame, col: str, rules: DataFrame, kind: str = "regex") -> DataFrame:
    """Rows of df with each rule (columns pattern and vendor, among others) that fits; kind regex or prefix.

    A dictionary of a few rules is written into the plan, so each pattern is compiled once and a row is looked at once; a larger one goes
    through an automaton (scan_many).
    """
    fits = lambda pattern: F.rlike(F.col(col), pattern) if kind == "regex" else F.col(col).startswith(pattern)
    known = rules.limit(INLINE_RULES + 1).collect()
    if len(known) > INLINE_RULES:
        return scan_many(df, col, rules, kind, rules.agg(F.sum(F.coalesce(F.octet_length("pattern"), F.lit(0)) + 32)).first()[0])
    return _inline(df, fits, known, rules.schema) if known else _none(df, rules.schema)


def evidence_rollup(evidence: DataFrame, key: list[str], strong: Column, vendor: str = "vendor") -> DataFrame:
    """For each key: any strong evidence, vendors sorted, number of findings and confidence (high, medium or none)."""
    rolled = evidence.groupBy(*key).agg(F.coalesce(F.bool_or(strong), F.lit(False)).alias("strong"), F.array_join(F.sort_array(F.collect_set(vendor)), ",").alias("vendors"), F.count(vendor).alias("findings"))
    return rolled.withColumn("confidence", F.when(F.col("strong"), "high").when(F.col("findings") > 0, "medium").otherwise("none"))
