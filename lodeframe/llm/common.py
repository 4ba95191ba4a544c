"""Shared plumbing of the document operators: Arrow text access, vectorised word hashing, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.tables import materialize, shared_dir  # noqa: F401

#: Text handled at once inside a Python worker; numpy needs about 60 bytes of memory for each byte of it.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- tables


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def named(column: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col(f"`{column.replace('`', '``')}`")


def packed(df: DataFrame, keep: list[str] | None = None) -> Column:
    """The columns of a row (all, or those of `keep`) as one struct `_doc`, so that no name of theirs meets one of an operator's."""
    return F.struct(*[named(c) for c in (df.columns if keep is None else keep)]).alias("_doc")


def unpacked(keep: list[str], new: tuple[str, ...] = ()) -> list[Column]:
    """The columns of `_doc` again. Those that have the name of a new column are left out."""
    taken = {n.lower() for n in new}
    return [F.col("_doc")[c].alias(c) for c in keep if c.lower() not in taken]


def aliased(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with plain numbered column names, and the new name of each column: no name of df's meets one of an operator's."""
    names = [f"_c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


#: A key is heavy if more than this share of all rows has it: at most HEAVY keys are.
HEAVY = 8192
ROWS_PER_BUCKET = 2048


def join_heavy(left: DataFrame, right: DataFrame, key: str | list[str], rows: int, count: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key and the number of left's rows with it in `count`; `rows` is
    the number of left's rows. Rows of heavy keys meet a broadcast table of at most HEAVY rows where they stand; all others are joined by
    key."""
    key = [key] if isinstance(key, str) else key
    heavy = F.broadcast(right.where(F.col(count) * HEAVY > rows))
    light = right.where(F.col(count) * HEAVY <= rows)
    return left.join(heavy, key).unionByName(left.join(heavy.select(*key), key, "left_anti").join(light, key, how))


def range_shift(rows: int, bits: int = 63) -> int:
    """By how many bits to shift an evenly spread key of `bits` bits so that a bucket holds about ROWS_PER_BUCKET of the rows."""
    return bits - min(bits - 1, max(0, (max(rows, 1) // ROWS_PER_BUCKET).bit_length()))


def running_sum(df: DataFrame, part: list[str], order: str, weight: str, out: str, shift: int) -> DataFrame:
    """df with the sum of `weight` over the rows before each row, inside its `part`, in order of the long column `order`.

    No part is sorted in one task: weights are added up by (part, order, `_part`), where `_part` is a number that df's rows got where they
    were read and that bounds how many equal rows share it; those sums are run through inside buckets (order >> shift), and bucket sums
    inside a part. Rows of equal order are interchangeable: they get the same set of sums whatever their `_part` is. df is a stored table.
    """
    key = [*part, order, "_part"]
    units = df.groupBy(*key).agg(F.sum(weight).alias("_w")).withColumn("_bucket", F.shiftright(order, shift))
    totals = units.groupBy(*part, "_bucket").agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*part, "_bucket").orderBy(order, "_part").rowsBetween(Window.unboundedPreceding, -1)
    units = units.join(totals, [*part, "_bucket"])
    units = units.select(*key, (F.col("_before") + F.coalesce(F.sum("_w").over(inside), F.lit(0))).alias("_before"))
    equals = Window.partitionBy(*key).orderBy(weight).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(units, key).withColumn(out, F.col("_before") + F.coalesce(F.sum(weight).over(equals), F.lit(0)))
    return joined.drop("_before")


def add_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """df with columns that fn computes from each Arrow batch. Columns of df that have the name of a new one, in any case, are replaced."""
    new = {f.name.lower() for f in fields}
    names = df.columns
    # Spark hands columns to Arrow by unquoted names, so dots and backticks in them are kept from it.
    plain = aliased(df)[0] if any(set(n) & {".", "`"} for n in names) else df
    kept = [k for k, n in enumerate(names) if n.lower() not in new]
    schema = T.StructType([plain.schema[k] for k in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(pa.RecordBatch.from_arrays(batch.columns, names=names))
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [made[f.name] for f in fields], names=schema.names)
                del batch, made
                release()

    out = plain.mapInArrow(run, schema)
    return out if plain is df else out.toDF(*[names[k] for k in kept], *[f.name for f in fields])


# ---------------------------------------------------------------- memory of Python workers


def release() -> None:
    """Give freed memory back to the system: idle workers stay beside the ones that later stages start."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable, n: int = 1) -> Callable:
    """run, a function of n arguments that gives a table, with a release() after it. Spark looks at the number of arguments."""

    def wrapped(*args):
        out = run(*args)
        del args
        release()
        return out

    return {1: lambda a: wrapped(a), 2: lambda a, b: wrapped(a, b), 3: lambda a, b, c: wrapped(a, b, c)}[n]


# ---------------------------------------------------------------- bytes of a text column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, end to end, and len + 1 offsets. Null counts as empty."""
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_binary())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return flat, at - at[0]


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about `size` bytes each."""
    data, at = text_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


# ---------------------------------------------------------------- hashing


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES * 9 // 4)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """len + 1 running sums; substring_hash() takes the hash of any substring from two of them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def substring_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _long_hash(data: np.ndarray) -> np.uint64:
    """substring_hash() of the whole of data, piece by piece."""
    up, total = powers(CHUNK_BYTES)[0], 0
    for a in range(0, len(data), CHUNK_BYTES):
        piece = data[a : a + CHUNK_BYTES].astype(np.uint64) + np.uint64(1)
        total += pow(int(_BASE), a, 1 << 64) * int((piece * up[: len(piece)]).sum(dtype=np.uint64))
    return mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """substring_hash() of words in order of place. A text of any length needs 60 bytes of memory for each byte of one chunk, and a few
    for each of the others; a word longer than a chunk is added up in pieces."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + 2 * CHUNK_BYTES, "right"))
        if j == i:
            out[i] = _long_hash(data[starts[i] : ends[i]])
            i += 1
        else:
            base = starts[i]
            out[i:j] = substring_hash(prefix_hash(data[base : ends[j - 1]]), starts[i:j] - base, ends[i:j] - base)
            i = j
    return out


# ---------------------------------------------------------------- words


def _table(is_word: Callable[[int], bool]) -> np.ndarray:
    """For each byte 0 if it separates words, else the byte with A-Z lower-cased."""
    low = [c + 32 if 65 <= c <= 90 else c for c in range(256)]
    return np.array([c if is_word(c) else 0 for c in low], np.uint8)


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters and everything beyond ASCII.
WORD_BYTES = _table(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)


def split_words(data: np.ndarray, at: np.ndarray, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `wordy` bytes, which never cross rows, and the index of each row's first run (rows + 1)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = wordy
    now = np.zeros(len(data) + 1, bool)
    now[:-1] = wordy
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, at)


#: Not a word byte for [^\x20\x09-\x0D]+
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len - n + 1 of them)."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count]
    return mix(out)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the index of each row's first element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def spans(covered: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True inside rows: starts, ends and the index of each row's first run."""
    return split_words(covered, at, covered)
