"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows, scanned by every document.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A benchmark item gives every window of ten
consecutive words; an item of fewer words is one shorter window. Documents compare 64-bit window hashes against a bitmap, then a
sorted array, then the words themselves, so that a hit is never a hash collision.

The broadcast is bounded by `block_words`: items are cut into pieces of PIECE window starts, a larger benchmark is dealt into blocks of
about that many words, and the documents pass over one block after the other, each pass adding to what the earlier ones found (and
writing the table once more). No item, however long, and no window is left out.

Defined cases: a null or empty text has no words and is clean; an item without words is never found; a null item_id still marks
words but is not counted as an item; items with the same id count once; windows that several items share count for each; repeated
document rows are judged alike; an empty benchmark leaves every document clean, and an empty table gives an empty result; a very long
text is hashed piece by piece. Columns of documents that share a name with a result column are replaced by find_contamination and
kept by decontaminate.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import WORD_BYTES, add_columns, aliased, load, materialize, named, rows_of, spans, split_words, text_chunks, windows, word_hashes

WINDOW = 10
BLOCK_WORDS = 500_000
PIECE = 20_000
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BITS = 22

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_from", T.ArrayType(T.LongType())),
    T.StructField("hit_to", T.ArrayType(T.LongType())),
]


def _words(data: np.ndarray, at: np.ndarray):
    low = WORD_BYTES[data]
    starts, ends, first = split_words(data, at, low > 0)
    return low, starts, ends, first, word_hashes(low, starts, ends)


class WindowIndex:
    """Windows of one block of items: for each window length a sorted hash array, and for each window its words and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        found: dict[bytes, set[str]] = {}
        for key, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            low, starts, ends, _, _ = _words(raw, np.array([0, len(raw)]))
            words = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(b" ".join(words[i : i + window]), set()).update([] if key is None else [key])
        self.items = {w: tuple(sorted(x)) for w, x in found.items()}
        self.lengths: dict[int, np.ndarray] = {}
        for n in sorted({w.count(b" ") + 1 for w in found}):
            hashes = []
            for w in found:
                if w.count(b" ") + 1 == n:
                    raw = np.frombuffer(w, np.uint8)
                    hashes.append(windows(_words(raw, np.array([0, len(raw)]))[4], n)[0])
            self.lengths[n] = np.unique(np.array(hashes, np.uint64))

    def bitmap(self, n: int) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[(self.lengths[n] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return bits


@lru_cache(maxsize=2)
def _opened(handle) -> tuple[WindowIndex, dict[int, np.ndarray]]:
    index = handle.value
    return index, {n: index.bitmap(n) for n in index.lengths}


def _scan(batch: pa.RecordBatch, text_col: str, handle, earlier: bool) -> dict[str, pa.Array]:
    index, bitmaps = _opened(handle)
    n_words, n_hit, items, hit_from, hit_to = [], [], [], [], []
    row = 0
    for _, _, data, at in text_chunks(batch.column(text_col)):
        low, starts, ends, first, hashes = _words(data, at)
        hit = np.zeros(len(starts), bool)
        found: list[set[str]] = [set() for _ in range(len(at) - 1)]
        doc = rows_of(first)
        for n, known in index.lengths.items():
            grams = windows(hashes, n)
            maybe = np.flatnonzero(bitmaps[n][(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
            maybe = maybe[doc[maybe] == doc[maybe + n - 1]]
            slot = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
            for i in maybe[known[slot] == grams[maybe]]:
                key = b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n], strict=True))
                if key in index.items:
                    hit[i : i + n] = True
                    found[doc[i]].update(index.items[key])
        if earlier:
            for k in range(len(at) - 1):
                found[k].update(batch.column("items")[row + k].as_py())
                for a, b in zip(batch.column("hit_from")[row + k].as_py(), batch.column("hit_to")[row + k].as_py(), strict=True):
                    hit[first[k] + a : first[k] + b] = True
        a, b, runs = spans(hit, first)
        counts = np.add.reduceat(np.append(hit, False).astype(np.int64), first[:-1]) if len(at) > 1 else np.zeros(0, np.int64)
        counts = np.where(np.diff(first) > 0, counts, 0)
        n_words += np.diff(first).tolist()
        n_hit += counts.tolist()
        items += [sorted(x) for x in found]
        for k in range(len(at) - 1):
            hit_from.append((a[runs[k] : runs[k + 1]] - first[k]).tolist())
            hit_to.append((b[runs[k] : runs[k + 1]] - first[k]).tolist())
        row += len(at) - 1
    return {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "hit_from": pa.array(hit_from, pa.list_(pa.int64())), "hit_to": pa.array(hit_to, pa.list_(pa.int64()))}


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids as strings, sorted) and the hit word runs [hit_from, hit_to)."""
    spark = docs.sparkSession
    low = F.translate(named(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = benchmark.select(named(item_col).cast("string").alias("k"), F.regexp_extract_all(low, F.lit(ITEM_WORD), 0).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE)))
    # A piece has the words of PIECE windows: one window less than a whole one more than their starts.
    bench = told.select("k", "w", starts.alias("i")).select("k", F.array_join(F.slice("w", F.col("i") + 1, PIECE + window - 1), " ").alias("t"))
    # Half the bytes bound the words of any text, so the size is checked before anything is collected.
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t") / 2 + 1), F.lit(0.0))).first()[0]
    blocks = max(1, math.ceil(total / block_words / 3))
    out = docs
    for k in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == k)
        handle = spark.sparkContext.broadcast(WindowIndex([(r.k, r.t) for r in own.collect()], window))
        if k:
            out = materialize(out, "decontaminate")
        out = add_columns(out, FIELDS, lambda batch, handle=handle, k=k: _scan(batch, text_col, handle, k > 0))
    return out


def _cut(batch: pa.RecordBatch, text_col: str) -> dict[str, pa.Array]:
    texts = []
    row = 0
    for _, _, data, at in text_chunks(batch.column(text_col)):
        _, starts, ends, first, _ = _words(data, at)
        for k in range(len(at) - 1):
            text = batch.column(text_col)[row]
            cuts = list(zip(batch.column("hit_from")[row].as_py(), batch.column("hit_to")[row].as_py(), strict=True))
            if cuts:
                parts, done = [], at[k]
                for a, b in cuts:
                    parts.append(data[done : starts[first[k] + a]].tobytes())
                    done = ends[first[k] + b - 1]
                texts.append(b"".join([*parts, data[done : at[k + 1]].tobytes()]).decode())
            else:
                texts.append(text.as_py())
            row += 1
    return {text_col: pa.array(texts, pa.string())}


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "document", text_col: str = "text", **options) -> DataFrame:
    """docs without their contamination. remove: "document" drops every document with a hit word, "span" cuts the hit words (and what
    stands between words of one run) out of the texts."""
    if remove not in ("document", "span"):
        raise ValueError(f"remove must be document or span, not {remove!r}")
    plain, known = aliased(docs)
    text = known[text_col]
    found = find_contamination(plain, benchmark, text, **options)
    if remove == "document":
        return found.where("n_hit = 0").select(*plain.columns).toDF(*docs.columns)
    cut = add_columns(found, [T.StructField(text, T.StringType())], lambda batch: _cut(batch, text))
    return cut.select(*plain.columns).toDF(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same over the whole tables, for DuckDB.
OP2_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT DISTINCT k, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, k FROM dw JOIN items ON dw.g = items.g AND dw.n = items.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(DISTINCT k) AS n_items, string_agg(DISTINCT k, ',' ORDER BY k) AS ids FROM hits WHERE k IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
