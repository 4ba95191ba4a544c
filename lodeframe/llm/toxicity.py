"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs around one word (skip-grams), hashed into 2**BITS coordinates; words
are digits, letters and bytes beyond ASCII with A-Z lower-cased. Each coordinate has its own learning rate, and L1 keeps most weights at
exactly zero, so the model that is broadcast holds the others only, at most 2**BITS of them whatever the input is.

Fitting takes at most `per_class` labelled documents of either label (those with the smallest hash of their doc_id) and passes over them
EPOCHS times, whatever their number; scoring covers every row and whole texts. Rows whose crc32(doc_id as text) mod `folds` is 0 are held
out and never learnt from. The settings were chosen by cross-validation among rows that are not held out.

Defined cases: a null or empty text has no features and gets the score of the bias alone; null labels, and labels of unknown
documents, are passed over; a document with both labels is learnt under both; a labelled doc_id of several rows is one example, the
text of the least hash; without a toxic row to learn from every score is near 0; a null doc_id is not held out and has no label;
repeated rows are scored alike; examples of equal hash are learnt in order of label and features; an empty table gives an empty result;
a very long text is hashed piece by piece; columns of docs named like a result (held_out, score, predicted), in any case, are replaced by
score_toxicity and kept by drop_toxic.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import WORD_BYTES, add_columns, aliased, load, mix, named, rows_of, split_words, text_chunks, word_hashes

BITS = 20
PER_CLASS = 6000
FOLDS = 5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.0
#: Bias of a model that has seen no toxic row.
NO_BIAS = -20.0
_SALTS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))


def features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of each feature, repeats included."""
    low = WORD_BYTES[data]
    starts, ends, first = split_words(data, at, low > 0)
    words, row = word_hashes(low, starts, ends), rows_of(first)
    shift = np.uint64(64 - bits)
    ids, rows = [mix(words ^ _SALTS[0]) >> shift], [row]
    for gap in (1, 2):
        same = row[:-gap] == row[gap:] if len(row) > gap else np.zeros(0, bool)
        pairs = words[:-gap][same] * np.uint64(0x9FB21C651E98DF25) + words[gap:][same]
        ids.append(mix(pairs ^ _SALTS[gap]) >> shift)
        rows.append(row[:-gap][same] if len(row) > gap else row[:0])
    return np.concatenate(rows), np.concatenate(ids).astype(np.uint32)


def _blobs(batch: pa.RecordBatch, text_col: str, bits: int) -> dict[str, pa.Array]:
    out = []
    for _, _, data, at in text_chunks(batch.column(text_col)):
        rows, ids = features(data, at, bits)
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(len(at)))
        out += [np.unique(ids[order[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return {"features": pa.array(out, pa.binary())}


def ftrl(examples: list[tuple[np.ndarray, int]], size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """size + 1 weights; the last is the bias, which has no penalty."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    free = np.ones(size + 1)
    free[size] = 0.0

    def weights(ids: np.ndarray) -> np.ndarray:
        zi, pay = z[ids], free[ids]
        return np.where(np.abs(zi) <= l1 * pay, 0.0, -(zi - np.sign(zi) * l1 * pay) / ((beta + np.sqrt(n[ids])) / alpha + l2 * pay))

    for _ in range(epochs):
        for found, label in examples:
            ids = np.append(found, np.uint32(size)).astype(np.int64)
            w = weights(ids)
            g = 1.0 / (1.0 + np.exp(-min(max(w.sum(), -35.0), 35.0))) - label
            old = np.sqrt(n[ids])
            n[ids] += g * g
            z[ids] += g - (np.sqrt(n[ids]) - old) / alpha * w
    return weights(np.arange(size + 1))


def _fit(table: pa.Table, size: int) -> pa.Table:
    rows = sorted(zip(table.column("order").to_pylist(), table.column("label").to_pylist(), table.column("features").to_pylist(), strict=True))
    examples = [(np.frombuffer(x, np.uint32), label) for _, label, x in rows]
    if any(label for _, label in examples):
        w = ftrl(examples, size)
    else:
        w = np.zeros(size + 1)
        w[size] = NO_BIAS
    some = np.flatnonzero(w).astype(np.uint32)
    return pa.table({"ids": pa.array([some.tobytes()], pa.binary()), "weights": pa.array([w[some].astype(np.float32).tobytes()], pa.binary())})


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, folds: int = FOLDS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero; coordinate 2**bits is the bias."""
    seen = labels.select(named(id_col).alias("_id"), named(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"), folds)).distinct()
    known = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    order = F.xxhash64(F.lit(3), "_id")
    sample = seen.where("label = 1").orderBy(order, "_id").limit(per_class).unionByName(seen.where("label = 0").orderBy(order, "_id").limit(per_class))
    # At most 2 * per_class rows: small enough to broadcast.
    found = known.join(F.broadcast(sample), "_id").groupBy("_id", "label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    chosen = found.withColumn("order", F.xxhash64(F.lit(5), "_id")).select("_text", "label", "order")
    # Examples are learnt in another order than they were chosen in, else those of the rarer label would come last.
    made = add_columns(chosen, [T.StructField("features", T.BinaryType())], lambda b: _blobs(b, "_text", bits)).select("order", "label", "features")
    fitted = made.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: _fit(t, 1 << bits), "ids binary, weights binary").first()
    if fitted is None:
        return np.array([1 << bits], np.uint32), np.array([NO_BIAS], np.float32)
    return np.frombuffer(fitted.ids, np.uint32), np.frombuffer(fitted.weights, np.float32)


@lru_cache(maxsize=2)
def _dense(handle, bits: int) -> np.ndarray:
    w = np.zeros((1 << bits) + 1, np.float32)
    ids, weights = handle.value
    w[ids] = weights
    return w


def _score(batch: pa.RecordBatch, text_col: str, handle, bits: int) -> dict[str, pa.Array]:
    w = _dense(handle, bits)
    out = []
    for _, _, data, at in text_chunks(batch.column(text_col)):
        rows, ids = features(data, at, bits)
        some = w[ids] != 0
        pairs = np.unique((rows[some].astype(np.uint64) << np.uint64(32)) | ids[some])
        sums = np.bincount((pairs >> np.uint64(32)).astype(np.int64), w[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)], len(at) - 1)
        out.append(1.0 / (1.0 + np.exp(-np.clip(sums + w[-1], -35, 35))))
    return {"score": pa.array(np.concatenate(out) if out else [], pa.float64())}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, **options) -> DataFrame:
    """docs with held_out, score and predicted."""
    model = fit_model(docs, labels, id_col, text_col, bits=bits, **options)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    scored = add_columns(docs.drop("held_out", "predicted"), [T.StructField("score", T.DoubleType())], lambda b: _score(b, text_col, handle, bits))
    return scored.withColumn("held_out", held_out(named(id_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with all of their columns, without the rows that the classifier takes for toxic."""
    plain, known = aliased(docs)
    ids = labels.withColumnRenamed(id_col, known[id_col])
    scored = score_toxicity(plain, ids, known[id_col], known[text_col], **options)
    return scored.where("predicted = 0").select(*plain.columns).toDF(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
