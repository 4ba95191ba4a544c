"""LM scoring by cross-entropy difference of two matched n-gram models.

The target model is trained on the documents labelled as wanted, the background model on all documents. Both are interpolated word
bigram models of the same form: p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU) and p(w) = (c(w) + ADD) / (N + ADD * V). Words (digits,
letters and bytes beyond ASCII, A-Z lower-cased) and pairs are known by 64-bit hashes; every word and pair of every text has a count of
its own, so the model grows with the corpus. V is the number of distinct words of the corpus, 2**WORD_BITS at least. A document's score is
the mean over its tokens of target loss minus background loss, in nats: below 0 the target model fits it better.

The target is cross-fitted: wanted documents fall into two halves by the hash of their id, and each is scored by the target model of the
other half, so none is judged by its own counts; all other documents are scored by the target model of both halves.

No task holds the model. A token's loss is log(c(v) + MU) - log(c(v, w) + MU * p(w)): the second part needs counts of w and of pairs that
end in w, the first of v alone. So each block of texts sends its tokens, packed, to the shard of their word; the shard counts words and
pairs over all blocks, and answers each block with sums of losses for each document. Shards follow the number of tokens
(SHARD_TOKENS each). Words of more tokens than a quarter of a shard are counted before, their table is broadcast (at most four times as
many words as there are shards), and their tokens are dealt by pair instead.

Defined cases: null, empty and word-less texts have 0 tokens, losses 0 and score 0; null labels are passed over; without a wanted
document the target model is the even one; a document labelled twice counts once; a null doc_id is in the background alone; repeated
rows count each time and are scored alike; an empty table gives an empty result; a very long text is hashed piece by piece and its tokens
are spread over the shards like those of others; columns of docs named like a result are replaced, and any other name can be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import WORD_BYTES, load, materialize, mix, named, packed, release, releasing, rows_of, shuffle_parts, split_words, text_chunks, unpacked, word_hashes
from lodeframe.tables import discard

WORD_BITS = 18
MU, ADD = 4.0, 0.1
SHARD_TOKENS = 1 << 22
#: Distinct words that a task gathers before it sends their counts on.
_GATHERED = 1 << 21
_REQUEST = "shard int, block long, width int, head binary, words binary, pairs binary, tokens binary"
_ANSWER = "block long, head binary, rows binary, losses binary"
#: Counts: wanted documents of either half, all documents.
KINDS = ("half0", "half1", "background")
_COUNTS = pa.schema([("word", pa.int64()), *((c, pa.int64()) for c in KINDS)])
_REQUESTED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("width", pa.int32()), *((c, pa.binary()) for c in ("head", "words", "pairs", "tokens"))])
_ANSWERED = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("head", "rows", "losses"))])
_SCORED = pa.schema([("_row", pa.int64()), ("n_tokens", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64())])


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token its row, word and pair (0 if no token of the same row stands before it), and whether one stands after it."""
    low = WORD_BYTES[data]
    starts, ends, first = split_words(data, at, low > 0)
    words, row = word_hashes(low, starts, ends), rows_of(first)
    follows = np.zeros(len(words) + 1, bool)
    follows[1:-1] = row[1:] == row[:-1]
    before = np.concatenate([words[:1], words[:-1]])
    # 48 bits: a pair is told from others of the same word only.
    pairs = mix(before * np.uint64(0x9FB21C651E98DF25) + words) >> np.uint64(16)
    pairs = np.where(follows[:-1], np.maximum(pairs, np.uint64(1)), np.uint64(0))
    return row, words, pairs, follows[1:]


def _half(batch: pa.RecordBatch) -> np.ndarray:
    """0 or 1 for wanted documents, 2 for others."""
    return batch.column("half").fill_null(2).to_numpy().astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([p[k] for p in parts]), len(words)).astype(np.int64) for k in (1, 2, 3)]
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *map(pa.array, sums)], schema=_COUNTS)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        half = _half(batch)
        for a, b, data, at in text_chunks(batch.column("text")):
            row, words, _, _ = tokens(data, at)
            words, place = np.unique(words, return_inverse=True)
            own = half[a:b][row]
            parts.append((words, *(np.bincount(place, own == k, len(words)) for k in (0, 1)), np.bincount(place, minlength=len(words))))
            size += len(words)
            if size > _GATHERED:
                yield _summed(parts)
                parts, size = [], 0
    if parts:
        yield _summed(parts)
    parts.clear()
    release()


def _six(pairs: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(pairs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _of_table(table: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are in the broadcast table, and their places in it."""
    at = np.minimum(np.searchsorted(table[0], words), max(len(table[0]) - 1, 0))
    return (table[0][at] == words if len(table[0]) else np.zeros(len(words), bool)), at


#: What a token says, beside its row: it is the first of its word, the first of its pair, another one stands after it; its document is
#: wanted, and in which half.
ROW, WORD, PAIR, MORE, WANTED, HALF = 5, 16, 8, 4, 2, 1


def _requests(batches: Iterator[pa.RecordBatch], shards: int, handle) -> Iterator[pa.RecordBatch]:
    """A row for each (shard, block of texts): bytes of a token, words, pairs and, in order of both, each token. One more with the block's
    rows and their tokens."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        half, ids = _half(batch), batch.column("_row").to_numpy()
        for a, b, data, at in text_chunks(batch.column("text")):
            row, words, pairs, more = tokens(data, at)
            common, _ = _of_table(handle.value, words)
            shard = (np.where(common, mix(pairs ^ words), words) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((pairs, words, shard))
            shard, words, pairs = shard[order], words[order], pairs[order]
            new_word = np.ones(len(words), bool)
            new_word[1:] = (words[1:] != words[:-1]) | (shard[1:] != shard[:-1])
            new_pair = new_word.copy()
            new_pair[1:] |= pairs[1:] != pairs[:-1]
            word_at, pair_at = np.flatnonzero(new_word), np.flatnonzero(new_pair)
            own = half[a:b][row]
            own = ((row << ROW) + more * MORE + np.where(own < 2, WANTED + own, 0))[order] + new_word * WORD + new_pair * PAIR
            own = own.astype(np.uint16 if b - a <= 1 << (16 - ROW) else np.uint32)
            head = np.stack([ids[a:b], np.bincount(row, minlength=b - a)]).astype(np.int64)
            out = [(block % shards, block, own.itemsize, head.tobytes(), None, None, None)]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            word_cuts, pair_cuts = np.searchsorted(word_at, cuts), np.searchsorted(pair_at, cuts)
            word, pair = words[word_at], pairs[pair_at]
            for s in np.flatnonzero(np.diff(cuts)):
                own_words, own_pairs = word[word_cuts[s] : word_cuts[s + 1]], pair[pair_cuts[s] : pair_cuts[s + 1]]
                out.append((int(s), block, own.itemsize, None, own_words.tobytes(), _six(own_pairs), own[cuts[s] : cuts[s + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _REQUESTED, strict=True)], schema=_REQUESTED)
            block += 1
        del batch
        release()


def _answer(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWERED, strict=True)], schema=_ANSWERED)


def _serve(batches: Iterator[pa.RecordBatch], handle, spaces: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard: counts of its words and pairs over all blocks, and from them the losses of each block's documents. spaces: N + ADD * V of
    the models: target of the other half for either half, target of both, background."""
    parts = []
    for batch in batches:
        for k in range(batch.num_rows):
            block, width, head, words, pairs, own = (batch.column(f.name)[k].as_py() for f in _REQUESTED if f.name != "shard")
            if head is not None:
                yield _answer([(block, head, None, None)])
                continue
            parts.append((block, np.frombuffer(words, np.uint64), _of_six(pairs), np.frombuffer(own, np.uint16 if width == 2 else np.uint32)))
    if not parts:
        return
    flags = np.concatenate([(p[3] & 31).astype(np.uint8) for p in parts])
    pair_at = np.flatnonzero(flags & PAIR)
    words, word_of = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    word_of = word_of[np.cumsum((flags[pair_at] & WORD) > 0) - 1]
    pairs = np.concatenate([p[2] for p in parts])
    context = pairs > 0
    pairs, pair_of = np.unique(mix(pairs ^ mix(words[word_of])), return_inverse=True)
    said = flags & (WANTED | HALF)
    counts = [np.add.reduceat(said == WANTED + k, pair_at, dtype=np.int64) for k in (0, 1)]
    counts.append(np.diff(np.append(pair_at, len(flags))))
    known, at = _of_table(handle.value, words)
    single, both = [], []
    for k, own in enumerate(counts):
        count = np.bincount(word_of, own, len(words))
        count[known] = handle.value[1][k][at[known]]
        single.append(count)
        both.append(np.bincount(pair_of, own, len(pairs)))
    # The models: without half 0 (which it judges), without half 1, both halves, all documents.
    loss, after = [], []
    for k, models in enumerate(((1,), (0,), (0, 1), (2,))):
        of_word = sum(single[m] for m in models)
        alone = (of_word + ADD) / spaces[k]
        of_pair = sum(both[m] for m in models)
        # A token without one before it has no context: p(w) alone.
        loss.append(-np.log(np.where(context, of_pair[pair_of] + MU * alone[word_of], alone[word_of])))
        after.append(np.log(of_word + MU)[word_of])
    del words, pairs, pair_of, word_of, counts, single, both, pair_at, flags, said, context
    first, out = 0, []
    for block, _, own, mine in parts:
        pair = first + np.cumsum((mine & PAIR) > 0) - 1
        first += len(own)
        row, more = (mine >> ROW).astype(np.int64), (mine & MORE) > 0
        model = np.where(mine & WANTED, mine & HALF, 2)
        rows = np.flatnonzero(np.bincount(row))
        target = np.choose(model, [x[pair] for x in loss[:3]]) + more * np.choose(model, [x[pair] for x in after[:3]])
        sums = np.stack([np.bincount(row, target)[rows], np.bincount(row, loss[3][pair] + more * after[3][pair])[rows]])
        out.append((block, None, rows.astype(np.uint32).tobytes(), sums.astype(np.float32).tobytes()))
        if len(out) == 64:
            yield _answer(out)
            out = []
    if out:
        yield _answer(out)
    del parts, loss, after
    release()


def _assemble(table: pa.Table) -> pa.Table:
    """Rows of one block, from the answers of all shards."""
    head = next(x for x in table.column("head").to_pylist() if x is not None)
    ids, n = np.frombuffer(head, np.int64).reshape(2, -1)
    sums = np.zeros((2, len(n)))
    for rows, losses in zip(table.column("rows").to_pylist(), table.column("losses").to_pylist(), strict=True):
        if rows is not None:
            sums[:, np.frombuffer(rows, np.uint32)] += np.frombuffer(losses, np.float32).reshape(2, -1)
    return pa.Table.from_arrays([pa.array(ids), pa.array(n), *(pa.array(x / np.maximum(n, 1)) for x in sums)], schema=_SCORED)


NEW = ("n_tokens", "loss_target", "loss_background", "score", "selected")


def score_documents(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, loss_target, loss_background, score and selected (score below 0). wanted: ids in a column of id_col's name.
    keep: the columns of docs that are returned, all if not given."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    # Joined by sorting at every size, as labels grow with the corpus. Rows without an id are spread over all tasks. Rows get their
    # numbers once, as the table is written.
    ids = wanted.select(named(id_col).alias("_id"), F.lit(0).alias("_spread")).where("_id IS NOT NULL").distinct()
    ids = ids.withColumn("half", F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(2)).cast("int"))
    spread = F.when(named(id_col).isNull(), F.pmod(F.xxhash64(named(text_col)), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    rows = docs.select(packed(docs, keep), named(id_col).alias("_id"), spread.alias("_spread"), named(text_col).alias("text"))
    joined = rows.join(ids.hint("merge"), ["_id", "_spread"], "left").select("_doc", "text", "half")
    numbered = materialize(joined.withColumn("_row", F.monotonically_increasing_id()), "lm-rows", "zstd")
    texts = numbered.select("_row", "text", "half")

    counted = texts.select("text", "half").mapInArrow(_count_words, "word long, " + ", ".join(f"{c} long" for c in KINDS))
    words = materialize(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in KINDS)), "lm-words")
    v, *n = words.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in KINDS)).first()
    spaces = np.array([n[1], n[0], n[0] + n[1], n[2]]) + ADD * max(v, 1 << WORD_BITS)
    shards = max(shuffle_parts(spark), -(-n[2] // shard_tokens))
    common = sorted((r.word % (1 << 64), *(r[c] for c in KINDS)) for r in words.where(F.col("background") > n[2] / shards / 4).collect())
    discard(words)
    table = (np.array([c[0] for c in common], np.uint64), np.array([c[1:] for c in common], np.float64).reshape(-1, len(KINDS)).T)
    handle = spark.sparkContext.broadcast(table)

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _serve(batches, handle, spaces)

    answers = texts.mapInArrow(lambda x: _requests(x, shards, handle), _REQUEST).groupBy("shard").applyInArrow(serve, _ANSWER)
    scored = answers.groupBy("block").applyInArrow(releasing(_assemble), "_row long, n_tokens long, loss_target double, loss_background double")
    out = numbered.select("_doc", "_row").join(scored, "_row")
    score = F.col("loss_target") - F.col("loss_background")
    return out.select(*unpacked(keep, NEW), "n_tokens", "loss_target", "loss_background", score.alias("score"), (score < 0).alias("selected"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = load(spark, sf_dir, "labels").where("quality = 1")
    return score_documents(docs, wanted, keep=["doc_id"])
