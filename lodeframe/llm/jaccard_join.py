"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word 5-grams (64-bit hashes); two are linked from a similarity of 75 % on. The join is exact:

1. Every document's set is cut by hash into shards; a shard counts in how many documents each n-gram stands and sends back only those
   in two or more. Sets travel packed, one row for each (block of documents, shard). A document of which fewer than 75 % of the n-grams
   stand elsewhere links with nothing and is done.
2. Documents with equal sets are one class from here on; n-grams are counted again among classes. The global order of n-grams is by
   that count, rare ones first, then by hash. n-grams that stand in one class only come before all others.
3. Vertical partitioning: pivots cut the global order into `fragments`, and each class into one row for each fragment. The overlap of a
   candidate pair is counted inside each fragment on its own, and the partial counts are added up for each pair.
4. Candidates share an n-gram of both prefixes (the first n - ceil(0.75 n) + 1 n-grams in the global order) and pass the length and
   position filters. First each class is compared with one hub alone, so a large group of near copies gives a star of links rather than
   all of its pairs. After that only pairs of different components are left: those of classes outside the largest component of an
   n-gram's list with all others of the list. A pair inside a component can't change the components and is not counted again.
5. Components of the links; each document gets the smallest doc_id of its component.

Defined cases: null, empty and space-only texts have an empty set and link with nothing; a text of fewer than five words has one n-gram,
all its words; repeated rows are one class; rows that share a doc_id are judged by their texts; null ids take part, and the smallest id
that is not null names the component; n-grams of equal count are in order of their hash; an empty table gives an empty result; a very
long text is hashed piece by piece; the result has columns of its own, so names of other columns don't matter. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import LOWER, SPACES, load, materialize, mix, named, release, releasing, rows_of, shuffle_parts, split_words, text_chunks, windows, word_hashes
from lodeframe.llm.components import components
from lodeframe.tables import discard

NGRAM = 5
PERCENT = 75
FRAGMENTS = 8
#: Bytes of text of which one shard counts the n-grams, in memory.
SHARD_BYTES = 16 << 20
_REQUEST = "shard int, block long, ids binary, sizes binary, counts binary, grams binary"
_ANSWER = "block long, ids binary, sizes binary, rows binary, grams binary, dfs binary"
_PACKED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])
_ANSWERED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("rows", pa.binary()), ("grams", pa.binary()), ("dfs", pa.binary())])


def least_common(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The smallest overlap with which a set of n elements can be linked to anything."""
    return -(-n * percent // 100)


def shingles(data: np.ndarray, at: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct n-gram, sorted by both."""
    low = LOWER[data]
    starts, ends, first = split_words(low, at, ~SPACES[low])
    words, row = word_hashes(low, starts, ends), rows_of(first)
    grams = windows(words, n)
    inside = row[: len(grams)] == row[n - 1 :] if len(grams) else np.zeros(0, bool)
    rows, hashes = [row[: len(grams)][inside]], [grams[inside]]
    count = np.diff(first)
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(size):
                whole = whole * np.uint64(0xD6E8FEB86659FD93) + words[first[short] + k]
            rows.append(short)
            hashes.append(mix(whole ^ np.uint64(size)))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _pack(block: int, shards: int, rows: np.ndarray, grams: np.ndarray, n_rows: int, ids: bytes, sizes: bytes) -> pa.RecordBatch:
    """One row for each shard with its n-grams, in order of rows; one more with the block's own data, which shards pass on."""
    shard = (grams % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    out = [(block % shards, block, ids, sizes, None, None)]
    for s in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[s] : cuts[s + 1]]
        out.append((int(s), block, None, None, np.bincount(rows[own], minlength=n_rows).astype(np.uint32).tobytes(), grams[own].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _requests_of_texts(batches: Iterator[pa.RecordBatch], shards: int, n: int) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for a, b, data, at in text_chunks(batch.column("text"), 2 << 20):
            rows, grams = shingles(data, at, n)
            counts = np.bincount(rows, minlength=b - a)
            ends = np.cumsum(counts)
            sums = []
            for salt in (0x452821E638D01377, 0xBE5466CF34E90C6C):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
                sums.append(total[ends] - total[ends - counts])
            ids = pa.record_batch({"id": batch.column("doc_id")[a:b]}).serialize().to_pybytes()
            yield _pack(block, shards, rows, grams, b - a, ids, np.stack([counts.astype(np.uint64), *sums]).tobytes())
            block += 1
        del batch
        release()


def _requests_of_classes(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            lists = part.column("grams")
            grams = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = pa.record_batch({"id": part.column("class")}).serialize().to_pybytes()
            n = part.column("n").to_numpy(zero_copy_only=False).astype(np.uint64)
            yield _pack(block, shards, rows, grams, part.num_rows, ids, np.stack([n, n, n]).tobytes())
            block += 1


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard: counts each n-gram over all blocks and answers each block with those that stand in two rows or more."""
    parts = []
    for batch in batches:
        for k in range(batch.num_rows):
            block, ids = batch.column("block")[k].as_py(), batch.column("ids")[k].as_py()
            if ids is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, ids, batch.column("sizes")[k].as_py(), None, None, None), _ANSWERED, strict=True)], schema=_ANSWERED)
            else:
                counts = np.frombuffer(batch.column("counts")[k].as_py(), np.uint32)
                parts.append((block, np.repeat(np.arange(len(counts), dtype=np.uint32), counts), np.frombuffer(batch.column("grams")[k].as_py(), np.uint64)))
    if not parts:
        return
    grams = np.concatenate([p[2] for p in parts])
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    df = np.empty(len(grams), np.uint32)
    df[order] = np.diff(np.append(np.flatnonzero(new), len(ranked)))[np.cumsum(new) - 1]
    at = 0
    for block, rows, own in parts:
        d = df[at : at + len(own)]
        at += len(own)
        some = d > 1
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, None, None, rows[some].tobytes(), own[some].tobytes(), d[some].tobytes()), _ANSWERED, strict=True)], schema=_ANSWERED)


def _assemble(table: pa.Table, percent: int, all_rows: bool, schema: pa.Schema) -> pa.Table:
    """A block's rows from the answers of all shards; n-grams in the global order."""
    head, rows, grams, dfs = None, [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for k in range(table.num_rows):
        if (ids := table.column("ids")[k].as_py()) is not None:
            head = (pa.ipc.read_record_batch(pa.py_buffer(ids), pa.schema([("id", pa.int64())])).column(0), np.frombuffer(table.column("sizes")[k].as_py(), np.uint64).reshape(3, -1))
        else:
            rows.append(np.frombuffer(table.column("rows")[k].as_py(), np.uint32))
            grams.append(np.frombuffer(table.column("grams")[k].as_py(), np.uint64))
            dfs.append(np.frombuffer(table.column("dfs")[k].as_py(), np.uint32))
    ids, (n, h1, h2) = head
    rows, grams, dfs = np.concatenate(rows), np.concatenate(grams), np.concatenate(dfs)
    live = np.bincount(rows, minlength=len(n)) >= np.maximum(least_common(n.astype(np.int64), percent), 1)
    some = live[rows]
    rows, grams, dfs = rows[some], grams[some], dfs[some]
    order = np.lexsort((grams, dfs, rows))
    counts = np.bincount(rows, minlength=len(n))
    keep = np.ones(len(n), bool) if all_rows else live
    offsets = np.concatenate([[0], np.cumsum(counts[keep])]).astype(np.int32)
    columns = {
        "id": ids.filter(pa.array(keep)),
        "n": pa.array(n[keep].astype(np.int64)),
        "h1": pa.array(h1[keep].view(np.int64)),
        "h2": pa.array(h2[keep].view(np.int64)),
        "live": pa.array(live[keep]),
        "grams": pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[order].view(np.int64))),
        "dfs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(dfs[order].astype(np.int32))),
    }
    return pa.table([columns[f.name] for f in schema], schema=schema)


_LIVE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("live", pa.bool_()), ("grams", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int32()))])


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _shared(batches)
    release()


def _exchange(requests: DataFrame, percent: int, all_rows: bool) -> DataFrame:
    answers = requests.groupBy("shard").applyInArrow(_serve, _ANSWER)
    return answers.groupBy("block").applyInArrow(releasing(lambda table: _assemble(table, percent, all_rows, _LIVE)), "id long, n long, h1 long, h2 long, live boolean, grams array<long>, dfs array<int>")


def _fragments(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("grams")
        grams = lists.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        piece = np.searchsorted(pivots, _order_key(batch.column("dfs").flatten().to_numpy(zero_copy_only=False), grams), "right")
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (piece[1:] != piece[:-1])
        at = np.flatnonzero(new)
        yield pa.record_batch({"class": batch.column("class").take(pa.array(rows[at])), "fragment": pa.array(piece[at].astype(np.int32)), "grams": pa.ListArray.from_arrays(pa.array(np.append(at, len(rows)).astype(np.int32)), pa.array(grams))})


def _order_key(dfs: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A place in the global order that 63 bits can hold: rows sorted by (df, gram) are sorted by it."""
    return (np.minimum(dfs.astype(np.int64), 32767) << 48) | (grams.view(np.uint64) >> np.uint64(16)).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = np.sort(_order_key(batch.column("dfs").flatten().to_numpy(zero_copy_only=False), batch.column("grams").flatten().to_numpy(zero_copy_only=False)))
        if len(key):
            yield pa.record_batch({"key": pa.array(key[:: max(1, len(key) // 256)])})


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(gram, class, n, place): the n-grams of each prefix that stand in two classes or more, with their place in the whole order."""
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        m = batch.column("grams").value_lengths().to_numpy(zero_copy_only=False)
        alone = n - m
        length = np.clip(n - least_common(n, percent) + 1 - alone, 0, m)
        starts = np.concatenate([[0], np.cumsum(m)[:-1]]) if len(m) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(n)), length)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)
        grams = batch.column("grams").flatten().to_numpy(zero_copy_only=False)
        yield pa.record_batch({"gram": pa.array(grams[starts[rows] + inner]), "class": batch.column("class").take(pa.array(rows)), "n": pa.array(n[rows]), "place": pa.array((alone[rows] + inner).astype(np.int64)), "alone": pa.array(alone[rows].astype(np.int64))})


def _may_link(n1: str, p1: str, n2: str, p2: str, percent: int) -> str:
    """SQL: what the sizes and the places of the first common n-gram allow."""
    least = f"{percent} * ({n1} + {n2})"
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND {100 + percent} * least({n1} - {p1}, {n2} - {p2}) >= {least}"


def _verify(pairs: DataFrame, pieces: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. Overlaps are counted fragment by fragment and added up."""
    left = pairs.join(pieces.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("ga")), "a")
    both = left.join(pieces.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
    partial = both.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("common"))
    summed = partial.groupBy("a", "b").agg(F.sum("common").alias("common"))
    sized = summed.join(sizes.select(F.col("class").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("class").alias("b"), F.col("n").alias("nb")), "b")
    return sized.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b", "common")


def join_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """A row (doc_id, n_shingles, h1, h2, component_id) for each row of docs; (h1, h2) is the same for equal sets only."""
    spark = docs.sparkSession
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(4 * shuffle_parts(spark), -(-size // SHARD_BYTES))
    told = materialize(_exchange(texts.mapInArrow(lambda x: _requests_of_texts(x, shards, ngram), _REQUEST), percent, True).select("id", "n", "h1", "h2", "live", "grams"), "jaccard-documents")

    # Classes of equal sets. The number is given once, as the table is written.
    groups = told.where("live").groupBy("h1", "h2").agg(F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("grams").alias("grams"))
    numbered = materialize(groups.withColumn("class", F.monotonically_increasing_id()), "jaccard-numbered")
    whole, told = told, materialize(told.select("id", "n", "h1", "h2"), "jaccard-rows")
    discard(whole)
    live = materialize(_exchange(numbered.select("class", "n", "grams").mapInArrow(lambda x: _requests_of_classes(x, shards), _REQUEST), percent, False).select(F.col("id").alias("class"), "n", "grams", "dfs"), "jaccard-live")
    classes = materialize(numbered.select("class", "h1", "h2", "least_id"), "jaccard-classes")
    discard(numbered)

    pivots = live.mapInArrow(_keys, "key long").agg(F.percentile_approx("key", [k / fragments for k in range(1, fragments)])).first()[0]
    cuts = np.unique(np.array(pivots or [0], np.int64))
    pieces = materialize(live.select("class", "grams", "dfs").mapInArrow(lambda x: _fragments(x, cuts), "class long, fragment int, grams array<long>"), "jaccard-fragments")
    postings = materialize(live.select("class", "n", "grams").mapInArrow(lambda x: _prefixes(x, percent), "gram long, class long, n long, place long, alone long"), "jaccard-prefixes")
    sizes = materialize(live.select("class", "n"), "jaccard-sizes")
    discard(live)

    # A star for each list: its class with the fewest n-grams of its own is the hub; each class is compared with the hub it meets most.
    hubs = postings.groupBy("gram").agg(F.min(F.struct("alone", "class", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = postings.join(hubs, "gram").where("class <> hub.class").where(_may_link("n", "place", "hub.n", "hub.place", percent))
    best = met.groupBy("class", F.col("hub.class").alias("hub")).count().groupBy("class").agg(F.max(F.struct("count", -F.col("hub"))).alias("best"))
    stars = best.select(F.col("class").alias("a"), (-F.col("best.col2")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(_verify(stars, pieces, sizes, percent), "jaccard-stars")
    labels = components(links, "jaccard-stars")

    # What is left: pairs of different components.
    held = postings.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    parts = held.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("gram").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("gram", "main")
    lists = materialize(held.join(mixed, "gram"), "jaccard-mixed")
    others = lists.where("label <> main").select("gram", *[F.col(c).alias(f"{c}_o") for c in ("class", "label", "n", "place")])
    rest = others.join(lists, "gram").where("label <> label_o").where(_may_link("n", "place", "n_o", "place_o", percent)).select(F.least("class", "class_o").alias("a"), F.greatest("class", "class_o").alias("b")).distinct()
    more = materialize(_verify(rest, pieces, sizes, percent), "jaccard-rest")
    every = components(links.select("a", "b").union(more.select("a", "b")), "jaccard") if more.take(1) else labels

    labelled = classes.select("class", "h1", "h2", "least_id").join(every.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    out = told.select("id", "n", "h1", "h2").join(labelled.join(least, "label").select("h1", "h2", "component_id"), ["h1", "h2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "h1", "h2", F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: The same over the whole table, for DuckDB.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT a AS doc_id, b AS m FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.m = l.a),
k AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(documents.doc_id, coalesce(m, documents.doc_id)) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN k ON k.doc_id = documents.doc_id
"""
