"""Alignment of two tokenizers over a corpus, and how often each pair of their tokens stands for the same bytes.

Each text is encoded twice, with a space before it: by a byte-level BPE (A) and by a piece model with byte fallback (B). Where tokens of
both end at one byte, the text is cut; what lies between two cuts is a group. A token of A and one of B are linked where their bytes
overlap.

1. Encoding. A text is split before each space that follows a word (no entry of either vocabulary crosses such a place, which is
   checked as the files are loaded, so pieces are encoded as the text would be); the distinct pieces of a batch are encoded once. A text
   is given back byte by byte if all its pieces are.
2. Alignment. The tokens of a whole Arrow batch stand end to end, with the byte offsets of its documents. One bincount of A's ends and
   one of B's give the cuts, where both are positive. Each run of bytes between two ends of either is one link, since two ranges overlap
   in one run; running counts of the ends give the tokens of each link, and their differences at the document offsets the numbers of
   each document.
3. Counts. A document's distinct pairs are stored in the shared folder, packed, with how often each is linked; tasks add pairs up before
   they are shuffled, so what is counted grows with the corpus.
4. Lookup. At most `broadcast_pairs` of the most frequent pairs are broadcast (12 bytes each) and looked up where the documents stand.
   Every other pair has a smaller count than those, so no such pair has more than a 1 / broadcast_pairs share of all: these are joined by
   pair and summed by document. Nothing is left out.

Defined cases: texts that are null, empty, or that a tokenizer doesn't give back byte by byte have no tokens: zeros and an empty digest;
the strings of special tokens are plain text; repeated rows count as documents of their own; ids may be null or repeated; of equal
counts all are the highest of their A token; an empty table gives an empty result; a very long text is aligned in slices of whole pieces
(a piece, a word of any length, is the least that is held at once); columns of docs that are
not kept take no part, and kept ones that are named like a result are left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.common import load, materialize, packed, release, rows_of, text_chunks, unpacked

TOKENIZERS = "/opt/tokenizers"
#: Most pairs that are broadcast.
BROADCAST_PAIRS = 1 << 20
#: Bytes of text aligned at once, and pieces whose tokens a worker remembers.
SLICE = 1 << 19
REMEMBERED = 200_000
#: What B's tokenizer writes for a space.
SPACE_MARK = "▁".encode()
#: Pieces encoded in one call.
ENCODED = 4096
#: Distinct pairs that a task holds before it sends them on.
HELD_PAIRS = 1 << 21
#: Counts from here on share a bucket with others of nearly their size in the histogram that finds the frequent pairs.
EXACT_COUNTS = 1024
NEW = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# ---------------------------------------------------------------- two vocabularies


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of each of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        known, byte = self.a.get_vocab(), byte_characters()
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for token, k in known.items():
            self.bytes_a[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([str(k) for k in range(len(v))] for v in (self.bytes_a, self.bytes_b))
        #: No entry crosses a place where piece_starts() cuts.
        self.splits = not any(x[k] == 0x20 and ends_word(x[:k]) for v in (self.bytes_a, self.bytes_b) for x in v for k in range(1, len(x)))
        self.width = len(self.bytes_b)
        self.code = np.uint32 if len(self.bytes_a) * self.width < 1 << 32 else np.uint64
        self.memory: dict[bytes, tuple] = {}

    def _piece(self, k: int) -> bytes:
        if self.b.is_control(k) or self.b.is_unknown(k):
            return b""
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(k) else piece.encode().replace(SPACE_MARK, b" ")

    def encode(self, pieces: list[bytes]) -> list[tuple]:
        """(A ids and B ids as bytes of int32, whether both give the piece back, text of its groups) of each piece. A piece starts with a
        space, which B's tokenizer adds by itself."""
        new = [p for p in pieces if p not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory = {p: self.memory[p] for p in pieces if p in self.memory}
        joined = [p for p in new if self.splits and ends_word(p) and SPACE_MARK not in p]
        for i in range(0, len(joined), ENCODED):
            self._encode_joined(joined[i : i + ENCODED])
        for p in new:
            if p not in self.memory:
                self._remember([p], [self._ids(p)])
        return [self.memory[p] for p in pieces]

    def _ids(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        text = text.decode()
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int32), np.array(self.b.encode(text[1:]), np.int32)

    def _encode_joined(self, pieces: list[bytes]) -> None:
        """Encode pieces that end with a word as one text, and remember each if the whole is given back."""
        a, b = self._ids(b"".join(pieces))
        ends = np.cumsum([len(p) for p in pieces])
        at = []
        for ids, sizes, known in ((a, self.len_a, self.bytes_a), (b, self.len_b, self.bytes_b)):
            upto = np.cumsum(sizes[ids])
            cut = np.searchsorted(upto, ends) + 1
            if upto[-1] != ends[-1] or (upto[cut - 1] != ends).any() or b"".join([known[k] for k in ids.tolist()]) != b"".join(pieces):
                return
            at.append([0, *cut.tolist()])
        self._remember(pieces, [(a[i:j], b[k:m]) for (i, j), (k, m) in zip(itertools.pairwise(at[0]), itertools.pairwise(at[1]), strict=True)])

    def _remember(self, pieces: list[bytes], ids: list[tuple[np.ndarray, np.ndarray]]) -> None:
        good = [b"".join([self.bytes_a[k] for k in x.tolist()]) == p == b"".join([self.bytes_b[k] for k in y.tolist()]) for p, (x, y) in zip(pieces, ids, strict=True)] if len(pieces) == 1 else [True] * len(pieces)
        groups = iter(self.group_texts([x for x, g in zip(ids, good, strict=True) if g]))
        self.memory.update((p, (x.tobytes(), y.tobytes(), g, next(groups) if g else "")) for p, (x, y), g in zip(pieces, ids, good, strict=True))

    def group_texts(self, ids: list[tuple[np.ndarray, np.ndarray]]) -> list[str]:
        """`a1,a2|b1;a3|b2` of each piece, from the cuts of all of them end to end."""
        if not ids:
            return []
        a, b = (np.concatenate(x) for x in zip(*ids, strict=True))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts = common_ends(ends_a, ends_b)[2]
        group = np.concatenate([np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)])
        side = np.repeat(np.array([0, 1]), [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side = group[order], side[order]
        after = np.where(group[1:] != group[:-1], ";", np.where(side[1:] != side[:-1], "|", ",")).tolist()
        words = [*map(self.text_a.__getitem__, a.tolist()), *map(self.text_b.__getitem__, b.tolist())]
        flat = [words[k] + s for k, s in zip(order.tolist(), [*after, ";"], strict=True)]
        sizes = np.cumsum([len(x) + len(y) for x, y in ids])
        return ["".join(flat[i:j])[:-1] for i, j in zip([0, *sizes[:-1].tolist()], sizes.tolist(), strict=True)]


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


# ---------------------------------------------------------------- alignment of a batch


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a token of A, and of B, ends at each byte offset; and the offsets where both do."""
    size = int(max(ends_a[-1:].max(initial=0), ends_b[-1:].max(initial=0))) + 1
    in_a, in_b = np.bincount(ends_a, minlength=size) > 0, np.bincount(ends_b, minlength=size) > 0
    return in_a, in_b, np.flatnonzero(in_a & in_b)


def ends_word(piece: bytes) -> bool:
    """Whether a piece may start after these bytes: see piece_starts(). Of a character of two bytes, the first may be missing."""
    return 0x20 < piece[-1] < 0x7F or (piece[-1] >= 0x80 and (len(piece) == 1 or 0xC3 <= piece[-2] <= 0xDF))


def piece_starts(data: np.ndarray, at: np.ndarray, split: bool) -> np.ndarray:
    """Offsets in data (rows that start with a space each) where a piece starts: each row's start, and each space after a word's last
    character (a printable ASCII one, or one of two bytes that can't be white space) but the last of a row, as B's tokenizer gives no token
    for an empty text."""
    new = np.zeros(len(data), bool)
    if split and len(data) > 2:
        last, before = data[1:-1], data[:-2]
        wordy = ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (before >= 0xC3) & (before <= 0xDF))
        new[2:] = (data[2:] == 0x20) & wordy
    full = np.diff(at) > 0
    new[at[1:][full] - 1] = False
    new[at[:-1][full]] = True
    return np.flatnonzero(new)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each start and length, end to end."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


class Rows:
    """What is known of each row of a run of texts."""

    def __init__(self, n: int):
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.spoilt = np.zeros(n, bool)
        self.digest: list = [None] * n
        self.pairs: list[list] = [[] for _ in range(n)]

    def spoil(self, row: int) -> None:
        """The row has no tokens, whatever was found of it."""
        self.spoilt[row], self.digest[row], self.pairs[row] = True, None, []
        for numbers in (self.n_a, self.n_b, self.n_groups, self.n_links):
            numbers[row] = 0

    def write(self, rows: np.ndarray, parts: np.ndarray, own: np.ndarray, texts: list[str]) -> None:
        """Add the groups of pieces own[parts[k] : parts[k + 1]] to the digest of rows[k]."""
        indices, parts = own.tolist(), parts.tolist()
        for row, (p, q) in zip(rows.tolist(), itertools.pairwise(parts), strict=True):
            if self.digest[row] is None:
                self.digest[row] = hashlib.sha256()
            else:
                self.digest[row].update(b";")
            self.digest[row].update(";".join([texts[x] for x in indices[p:q]]).encode())


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a space before each that isn't empty."""
    full = np.diff(at) > 0
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) + full)])
    out = np.full(out_at[-1], 0x20, np.uint8)
    spaces = np.zeros(len(out), bool)
    spaces[out_at[:-1][full]] = True
    out[~spaces] = data
    return out, out_at


def align_rows(pair: Pair, data: np.ndarray, at: np.ndarray, into: Rows) -> None:
    """Align rows of text (each with its space) into `into`, in slices of whole pieces. A piece that isn't given back spoils its row."""
    starts = piece_starts(data, at, pair.splits)
    ends = np.append(starts[1:], len(data))
    rows = np.searchsorted(at, starts, "right") - 1
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        offsets = np.append(starts[i:j], ends[j - 1]) - starts[i]
        text = np.ascontiguousarray(data[starts[i] : ends[j - 1]])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
        which, row, sizes = pieces.indices.to_numpy(), rows[i:j], np.diff(offsets)
        known = pair.encode(pieces.dictionary.to_pylist())
        good = np.array([k[2] for k in known], bool)
        for r in np.unique(row[~good[which]]).tolist():
            into.spoil(r)
        kept = ~into.spoilt[row]
        which, row, sizes = which[kept], row[kept], sizes[kept]
        if len(which):
            _align_slice(pair, known, which, row, sizes, into)
        i = j


def _align_slice(pair: Pair, known: list[tuple], own: np.ndarray, row: np.ndarray, sizes: np.ndarray, into: Rows) -> None:
    """own: the piece (of `known`) at each place, row and sizes: its row and its bytes."""
    new = np.append(True, row[1:] != row[:-1])
    rows, at_bytes = row[new], np.concatenate([[0], np.cumsum(sizes)])
    edges = np.append(at_bytes[:-1][new], at_bytes[-1])
    lengths, flat = [], []
    for side in range(2):
        n = np.array([len(k[side]) for k in known], np.int64) // 4
        lengths.append(n)
        flat.append((np.frombuffer(b"".join([k[side] for k in known]), np.int32).astype(np.int64), np.cumsum(n) - n))
    into.write(rows, np.append(np.flatnonzero(new), len(own)), own, [k[3] for k in known])
    a, b = (gather(ids, starts[own], n[own]) for (ids, starts), n in zip(flat, lengths, strict=True))
    ends_a, ends_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
    in_a, in_b, _ = common_ends(ends_a, ends_b)
    upto_a, upto_b, cuts, links = (np.cumsum(x) for x in (in_a, in_b, in_a & in_b, in_a | in_b))
    for name, upto in (("n_a", upto_a), ("n_b", upto_b), ("n_groups", cuts), ("n_links", links)):
        getattr(into, name)[rows] += np.diff(upto[edges])
    ends = np.flatnonzero(in_a | in_b)
    code = a[upto_a[ends] - in_a[ends]] * pair.width + b[upto_b[ends] - in_b[ends]]
    per_row = np.diff(links[edges])
    local = np.repeat(np.arange(len(rows)), per_row)
    order = np.lexsort((code, local)) if pair.code is np.uint64 else np.argsort(local << 32 | code)
    code, local = code[order], local[order]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (local[1:] != local[:-1])))
    times = np.diff(np.append(new, len(code)))
    code, local = code[new].astype(pair.code), local[new]
    at = np.searchsorted(local, np.arange(len(rows) + 1))
    for k, row in enumerate(rows.tolist()):
        into.pairs[row].append((code[at[k] : at[k + 1]], times[at[k] : at[k + 1]]))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their sums over (codes, numbers) arrays."""
    if len(parts) == 1:
        return parts[0]
    codes, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, back = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(back, weights=numbers, minlength=len(distinct)).astype(np.int64)


def _aligner(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            for i, j, data, at in text_chunks(batch.column("_text"), SLICE):
                found = Rows(j - i)
                align_rows(pair, *spaced(data, at), found)
                merged = [_merged(p) if p else (np.zeros(0, pair.code), np.zeros(0, np.int64)) for p in found.pairs]
                made = {
                    **{n: pa.array(getattr(found, n)) for n in ("n_a", "n_b", "n_groups", "n_links")},
                    "groups_sha256": pa.array([d.hexdigest() if d else "" for d in found.digest], pa.string()),
                    "_pairs": pa.array([c.tobytes() for c, _ in merged], pa.binary()),
                    "_times": pa.array([t.astype(np.uint32).tobytes() for _, t in merged], pa.binary()),
                }
                kept = ["_row", "_doc"]
                yield pa.RecordBatch.from_arrays([batch.column(n).slice(i, j - i) for n in kept] + list(made.values()), names=kept + list(made))
                del found, merged, made, data, at
            del batch
            release()

    return run


# ---------------------------------------------------------------- counts over the corpus


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, end to end, and the first of each row."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)), (at - at[0]) // np.dtype(kind).itemsize


def _counter(kind: type, held: int):
    def batch_of(codes: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(numbers)], names=["_pair", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            codes, _ = _flat(batch.column(0), kind)
            distinct, numbers = np.unique(codes, return_counts=True)
            parts.append((distinct, numbers))
            size += len(distinct)
            if size > held:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > held // 2:
                    yield batch_of(*parts[0])
                    parts, size = [], 0
        if parts:
            yield batch_of(*_merged(parts))
        release()

    return run


def pair_counts(stored: DataFrame, kind: type, width: int) -> DataFrame:
    """_pair, _n (documents that hold it) and _best (whether _n is the highest of its A token)."""
    partial = stored.select("_pairs").mapInArrow(_counter(kind, HELD_PAIRS), "_pair long, _n long")
    counts = materialize(partial.groupBy("_pair").agg(F.sum("_n").alias("_n")), "alignment-counts")
    token = F.expr(f"_pair div {width}")
    # One row for each entry of A's vocabulary at most.
    highest = counts.groupBy(token.alias("_token")).agg(F.max("_n").alias("_most"))
    return counts.withColumn("_token", token).join(highest, "_token").select("_pair", "_n", (F.col("_n") == F.col("_most")).alias("_best"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` pairs have it or more; 0 if all pairs are so few, 2**62 if the most frequent are too many."""
    step = F.floor(F.log2("_n") * 16)
    bucket = F.when(F.col("_n") < EXACT_COUNTS, F.col("_n")).otherwise(EXACT_COUNTS + step)
    # At most EXACT_COUNTS + 64 * 16 rows.
    rows = counts.groupBy(bucket.alias("_bucket")).agg(F.min("_n").alias("_least"), F.count(F.lit(1)).alias("_pairs")).collect()
    total, least = 0, 1 << 62
    for row in sorted(rows, key=lambda r: -r._least):
        total += row._pairs
        if total > most:
            return least
        least = row._least
    return 0


def _looker(kind: type, table, rest: bool):
    """Sums of each row over the pairs of the broadcast table; or, with rest, the pairs that are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers, best = table.value
        for batch in batches:
            own, at = _flat(batch.column("_pairs"), kind)
            times, _ = _flat(batch.column("_times"), np.uint32)
            place = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
            there = codes[place] == own if len(codes) else np.zeros(len(own), bool)
            row = rows_of(at)
            if rest:
                out = {"_row": pa.array(batch.column("_row").to_numpy()[row[~there]]), "_pair": pa.array(own[~there].astype(np.int64)), "_times": pa.array(times[~there].astype(np.int64))}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                continue
            times, place, row = times[there].astype(np.int64), place[there], row[there]
            sums = np.zeros((2, len(at) - 1), np.int64)
            np.add.at(sums[0], row, times * best[place])
            np.add.at(sums[1], row, times * numbers[place])
            kept = [n for n in batch.schema.names if n not in ("_pairs", "_times")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(sums[0]), pa.array(sums[1])], names=[*kept, "n_best", "count_sum"])
        release()

    return run


def align_tokens(docs: DataFrame, tokenizers: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text_col: str = "text", keep: list[str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """docs (all columns, or those of `keep`) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256. tokenizers: the
    folder of both files, which every executor has to have."""
    path_a, path_b = f"{tokenizers}/{a}", f"{tokenizers}/{b}"
    pair, spark = pair_of(path_a, path_b), docs.sparkSession
    keep = docs.columns if keep is None else keep
    given = docs.select(F.monotonically_increasing_id().alias("_row"), packed(docs, keep), F.col(f"`{text_col.replace('`', '``')}`").cast("string").alias("_text"))
    numbers = [T.StructField(n, T.LongType()) for n in NEW[:4]]
    schema = T.StructType([*given.schema.fields[:2], *numbers, T.StructField("groups_sha256", T.StringType()), T.StructField("_pairs", T.BinaryType()), T.StructField("_times", T.BinaryType())])
    stored = materialize(given.mapInArrow(_aligner(path_a, path_b), schema), "alignment-docs", "zstd")
    counts = materialize(pair_counts(stored, pair.code, pair.width), "alignment-pairs")
    least = frequent_from(counts, broadcast_pairs)
    table = counts.where(F.col("_n") >= least).orderBy("_pair").toArrow()
    codes, n, best = (c.to_numpy() for c in table.columns)
    sent = spark.sparkContext.broadcast((codes.astype(pair.code), n, best.astype(np.int64)))
    sums = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    out = stored.mapInArrow(_looker(pair.code, sent, False), T.StructType([*schema.fields[:-2], *sums]))
    if least:
        rare = stored.select("_row", "_pairs", "_times").mapInArrow(_looker(pair.code, sent, True), "_row long, _pair long, _times long")
        rare = rare.join(counts.where(F.col("_n") < least), "_pair").groupBy("_row").agg(F.sum(F.col("_times") * F.col("_best").cast("long")).alias("_b"), F.sum(F.col("_times") * F.col("_n")).alias("_s"))
        out = out.join(rare, "_row", "left").withColumns({c: F.col(c) + F.coalesce(extra, F.lit(0)) for c, extra in (("n_best", F.col("_b")), ("count_sum", F.col("_s")))})
    return out.select(*unpacked(keep, NEW), *NEW)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over every document."""
    return align_tokens(load(spark, sf_dir, "documents"), keep=["doc_id"])
