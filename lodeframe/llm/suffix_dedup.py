"""Exact repeats of 100 bytes and more, by a logarithmic family of sparse suffix arrays.

A byte goes if a 100-byte string over it also starts earlier (in a document of smaller doc_id, or earlier in the same document).

Suffixes are taken at sampled positions only: of the 32-byte grams inside a 100-byte string the one with the least hash (the leftmost
of equals) is its anchor, so equal strings have the same anchor, and about 3 % of all positions are anchors. The strings that share an
anchor start at consecutive places; the text that they cover is the anchor's segment. A suffix array holds a fingerprint of each
anchor's gram and segment (64 bits each) in sorted order, once for each block of documents, for its earliest place in the block.

Arrays are cut by gram into shards. In a shard every block is a new batch: its array is merge-scanned against the existing levels of the
family; what is found there is a repeat of whichever of the two is earlier, what is new becomes the newest level, and levels of like size
merge, so a shard keeps a logarithmic number of levels. A segment that is found makes all of its strings repeats. Where a gram has
several different segments (at the edges of repeats) the strings of the first place of each segment are compared one by one, by a
second family over their fingerprints. Fingerprints order the arrays, as only equality over 100 bytes matters here, not the order of
the text; two different strings would have to agree in 64 bits, among those of one shard, to be confused.

Blocks recompute their arrays rather than store them; texts are shuffled once, and a shard answers with one byte for each entry. A block
sends an entry once however often it has it, so a repeat in a third of all documents is one entry for each block.

SuffixIndex (suffix_index.py) keeps the family in a folder between batches.

Defined cases: null and empty texts have no bytes and no repeats; texts of under 100 bytes stay whole; a null doc_id counts as later than
any other; rows with the same id are in order of their text, and a row that repeats another loses all of its strings; an empty table gives
an empty result; a very long text is one block's, hashed in pieces; the result has columns of its own, so names of other columns don't
matter. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import load, mix, named, powers, prefix_hash, releasing, spans, substring_hash

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 6 << 20
#: Bytes of text for each shard: a task holds the entries of one, about 3 % of its bytes in number.
SHARD_BYTES = 4 << 20
LEAST_SHARDS = 32
CHUNK = 1 << 20
LAST = np.iinfo(np.int64).max
#: What a shard says about an entry.
FIRST, REPEAT, MIXED = 0, 1, 2
_REQUEST = "shard int, block long, kind int, keys binary, grams binary, docs binary"
_REQUESTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("grams", pa.binary()), ("docs", pa.binary())])
_ANSWER = "block long, shard int, kind int, states binary"
_ANSWERS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("states", pa.binary())])
SEGMENTS, STRINGS = 1, 2


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, gram hash, segment hash) of each anchor, in order of place; no string crosses rows."""
    p1, p2, grams, segments, _ = placed_anchors(data, at, length, gram)
    return p1, p2, grams, segments


def placed_anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchors(), and where each anchor's gram stands."""
    room = np.maximum(np.diff(at) - length + 1, 0)
    total = int(room.sum())
    if not total:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sums = prefix_hash(data)
    m = len(data) - gram + 1
    hashes = mix((sums[gram:] - sums[:m]) * powers(len(sums))[1][:m] + np.uint64(gram))
    bits = np.uint64(len(data).bit_length())
    least = ((hashes >> bits) << bits) | np.arange(m, dtype=np.uint64)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    rest = width - span
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    starts = np.repeat(at[:-1] - (np.cumsum(room) - room), room) + np.arange(total)
    place = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    p1, p2 = starts[first], starts[np.append(first[1:], total) - 1]
    return p1, p2, hashes[place[first]], substring_hash(sums, p1, p2 + length), place[first]


class Family:
    """Levels of sorted keys, each key with its earliest owner. states[batch][entry] tells what became of each entry."""

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []
        self.states: list[np.ndarray] = []
        self.rank: list[int] = []

    def add(self, keys: np.ndarray, grams: np.ndarray, docs: np.ndarray, rank: int) -> None:
        """A new batch, sorted by key, each key once. rank: orders batches of equal doc."""
        batch = len(self.states)
        self.states.append(np.zeros(len(keys), np.uint8))
        self.rank.append(rank)
        fresh = np.ones(len(keys), bool)
        for level in self.levels:
            todo = np.flatnonzero(fresh)
            slot = np.minimum(np.searchsorted(level["keys"], keys[todo]), len(level["keys"]) - 1)
            same = level["keys"][slot] == keys[todo]
            mine, theirs = todo[same], slot[same]
            fresh[mine] = False
            old = np.array(self.rank)[level["batch"][theirs]]
            wins = (docs[mine] < level["docs"][theirs]) | ((docs[mine] == level["docs"][theirs]) & (rank < old))
            self.states[batch][mine[~wins]] = REPEAT
            for k in np.unique(level["batch"][theirs[wins]]):
                own = theirs[wins][level["batch"][theirs[wins]] == k]
                self.states[k][level["entry"][own]] = REPEAT
            level["docs"][theirs[wins]] = docs[mine[wins]]
            level["batch"][theirs[wins]] = batch
            level["entry"][theirs[wins]] = mine[wins]
        if fresh.any():
            some = np.flatnonzero(fresh)
            self.levels.append({"keys": keys[some], "grams": grams[some], "docs": docs[some].copy(), "batch": np.full(len(some), batch), "entry": some})
            while len(self.levels) > 1 and len(self.levels[-1]["keys"]) * 2 > len(self.levels[-2]["keys"]):
                self._merge()

    def _merge(self) -> None:
        newer, older = self.levels.pop(), self.levels.pop()
        both = {c: np.concatenate([older[c], newer[c]]) for c in older}
        order = np.argsort(both["keys"], kind="stable")
        self.levels.append({c: v[order] for c, v in both.items()})

    def mark_mixed(self) -> None:
        """Entries that are first of their key, but not the only key of their gram."""
        while len(self.levels) > 1:
            self._merge()
        for level in self.levels:
            order = np.argsort(level["grams"], kind="stable")
            grams = level["grams"][order]
            same = np.zeros(len(grams), bool)
            same[1:] = grams[1:] == grams[:-1]
            same[:-1] |= same[1:]
            some = order[same]
            batches, entries = level["batch"][some], level["entry"][some]
            by = np.argsort(batches, kind="stable")
            cuts = np.flatnonzero(np.append(True, batches[by][1:] != batches[by][:-1])) if len(by) else []
            for own in np.split(by, cuts[1:]) if len(by) else []:
                self.states[batches[own[0]]][entries[own]] = MIXED


class Block:
    """The texts of one block in order of (doc_id, text), and its suffix array."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").fill_null(LAST).to_pylist()
        texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in table.column("text")]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.real = [table.column("doc_id")[k].as_py() for k in order]
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.data = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(texts[k]) for k in order])]).astype(np.int64)
        del texts
        parts, first = [], 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.at, self.at[first] + CHUNK, "right")) - 1)
            # A row longer than a chunk is taken in pieces that share LENGTH - 1 bytes: each string is in one of them.
            for base in range(int(self.at[first]), int(self.at[last]), CHUNK) if last == first + 1 else [int(self.at[first])]:
                whole = last > first + 1
                end = int(self.at[last]) if whole else min(int(self.at[last]), base + CHUNK + LENGTH - 1)
                ends = self.at[first : last + 1] - base if whole else np.array([0, end - base])
                p1, p2, gram, segment = anchors(self.data[base:end], ends)
                parts.append((p1 + base, p2 + base, gram, mix(gram * np.uint64(0x9FB21C651E98DF25) + segment)))
            first = last
        self.p1, self.p2, self.grams, self.keys = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
        order = np.argsort(self.keys, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = self.keys[order][1:] != self.keys[order][:-1]
        #: Anchors that are the first of their key in this block, by key.
        self.heads = order[new]

    def docs_at(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.at, places, "right") - 1]

    def strings(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, fingerprint) of each string of the mixed heads, in order of place."""
        some = np.sort(self.heads[states == MIXED])
        out = []
        for group in np.split(some, np.flatnonzero(np.diff(self.p1[some] // CHUNK)) + 1) if len(some) else []:
            a, b = self.p1[group[0]], self.p2[group[-1]] + LENGTH
            count = self.p2[group] - self.p1[group] + 1
            starts = np.repeat(self.p1[group] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            sums = prefix_hash(self.data[a:b])
            out.append((starts, substring_hash(sums, starts - a, starts - a + LENGTH)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _split(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of shard, and where each shard begins among them."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _ask(block: int, kind: int, keys: np.ndarray, grams: np.ndarray | None, docs: np.ndarray, by: np.ndarray, shards: int) -> list[tuple]:
    order, cuts = _split(by, shards)
    return [(int(s), block, kind, *(x if x is None else x[order[cuts[s] : cuts[s + 1]]].tobytes() for x in (keys, grams, docs))) for s in np.flatnonzero(np.diff(cuts))]


def _states(answers: pa.Table, kind: int, by: np.ndarray, shards: int) -> np.ndarray:
    order, cuts = _split(by, shards)
    out = np.zeros(len(by), np.uint8)
    for k in range(answers.num_rows):
        if answers.column("kind")[k].as_py() == kind:
            s = answers.column("shard")[k].as_py()
            out[order[cuts[s] : cuts[s + 1]]] = np.frombuffer(answers.column("states")[k].as_py(), np.uint8)
    return out


def _ask_segments(key, table: pa.Table, shards: int) -> pa.Table:
    block = Block(table)
    h = block.heads
    return _table(_ask(key[0].as_py(), SEGMENTS, block.keys[h], block.grams[h], block.docs_at(block.p1[h]), block.grams[h], shards), _REQUESTS)


def _serve(table: pa.Table) -> pa.Table:
    """A shard: all blocks' arrays of one kind go through a family; answers given before are passed on."""
    out = []
    for kind in (SEGMENTS, STRINGS):
        rows = sorted((k for k in range(table.num_rows) if table.column("kind")[k].as_py() == kind), key=lambda k: table.column("block")[k].as_py())
        family = Family()
        for k in rows:
            keys, docs = np.frombuffer(table.column("keys")[k].as_py(), np.uint64), np.frombuffer(table.column("docs")[k].as_py(), np.int64)
            grams = table.column("grams")[k].as_py()
            family.add(keys, keys if grams is None else np.frombuffer(grams, np.uint64), docs, table.column("block")[k].as_py())
        if kind == SEGMENTS:
            family.mark_mixed()
        out += [(table.column("block")[k].as_py(), table.column("shard")[k].as_py(), kind, s.tobytes()) for k, s in zip(rows, family.states, strict=True)]
    for k in range(table.num_rows):
        if table.column("kind")[k].as_py() < 0:
            out.append((table.column("block")[k].as_py(), int.from_bytes(table.column("grams")[k].as_py(), "little"), -table.column("kind")[k].as_py(), table.column("keys")[k].as_py()))
    return _table(out, _ANSWERS)


def _ask_strings(key, table: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    if not table.num_rows:
        return _table([], _REQUESTS)
    number = key[0].as_py()
    block = Block(table)
    starts, prints = block.strings(_states(answers, SEGMENTS, block.grams[block.heads], shards))
    known, first = np.unique(prints, return_index=True)
    out = _ask(number, STRINGS, known, None, block.docs_at(starts[first]), known, shards)
    # The answers about segments go the same way, so that the last step gets everything from one place.
    out += [(answers.column("shard")[k].as_py(), number, -SEGMENTS, answers.column("states")[k].as_py(), answers.column("shard")[k].as_py().to_bytes(4, "little"), None) for k in range(answers.num_rows)]
    return _table(out, _REQUESTS)


def _finish(table: pa.Table, answers: pa.Table, shards: int, digest: bool) -> pa.Table:
    schema = _DIGESTS if digest else _SPANS
    if not table.num_rows:
        return _table([], schema)
    block = Block(table)
    states = _states(answers, SEGMENTS, block.grams[block.heads], shards)
    change = np.zeros(len(block.data) + 1, np.int32)
    gone = np.ones(len(block.p1), bool)
    gone[block.heads] = states == REPEAT
    np.add.at(change, block.p1[gone], 1)
    np.add.at(change, block.p2[gone] + LENGTH, -1)
    starts, prints = block.strings(states)
    known, first, which = np.unique(prints, return_index=True, return_inverse=True)
    again = np.ones(len(starts), bool)
    again[first] = False
    again |= (_states(answers, STRINGS, known, shards) == REPEAT)[which] if len(known) else False
    np.add.at(change, starts[again], 1)
    np.add.at(change, starts[again] + LENGTH, -1)
    removed = np.cumsum(change[:-1]) > 0
    a, b, runs = spans(removed, block.at)
    out = []
    for k, doc_id in enumerate(block.real):
        own = slice(block.at[k], block.at[k + 1])
        kept = block.data[own][~removed[own]].tobytes()
        n = own.stop - own.start
        if digest:
            out.append((doc_id, n, n - len(kept), runs[k + 1] - runs[k], hashlib.sha256(kept).hexdigest()))
        else:
            out.append((doc_id, n, (a[runs[k] : runs[k + 1]] - own.start).tolist(), (b[runs[k] : runs[k + 1]] - own.start).tolist(), kept))
    return _table(out, schema)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed_from", pa.list_(pa.int64())), ("removed_to", pa.list_(pa.int64())), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs its doc_id, n_bytes and either the removed runs [removed_from, removed_to) with the kept bytes, or (digest)
    their counts and a digest of the kept bytes."""
    text = named(text_col)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, shards = max(1, math.ceil(total / block_bytes)), max(LEAST_SHARDS, math.ceil(total / SHARD_BYTES))
    dealt = docs.select(named(id_col).cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(named(id_col), F.substring(text, 1, 200), F.octet_length(text)), F.lit(blocks)).alias("block"))
    grouped = dealt.groupBy("block")
    segments = grouped.applyInArrow(releasing(lambda key, table: _ask_segments(key, table, shards), 2), _REQUEST).groupBy("shard").applyInArrow(releasing(_serve, 1), _ANSWER)
    strings = grouped.cogroup(segments.groupBy("block")).applyInArrow(releasing(lambda key, table, answers: _ask_strings(key, table, answers, shards), 3), _REQUEST).groupBy("shard").applyInArrow(releasing(_serve, 1), _ANSWER)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "doc_id long, n_bytes long, removed_from array<long>, removed_to array<long>, kept binary"
    return grouped.cogroup(strings.groupBy("block")).applyInArrow(releasing(lambda table, answers: _finish(table, answers, shards, digest), 2), kind)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), digest=True)
