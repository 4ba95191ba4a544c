"""The prefix trie of conversations, by prefix doubling.

Conversations are rebuilt first: conversation c starts with the first h turns of conversation c - c % 20 (all if it has fewer, none if it
doesn't exist) and goes on with its own turns after its first h; h is crc32 of the decimal c, mod 4.

Nodes are named without carrying texts along:

1. Each distinct turn (role, text) gets a dense number: the names of blocks of one turn.
2. Round k joins the names of two neighbouring blocks of 2**(k-1) turns, which start at a multiple of 2**k, and numbers the distinct
   pairs densely: names of blocks of 2**k turns. Each round has half the rows of the one before.
3. A prefix of d turns is cut into blocks by the binary digits of d, the largest first. Its last block is the one that ends at d, so there
   is one such block for each prefix; round r joins the prefixes of r digits with the names of those of r - 1 that they go on from, and
   numbers the distinct (name, block) densely. The numbers are the nodes.
4. Nodes are grouped. What a subtree adds up is summed along the conversation that names each node (its smallest member): from the end of
   that conversation towards the root, in two levels, and then by node.

Numbers are dense: each partition counts from where the ones before it end. No window holds a whole conversation or a whole node, and a
name that a large part of all rows has meets a broadcast table of at most common.HEAVY rows. The digest of a node's ends is a digest of
one string, so it is made in one task, which reads the string in pieces and keeps none of them.

Defined cases: turns without a conversation are left out; null roles and texts are empty; turns are ordered by turn, null first, then
by role and text (in bytes), so repeated rows are turns of their own that follow each other; % has the sign of its left side; a
conversation whose rebuilt form has no turn is a member of the root alone and ends there; an empty table has no node, not even a root; a
text of any length is hashed once; other columns of the table, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import join_heavy, load, materialize, named, shuffle_parts

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations with ids of one run of so many share their first turns.
FAMILY = 20
#: Depths in one bucket of the two-level sums.
BUCKET_BITS = 10
#: Bits of monotonically_increasing_id() that count inside a partition.
INSIDE = 33


def dense(df: DataFrame, out: str, name: str, start: int = 0, weight: str | None = None) -> tuple[DataFrame, int, int]:
    """df, stored, with the dense number `out` of each row from `start` on, in order of partitions and rows; the number after the last;
    and the sum of the column `weight`."""
    stored = materialize(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", INSIDE)
    # One row for each partition that wrote rows, so as many as there are tasks.
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight or F.lit(0)).alias("_w")).collect()
    offsets, at = {}, start
    for row in sorted(sizes):
        offsets[row._part] = at
        at += row._n
    table = df.sparkSession.createDataFrame(pa.table({"_part": pa.array(offsets.keys(), pa.int64()), "_offset": pa.array(offsets.values(), pa.int64())}))
    numbered = stored.withColumn("_part", part).join(F.broadcast(table), "_part")
    number = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << INSIDE) - 1))
    return numbered.withColumn(out, number).drop("_at", "_part", "_offset"), at, sum(row._w for row in sizes)


def named_by(rows: DataFrame, key: list[str], out: str, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """rows, which is stored, with a dense number `out` for each distinct key instead of the key; and the number after the last."""
    names, end, n = dense(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), out, f"{name}-names", start, "_n")
    return materialize(join_heavy(rows, names, key, n, "_n").drop(*key, "_n"), name), end


def _bucket(order: Column) -> Column:
    return F.shiftright(order, BUCKET_BITS)


def ordered_turns(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """_conv, _pos (from 0), _turn (digest of role and text) and _words of each turn, and _n, the number of turns of its conversation."""
    role, text = (F.coalesce(named(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = convs.where(named(conv_col).isNotNull()).select(named(conv_col).cast("long").alias("_conv"), named(turn_col).alias("_order"), role.alias("_role"), text.alias("_text"))
    order = [F.col("_conv"), F.col("_order").asc_nulls_first(), F.col("_role"), F.col("_text")]
    ranged = turns.repartitionByRange(shuffle_parts(convs.sparkSession), *order).sortWithinPartitions(*order)
    digest = F.unhex(F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256))
    placed, rows, _ = dense(ranged.select("_conv", digest.alias("_turn"), F.regexp_count("_text", F.lit(WORD)).cast("long").alias("_words")), "_place", "trie-turns")
    first = placed.groupBy("_conv").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return join_heavy(placed, materialize(first, "trie-first"), "_conv", rows, "_n").select("_conv", (F.col("_place") - F.col("_first")).alias("_pos"), "_turn", "_words", "_n")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (_conv, _pos, _turn, _words), and _conv with the number _n of rebuilt turns of each."""
    convs = turns.groupBy("_conv").agg(F.max("_n").alias("_own"))
    h = F.crc32(F.col("_conv").cast("string").cast("binary")) % 4
    convs = convs.select("_conv", "_own", h.alias("_h"), (F.col("_conv") - F.col("_conv") % FAMILY).alias("_base"))
    bases = convs.select(F.col("_conv").alias("_base"), F.col("_own").alias("_others"))
    taken = F.least("_h", F.coalesce("_others", F.lit(0)))
    convs = materialize(convs.join(bases, "_base", "left").select("_conv", "_own", "_h", "_base", taken.alias("_taken")), "trie-convs")
    rows = turns.count()
    own = join_heavy(turns.where("_pos >= 0"), convs.select("_conv", "_h", "_taken", "_own"), "_conv", rows, "_own")
    own = own.where("_pos >= _h").select("_conv", (F.col("_taken") + F.col("_pos") - F.col("_h")).alias("_pos"), "_turn", "_words")
    # At most three turns of a base meet at most 2 * FAMILY - 1 conversations.
    heads = turns.where("_pos < 3").select(F.col("_conv").alias("_base"), "_pos", "_turn", "_words")
    shared = convs.where("_taken > 0").join(heads, "_base").where("_pos < _taken").select("_conv", "_pos", "_turn", "_words")
    size = F.col("_taken") + F.greatest(F.lit(0), F.col("_own") - F.col("_h"))
    return own.unionByName(shared), convs.select("_conv", size.cast("long").alias("_n"))


def name_prefixes(turns: DataFrame) -> DataFrame:
    """_conv, _depth, _node for each non-empty prefix of each conversation; equal prefixes have one _node, 1 or more. turns: _conv, _pos,
    _turn, stored."""
    level, used = 0, []
    blocks, _ = named_by(turns.select("_conv", F.col("_pos").alias("_j"), "_turn"), ["_turn"], "_name", "trie-blocks-0")
    while True:
        ends = blocks.where(F.col("_j") % 2 == 0).select("_conv", F.shiftleft(F.col("_j") + 1, level).alias("_depth"), F.lit(level).alias("_level"), "_name")
        used.append(ends)
        left, right = (blocks.where(F.col("_j") % 2 == side).select("_conv", F.shiftright("_j", 1).alias("_j"), F.col("_name").alias(name)) for side, name in enumerate(("_left", "_right")))
        level += 1
        pairs = materialize(left.join(right, ["_conv", "_j"]), f"trie-pairs-{level}")
        if pairs.isEmpty():
            break
        blocks, _ = named_by(pairs, ["_left", "_right"], "_name", f"trie-blocks-{level}")
    prefixes = used[0]
    for more in used[1:]:
        prefixes = prefixes.unionByName(more)
    prefixes = prefixes.withColumn("_digits", F.bit_count("_depth"))
    done, start = [], 1
    for digits in range(1, level + 1):
        now = prefixes.where(F.col("_digits") == digits).withColumn("_rest", F.col("_depth") - F.expr("shiftleft(1L, _level)"))
        if digits == 1:
            now = now.withColumn("_from", F.lit(0).cast("long"))
        else:
            now = now.join(done[-1].select("_conv", F.col("_depth").alias("_rest"), F.col("_node").alias("_from")), ["_conv", "_rest"])
        now = materialize(now.select("_conv", "_depth", "_from", "_level", "_name"), f"trie-digits-{digits}")
        nodes, start = named_by(now, ["_from", "_level", "_name"], "_node", f"trie-prefixes-{digits}", start)
        done.append(nodes)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (_node, _conv) to (_node, _first, _piece): the ids of each run of one node, comma-joined."""
    for batch in batches:
        node, conv = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        if len(node):
            at = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(node[at[:-1]]), pa.array(conv[at[:-1]]), pa.array(text, pa.string())], names=["_node", "_first", "_piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (_node, _first, _piece) to (_node, ends_sha256)."""
    node, digest = None, None

    def out(nodes: list, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.string())], names=["_node", "ends_sha256"])

    for batch in batches:
        nodes, found = [], []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    nodes.append(node)
                    found.append(digest.hexdigest())
                node, digest = key, hashlib.sha256()
            digest.update(piece.encode())
        yield out(nodes, found)
    if node is not None:
        yield out([node], [digest.hexdigest()])


def end_digests(ends: DataFrame) -> DataFrame:
    """ends: _node, _conv. The SHA-256 of each node's conversations, in ascending order, comma-joined."""
    n = shuffle_parts(ends.sparkSession)
    ranged = ends.select("_node", "_conv").repartitionByRange(n, "_node", "_conv").sortWithinPartitions("_node", "_conv")
    pieces = ranged.mapInArrow(_pieces, "_node long, _first long, _piece string")
    return pieces.repartition(n, "_node").sortWithinPartitions("_node", "_first").mapInArrow(_digests, "_node long, ends_sha256 string")


def conversation_trie(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, sizes = rebuild(materialize(ordered_turns(convs, conv_col, turn_col, role_col, text_col), "trie-ordered"))
    turns, sizes = materialize(turns, "trie-rebuilt"), materialize(sizes, "trie-sizes")
    words = turns.select("_conv", (F.col("_pos") + 1).alias("_depth"), "_words")
    paths = name_prefixes(turns).join(words, ["_conv", "_depth"])
    roots = sizes.select("_conv", F.lit(0).cast("long").alias("_depth"), F.lit(0).cast("long").alias("_node"), F.lit(0).cast("long").alias("_words"))
    paths = materialize(paths.unionByName(roots), "trie-paths")
    rows = paths.count()

    nodes = paths.groupBy("_node").agg(F.min("_conv").alias("conv_id"), F.min("_depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("_words").alias("_words"))
    above = paths.select(F.col("_conv").alias("conv_id"), (F.col("_depth") + 1).alias("depth"), F.col("_node").alias("_parent"))
    nodes = materialize(nodes.join(above, ["conv_id", "depth"], "left"), "trie-nodes")
    children = nodes.where(F.col("_parent").isNotNull()).groupBy("_parent").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("_parent").alias("_node"), "n_children")
    nodes = materialize(nodes.join(children, "_node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    # Sums along the conversation that names each node, from its end on.
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    own = nodes.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), leaf.alias("_leaf"), ((F.col("n_convs") - 1) * F.col("_words")).alias("_saved"))
    owners = own.groupBy("_conv", _bucket(F.col("_depth")).alias("_bucket")).agg(F.sum("_leaf").alias("_l"), F.sum("_saved").alias("_s"))
    steps = paths.select("_conv", "_depth", "_node").join(own.select("_conv").distinct(), "_conv", "left_semi").join(own, ["_conv", "_depth"], "left").withColumn("_bucket", _bucket(F.col("_depth")))
    buckets = steps.select("_conv", "_bucket").distinct().join(owners, ["_conv", "_bucket"], "left")
    later = Window.partitionBy("_conv").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_conv", "_bucket", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("_l", "_s")])
    inside = Window.partitionBy("_conv", "_bucket").orderBy(F.desc("_depth")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.join(buckets, ["_conv", "_bucket"])
    below = [(F.col(rest) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(out) for rest, c, out in (("_l", "_leaf", "_leaves"), ("_s", "_saved", "_tokens"))]
    sums = steps.select("_node", *below).groupBy("_node").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_tokens").alias("saved_tokens"))

    parents = nodes.select(F.col("_node").alias("_parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    out = join_heavy(nodes, parents, "_parent", rows, "_n", "left").drop("_n").join(sums, "_node")
    last = paths.join(sizes.select("_conv", F.col("_n").alias("_depth")), ["_conv", "_depth"])
    out = out.join(end_digests(last), "_node", "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return conversation_trie(load(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH RECURSIVE turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS digits FROM turns GROUP BY conv_id
), sums AS (
    SELECT conv_id, digits, 0 AS place, 0 AS bit, CAST(4294967295 AS BIGINT) AS crc FROM convs
    UNION ALL
    SELECT conv_id, digits, CASE WHEN bit = 8 THEN place + 1 ELSE place END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
        CASE WHEN bit = 0 THEN xor(crc, CAST(ascii(substr(digits, place + 1, 1)) AS BIGINT))
             ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END
    FROM sums WHERE place < length(digits) AND bit <= 8
), heads AS (
    SELECT c.conv_id, c.own, c.base, xor(s.crc, 4294967295) % 4 AS h, coalesce(b.own, 0) AS others
    FROM convs c JOIN (SELECT conv_id, digits, crc FROM sums WHERE place = length(digits) AND bit = 0) s USING (conv_id)
    LEFT JOIN convs b ON b.conv_id = c.base
), rebuilt AS (
    SELECT h.conv_id, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos < h.h
    UNION ALL
    SELECT h.conv_id, least(h.h, h.others) + t.pos - h.h, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos >= h.h
), paths AS (
    SELECT conv_id, pos + 1 AS depth, text, list(role || chr(0) || text) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, '', [] FROM heads
), nodes AS (
    SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words
    FROM paths GROUP BY depth, prefix
), linked AS (
    SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n
    LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
    LEFT JOIN nodes u ON u.depth = p.depth AND u.prefix = p.prefix
), children AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
    SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c USING (conv_id, depth)
), below AS (
    SELECT p.depth, p.prefix, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
    FROM full_nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.prefix
), ends AS (
    SELECT depth, prefix, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest
    FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE depth = last GROUP BY depth, prefix
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
    CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM full_nodes n JOIN below b USING (depth, prefix) LEFT JOIN ends e USING (depth, prefix)
"""
