"""Near-duplicate vectors by spherical-cap filters.

Vectors are linked from a cosine of `least` on. Which pairs are compared is decided by filters: directions of a random product code, each
holding the vectors whose cosine with it exceeds `alpha`.

1. Equal vectors are one class from here on.
2. Filters. After a random rotation a vector is cut into blocks; each block has a small random code, and a filter is one code word for
   each block, so a few hundred words name millions of directions. A vector lists all filters that it exceeds by running through the
   blocks with their scores in falling order and cutting off what the best of the remaining blocks can't save. `alpha` and the number of
   filters follow the number of classes: a filter holds about `held` unrelated ones, and a pair at the bound shares `shared` filters on
   average (integrals over the sphere). Several codes are drawn on their own, so that no vector depends on one of them.
3. Balls. A class joins the ball of the smallest class among those of its best filters that is nearer than half the angle of `least`:
   members of a ball are all linked with each other (angles add up), so a group of near copies is a few balls, whatever its size.
4. Balls that share a filter of any member are compared, with vectors in 8 bits and a bound of their error; filters with many balls in
   square blocks. Of those that may be linked, exact angles between the balls' centres decide: all members linked (the angles and both
   radii together are small enough), none, or else the members are compared, in blocks.
5. Components of the balls' links. Links are counted by ball and class, never listed.

Every vector is in the index, and every link given is verified in double precision; a link that shares no filter is missed. Measured
against brute force: see the README.

Where many balls lie within one filter and none within another's ball (a cluster wider than half the angle) they are still compared with
each other in blocks, which is quadratic in their number.

Defined cases: null vectors, zero ones and those with null or non-finite components link with nothing, but have a row; vectors of
different lengths are never linked; lengths are scaled first, so very large and very small components do no harm; repeated rows are
linked like other equal vectors; null ids take part, and the smallest id that isn't null names the component (`kept` is false for a null
id); an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import join_heavy, load, materialize, named, release, shuffle_parts
from lodeframe.llm.components import components

LEAST = 0.95
HELD, SHARED, CODES = 8.0, 24.0, 4
#: Times as many codes are drawn for each block beyond two: the more blocks, the more a vector's filters depend on its best words.
CODES_A_BLOCK = 3
#: The number of classes that the filters are made for, at least.
FEWEST = 4096
#: Code words in one block, at most; a code of more filters has more blocks.
MOST_WORDS = 512
#: The filters of a class that offer it a ball.
OFFERS = 4
#: Balls of a filter, and members of a ball, in one block.
BLOCK = 1024
#: Vectors decoded, and pairs compared, at once.
BATCH, PAIRS = 512, 1 << 17
SLACK = 1e-9


# ---------------------------------------------------------------- filters


def _tail(grid: np.ndarray, dim: int) -> np.ndarray:
    """The share of the unit sphere in `dim` dimensions beyond each height of the grid (rising, from -1 to 1)."""
    density = np.maximum(1 - grid**2, 0) ** ((dim - 3) / 2)
    steps = (density[1:] + density[:-1]) / 2 * np.diff(grid)
    upto = np.concatenate([[0], np.cumsum(steps)])
    return 1 - upto / upto[-1]


class Caps:
    """Filters for vectors of `dim` components, of which there are `n`."""

    def __init__(self, dim: int, n: int, least: float, held: float, shared: float, codes: int, seed: int = 7):
        n = max(n, FEWEST)
        size = max(dim, 8)
        grid = np.linspace(-1, 1, 200_001)
        above = _tail(grid, size)
        self.alpha = float(grid[np.searchsorted(-above, -min(0.5, held / n))])
        # The second vector of a pair at the bound stands at least * x + sqrt(1 - least^2) * sqrt(1 - x^2) * y.
        x = np.linspace(self.alpha, 1, 4002)[:-1]
        y = (self.alpha - least * x) / np.sqrt((1 - least**2) * (1 - x**2))
        weight = (1 - x**2) ** ((size - 3) / 2)
        both = float((weight * np.interp(y, grid, _tail(grid, size - 1))).sum() / weight.sum()) * min(0.5, held / n)
        self.blocks = 2
        while (shared / both / codes) ** (1 / self.blocks) > MOST_WORDS:
            self.blocks += 1
            codes *= CODES_A_BLOCK
        self.words = max(2, round((shared / both / codes) ** (1 / self.blocks)))
        self.size = -(-size // self.blocks) * self.blocks
        rng = np.random.default_rng([seed, dim])
        self.codes = []
        for _ in range(codes):
            turn, upper = np.linalg.qr(rng.standard_normal((self.size, self.size)))
            words = rng.standard_normal((self.blocks, self.words, self.size // self.blocks))
            words /= np.linalg.norm(words, axis=2, keepdims=True)
            self.codes.append(((turn * np.sign(np.diag(upper)))[:dim], words / np.sqrt(self.blocks)))

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, filter, score) of every filter that a vector exceeds, in order of vectors."""
        out = []
        for k, (turn, words) in enumerate(self.codes):
            turned = (vectors @ turn).reshape(len(vectors), self.blocks, -1)
            scores = np.einsum("nbd,bwd->bnw", turned, words)
            best = scores.max(axis=2)
            rest = np.cumsum(best[::-1], axis=0)[::-1]
            rows, name, total = np.arange(len(vectors)), np.full(len(vectors), k, np.int64), np.zeros(len(vectors))
            for b in range(self.blocks):
                order = np.argsort(-scores[b], axis=1)
                falling = np.take_along_axis(scores[b], order, axis=1)
                saved = rest[b + 1][rows] if b + 1 < self.blocks else 0.0
                # Scores are between -1 and 1, so rows don't overlap once 4 is added for each.
                keys = (4.0 * np.arange(len(vectors))[:, None] - falling).ravel()
                count = np.searchsorted(keys, 4.0 * rows - (self.alpha - total - saved), "right") - rows * self.words
                count = np.clip(count, 0, self.words)
                before = np.cumsum(count) - count
                place = np.arange(count.sum()) - np.repeat(before, count)
                rows, name, total = (np.repeat(x, count) for x in (rows, name, total))
                total = total + falling[rows, place]
                name = name * self.words + order[rows, place]
            out.append((rows, name * len(self.codes) + k, total))
        rows, name, total = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((-total, rows))
        return rows[order], name[order], total[order]


@lru_cache(maxsize=8)
def caps(*args) -> Caps:
    return Caps(*args)


# ---------------------------------------------------------------- vectors as bytes


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    data = pa.py_buffer(np.ascontiguousarray(rows))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), data])


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length."""
    if not len(column):
        return np.zeros((0, 1), kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row, _id, _vector to _row, _id, _unit: the direction in double precision, null if there is none."""
    for batch in batches:
        column = batch.column("_vector")
        flat = column.flatten()
        numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        numbers[~np.isfinite(numbers)] = np.nan
        lengths = np.diff(np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        units: list[bytes | None] = [None] * batch.num_rows
        for size in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == size)
            own = numbers[at[rows][:, None] + np.arange(size)]
            top = np.abs(own).max(axis=1)
            good = (top > 0) & ~np.isnan(top)
            rows, own = rows[good], own[good] / top[good][:, None]
            own /= np.linalg.norm(own, axis=1)[:, None]
            for r, unit in zip(rows.tolist(), own, strict=True):
                units[r] = unit.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(units, pa.binary())], names=["_row", "_id", "_unit"])


def _decoder(n: int, least: float, held: float, shared: float, codes: int):
    """_class, _dim, _unit to _class, _filters (of all codes; the best first), with the vectors in 8 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, names, units = batch.column("_dim").to_numpy(), batch.column("_class").to_numpy(), batch.column("_unit")
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                family = caps(dim, n, least, held, shared, codes)
                for i in range(0, len(rows), BATCH):
                    own = rows[i : i + BATCH]
                    row, name, _ = family.decode(_matrix(units.take(pa.array(own))))
                    # The length of the vectors is part of a filter's name.
                    name = name * 65_536 + dim % 65_536
                    at = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.ListArray.from_arrays(at, pa.array(name))], names=["_class", "_filters"])
        release()

    return run


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds _code, the unit vector in 8 bits, its _step, and _error, the length of what rounding took away, to _unit's other columns."""
    for batch in batches:
        units = batch.column("_unit")
        sizes = pc.binary_length(units).to_numpy()
        codes: list = [None] * batch.num_rows
        step, error = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            own = _matrix(units.take(pa.array(rows)))
            step[rows] = np.abs(own).max(axis=1) / 127
            near = np.rint(own / step[rows][:, None])
            error[rows] = np.linalg.norm(own - near * step[rows][:, None], axis=1)
            for r, code in zip(rows.tolist(), near.astype(np.int8), strict=True):
                codes[r] = code.tobytes()
        kept = [n for n in batch.schema.names if n != "_unit"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(codes, pa.binary()), pa.array(step), pa.array(error)], names=[*kept, "_code", "_step", "_error"])


# ---------------------------------------------------------------- candidates inside filters


def _near(vectors: np.ndarray, errors: np.ndarray, radii: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, least: float) -> np.ndarray:
    """Whether members of balls i and j can have a cosine of `least`: their centres' angle, less errors and radii, is small enough."""
    cosine = cosine + errors[i] + errors[j] + errors[i] * errors[j]
    return np.arccos(np.clip(cosine, -1, 1)) <= np.arccos(least) + radii[i] + radii[j] + SLACK


def _comparer(least: float):
    """Rows in order of _key (a filter and a block of pairs): _ball, _side (0: both sides), _code, _step, _error, _radius. Gives pairs of
    balls that may be linked, the smaller first, a pair once in a batch at most."""

    def pairs_of(key: np.ndarray, table: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ball, side, vectors, errors, radii = (table[n] for n in ("ball", "side", "vectors", "errors", "radii"))
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        sizes = np.diff(cuts)
        large = sizes > 96
        for a, b in zip(cuts[:-1][large].tolist(), cuts[1:][large].tolist(), strict=True):
            left, right = a + np.flatnonzero(side[a:b] <= 1), a + np.flatnonzero(side[a:b] != 1)
            both = vectors[left] @ vectors[right].T
            i, j = np.nonzero(both >= np.cos(min(np.pi, np.arccos(least) + 2 * radii[a:b].max() + SLACK)) - 2 * errors[a:b].max() - errors[a:b].max() ** 2)
            i, j, cosine = left[i], right[j], both[i, j]
            good = (ball[i] != ball[j]) & ((side[i] != 0) | (i < j)) & _near(vectors, errors, radii, i, j, cosine, least)
            yield ball[i[good]], ball[j[good]]
        # Small groups: each row with those after it in its group, whole groups at once.
        after = np.zeros(len(key), np.int64)
        small = np.repeat(~large, sizes)
        after[small] = (np.repeat(cuts[1:], sizes) - 1 - np.arange(len(key)))[small]
        upto = np.cumsum(after)
        row = 0
        while row < len(key):
            last = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + PAIRS, "right")))
            n = after[row:last]
            i = np.repeat(np.arange(row, last), n)
            j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            good = ((side[i] == 0) | (side[i] != side[j])) & (ball[i] != ball[j])
            i, j = i[good], j[good]
            good = _near(vectors, errors, radii, i, j, np.einsum("nd,nd->n", vectors[i], vectors[j]), least)
            yield ball[i[good]], ball[j[good]]
            row = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            columns = {n: (table.column(n).chunk(0) if table.num_rows else None) for n in table.column_names}
            sizes = pc.binary_length(columns["_code"]).to_numpy()
            found = []
            for size in np.unique(sizes).tolist():
                rows = pa.array(np.flatnonzero(sizes == size))
                own = {n: c.take(rows) for n, c in columns.items()}
                vectors = _matrix(own["_code"], np.int8).astype(np.float32) * own["_step"].to_numpy()[:, None].astype(np.float32)
                # Single precision adds at most this to an error.
                errors = own["_error"].to_numpy() + 1e-5
                at = {"ball": own["_ball"].to_numpy(), "side": own["_side"].to_numpy(), "vectors": vectors, "errors": errors, "radii": own["_radius"].to_numpy()}
                for a, b in pairs_of(own["_key"].to_numpy(), at):
                    if len(a):
                        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = table.column("_key").to_numpy()
            if table.num_rows < 4 * BLOCK or keys[0] == keys[-1]:
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from out(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))
        release()

    return run


def _members_comparer(least: float):
    """Blocks of members of two balls: cosines of all of them, added up by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (classes, weights, units), (others, their, vectors) = ([batch.column(f"{n}{side}")[row].values for n in ("_classes", "_weights", "_units")] for side in (0, 1))
                linked = _matrix(units) @ _matrix(vectors).T >= least
                names = np.concatenate([classes.to_numpy(), others.to_numpy()])
                found = np.concatenate([linked @ their.to_numpy(), linked.T @ weights.to_numpy()])
                there = found > 0
                a, b = (pa.array(np.full(int(there.sum()), batch.column(n)[row].as_py(), np.int64)) for n in ("a", "b"))
                if there.any():
                    yield pa.RecordBatch.from_arrays([a, b, pa.array(names[there]), pa.array(found[there])], names=["a", "b", "_class", "_n"])
        release()

    return run


# ---------------------------------------------------------------- the operator


def _balls(classes: DataFrame, filters: DataFrame, n: int, least: float) -> DataFrame:
    """_class, _ball and _angle (to the ball's centre) of each class, stored."""
    offers = filters.select("_class", F.explode(F.slice("_filters", 1, OFFERS)).alias("_filter"))
    centres = offers.groupBy("_filter").agg(F.min("_class").alias("_ball"), F.count(F.lit(1)).alias("_n"))
    offers = join_heavy(offers, materialize(centres, "caps-centres"), "_filter", n * OFFERS, "_n").select("_class", "_ball").where("_class <> _ball").distinct()
    offers = materialize(offers, "caps-offers")
    units = classes.select(F.col("_class").alias("_ball"), F.col("_unit").alias("_centre"))
    sizes = offers.groupBy("_ball").agg(F.count(F.lit(1)).alias("_n"))
    placed = join_heavy(offers, materialize(units.join(sizes, "_ball"), "caps-balls"), "_ball", n * OFFERS, "_n").drop("_n")
    placed = placed.join(classes.select("_class", "_unit"), "_class").where(F.length("_unit") == F.length("_centre"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.array([np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64) for a, b in zip(batch.column("_unit").to_pylist(), batch.column("_centre").to_pylist(), strict=True)])
            angle = np.arccos(np.clip(cosine, -1, 1))
            near = pa.array(angle <= np.arccos(least) / 2 - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column("_class").filter(near), batch.column("_ball").filter(near), pa.array(angle).filter(near)], names=["_class", "_ball", "_angle"])

    near = placed.select("_class", "_ball", "_unit", "_centre").mapInArrow(angles, "_class long, _ball long, _angle double")
    taken = near.where("_ball < _class").groupBy("_class").agg(F.min(F.struct("_ball", "_angle")).alias("_best"))
    alone = F.coalesce("_best._ball", "_class"), F.coalesce("_best._angle", F.lit(0.0))
    joined = classes.select("_class", "_weight").join(taken, "_class", "left")
    return materialize(joined.select("_class", "_weight", alone[0].alias("_ball"), alone[1].alias("_angle")), "caps-members")


def find_links(classes: DataFrame, n: int, least: float, held: float, shared: float, codes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """classes: _class (dense or not), _dim, _unit, _weight, stored; n of them. Returns the members (_class, _ball, _weight), the links of
    balls (a, b), and _class with _extra, the links of each class beyond its ball, for those that have any."""
    spark = classes.sparkSession
    filters = materialize(classes.select("_class", "_dim", "_unit").mapInArrow(_decoder(n, least, held, shared, codes), "_class long, _filters array<long>"), "caps-filters")
    members = _balls(classes, filters, n, least)
    balls = members.groupBy("_ball").agg(F.sum("_weight").alias("_weight"), F.max("_angle").alias("_radius"), F.count(F.lit(1)).alias("_n"))
    balls = balls.join(classes.select(F.col("_class").alias("_ball"), "_unit"), "_ball")
    balls = materialize(balls, "caps-balls")
    codes_ = materialize(balls.select("_ball", "_radius", "_unit").mapInArrow(_rounded, "_ball long, _radius double, _code binary, _step double, _error double"), "caps-codes")

    # Balls that share a filter, in blocks.
    inside = filters.select("_class", F.explode("_filters").alias("_filter")).join(members.select("_class", "_ball"), "_class").select("_filter", "_ball").distinct()
    inside = materialize(inside, "caps-inside")
    sizes = inside.groupBy("_filter").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    inside = join_heavy(inside, materialize(sizes, "caps-sizes"), "_filter", inside.count(), "_n")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_ball"), blocks).cast("int")
    square = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), F.when(own == k, 0).when(own < k, 1).otherwise(2).alias("side")))
    inside = inside.select("_ball", "_filter", F.explode(square).alias("_at"))
    keyed = inside.select("_ball", F.xxhash64("_filter", "_at.i", "_at.j").alias("_key"), F.col("_at.side").alias("_side")).join(codes_, "_ball")
    ordered = keyed.repartition(shuffle_parts(spark) * 2, "_key").sortWithinPartitions("_key", "_ball")
    pairs = materialize(ordered.mapInArrow(_comparer(least), "a long, b long").distinct(), "caps-pairs")

    # Exact angles between centres decide for all members, or not.
    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.arccos(least)
        for batch in batches:
            cosine = np.array([np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64) for x, y in zip(batch.column("_unit0").to_pylist(), batch.column("_unit1").to_pylist(), strict=True)], np.float64)
            radii = batch.column("_radius0").to_numpy() + batch.column("_radius1").to_numpy()
            angle = np.arccos(np.clip(cosine, -1, 1))
            single = radii == 0
            every = np.where(single, cosine >= least, angle + radii <= limit - SLACK)
            some = ~every & ~single & (angle - radii <= limit + SLACK)
            kind = pa.array(np.where(every, 2, np.where(some, 1, 0)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), kind], names=["a", "b", "_kind"])

    sides = [balls.select(F.col("_ball").alias(n), F.col("_unit").alias(f"_unit{k}"), F.col("_radius").alias(f"_radius{k}")) for k, n in enumerate("ab")]
    kinds = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "_unit0", "_unit1", "_radius0", "_radius1").mapInArrow(decided, "a long, b long, _kind int")
    kinds = materialize(kinds.where("_kind > 0"), "caps-decided")

    # Members of balls that are linked in part.
    some = kinds.where("_kind = 1")
    counted = balls.select("_ball", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    part = members.join(counted, "_ball").withColumn("_block", F.pmod(F.xxhash64("_class"), F.col("_blocks")).cast("int")).join(classes.select("_class", "_unit"), "_class")
    part = part.join(some.select(F.col("a").alias("_ball")).union(some.select("b")).distinct(), "_ball", "left_semi")
    part = part.groupBy("_ball", "_block").agg(F.sort_array(F.collect_list(F.struct("_class", "_weight", "_unit"))).alias("_m"))
    part = materialize(part.select("_ball", "_block", F.col("_m._class").alias("_classes"), F.col("_m._weight").alias("_weights"), F.col("_m._unit").alias("_units")), "caps-parts")
    sides = [part.select(F.col("_ball").alias(n), *[F.col(c).alias(f"{c}{k}") for c in ("_classes", "_weights", "_units")]) for k, n in enumerate("ab")]
    mixed = some.join(sides[0], "a").join(sides[1], "b").select("a", "b", *[f"{c}{k}" for k in range(2) for c in ("_classes", "_weights", "_units")])
    mixed = materialize(mixed.mapInArrow(_members_comparer(least), "a long, b long, _class long, _n long"), "caps-mixed")

    whole = kinds.where("_kind = 2").select("a", "b")
    links = whole.union(mixed.select("a", "b").distinct())
    weights = balls.select(F.col("_ball").alias("b"), "_weight")
    toward = whole.union(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_ball = toward.join(weights, "b").groupBy(F.col("a").alias("_ball")).agg(F.sum("_weight").alias("_n"))
    by_ball = by_ball.join(members.select("_ball", "_class"), "_ball").select("_class", "_n")
    extra = by_ball.union(mixed.select("_class", "_n")).groupBy("_class").agg(F.sum("_n").alias("_extra"))
    return members, links, extra


def near_vectors(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", held: float = HELD, shared: float = SHARED, codes: int = CODES) -> DataFrame:
    """One row for each vector: its id, n_links, component_id and kept."""
    if not 0 < least < 1:
        raise ValueError("least has to be between 0 and 1")
    given = vectors.select(F.monotonically_increasing_id().alias("_row"), named(id_col).alias("_id"), named(vector_col).cast("array<double>").alias("_vector"))
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = given.mapInArrow(_units, f"_row long, _id {kind}, _unit binary").withColumn("_digest", F.sha2("_unit", 256))
    rows = materialize(rows, "caps-rows")
    classes = rows.where(F.col("_unit").isNotNull()).groupBy("_digest").agg(F.min("_row").alias("_class"), F.count(F.lit(1)).alias("_weight"), F.min("_id").alias("_least"))
    units = rows.select(F.col("_row").alias("_class"), "_unit", (F.length("_unit") / 8).cast("int").alias("_dim"))
    classes = materialize(classes.join(units, "_class"), "caps-classes")
    n, total = classes.count(), rows.count()
    members, links, extra = find_links(classes, n, least, held, shared, codes)
    labels = components(links, "caps-components")
    placed = members.join(labels.select(F.col("node").alias("_ball"), "label"), "_ball", "left").withColumn("_label", F.coalesce("label", "_ball"))
    sizes = members.groupBy("_ball").agg(F.sum("_weight").alias("_in"))
    placed = placed.join(sizes, "_ball").join(extra, "_class", "left").join(classes.select("_class", "_digest", "_least"), "_class")
    placed = materialize(placed.select("_digest", "_weight", "_least", "_label", (F.col("_in") - 1 + F.coalesce("_extra", F.lit(0))).alias("n_links")), "caps-placed")
    leaders = placed.groupBy("_label").agg(F.min("_least").alias("component_id"))
    placed = placed.join(leaders, "_label").select("_digest", "_weight", "n_links", "component_id")
    own = rows.select("_id", "_digest")
    found = join_heavy(own.where(F.col("_digest").isNotNull()), materialize(placed, "caps-found"), "_digest", total, "_weight").drop("_weight")
    alone = own.where(F.col("_digest").isNull()).select("_digest", "_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whatever their labels."""
    return near_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP11_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
      AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), units AS (
    SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM good
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) >= 0.95
), reach AS (
    SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.least, e.vec_id) AS component_id, e.vec_id = coalesce(c.least, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) n USING (vec_id)
LEFT JOIN (SELECT vec_id, min(other) AS least FROM reach GROUP BY vec_id) c USING (vec_id)
"""
