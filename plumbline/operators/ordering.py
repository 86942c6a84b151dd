"""Distributed order statistics: running totals, ranks and exact quantiles.

A window without PARTITION BY, or ``percentile`` over a group that holds a large
share of the data, runs in one task.  The functions here never do that, whatever the size of the input:
rows are counted in buckets that keep their order, the bucket counts become offsets, and only rows that share a bucket are
ordered together.  The results are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

# task code travels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rounds of a keyed permutation, and how often a position that fell outside is sent on: a third does at most
ROUNDS, WALK = 3, 40
#: bits of a value's 64 that the first count leaves out: 2^10 buckets per power of two
LEADING = 42
#: cells into which a bucket with too many values is cut
CELLS = 1 << 16
#: distinct values that are ordered together, at most
LEAF = 1 << 16
#: bits below sign and exponent that one count of ``quantiles_of_sets`` tells apart, and rows near the wanted ranks up to which it takes all that are left
STEP, NEAR = 10, 1 << 16
#: leading hex digits of md5 that make a bucket: at most 65 536 of them
HASH_DIGITS = 4


def running_total(df: DataFrame, order: Sequence[str], value: Column, by: Sequence[str] = (),
                  before: str = "before", total: str | None = None) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the group (0 for the first).

    ``order`` must be unique within ``by``.  ``total`` optionally names a column
    for the group's overall sum.  Rows are range-partitioned and written once; the sums of the
    partitions become offsets, and each partition is ordered on its own.
    """
    by, order = list(by), list(order)
    zero = F.lit(0).cast("bigint")
    ranged = cut_lineage(
        df.withColumn("_v", value).repartitionByRange(*by, *order).withColumn("_bucket", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_bucket").agg(F.sum("_v").alias("_sum"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # at most one row per range partition and group
    offsets = sums.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                   zero).alias("_offset"),
        F.sum("_sum").over(group).alias("_total"),
    )
    match = ranged["_bucket"] == offsets["_b"]
    for i, c in enumerate(by):
        match = match & ranged[c].eqNullSafe(offsets[f"_k{i}"])
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, match).withColumn(
        before, F.col("_offset") + F.coalesce(F.sum("_v").over(inside), zero))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, before, *([total] if total else []))


def row_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "index") -> DataFrame:
    """0-based position of each row in ``order`` (ascending, unique) within ``by``."""
    return running_total(df, order, F.lit(1).cast("bigint"), by, before=name)


def hash_text(seed: object, *parts: str) -> Column:
    """Lower-case hex md5 of ``seed|part|part…``; every random choice is made with it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def hash_index(df: DataFrame, keys: Sequence[str], seed: object, by: Sequence[str] = (),
               name: str = "index", digits: int = HASH_DIGITS) -> DataFrame:
    """0-based position in md5 order.

    The hash is uniform, so its leading hex digits are balanced buckets known in
    advance: bucket counts give the offsets and only rows sharing a bucket are
    sorted together.  No sampling, no checkpoint, no group-sized task.
    """
    by, keys = list(by), list(keys)
    hashed = df.withColumn("_h", hash_text(seed, *keys)).withColumn("_b", F.substring("_h", 1, digits))
    sums = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = sums.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0))).drop("_n")
    if not by:  # at most 16**digits rows of a few bytes
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
    hashed, offsets = hashed.alias("l"), offsets.alias("r")
    cond = F.col("l._b") == F.col("r._b")
    for c in by:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = hashed.join(offsets, cond).select("l.*", "r._offset")
    ranked = joined.withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
    return ranked.select(*df.columns, F.col(name).cast("bigint").alias(name))


def permutation_tables(seed: object, repeat: int, rows: int, width: int) -> list[np.ndarray]:
    """For each turn of a keyed permutation how far every value of the digit that stays moves the other one."""
    return [np.array([int(md5(f"{seed}|{repeat}|{half}|{k}|{digit}".encode()).hexdigest()[:8], 16) % size for digit in range(other)], np.int64)
            for k, (half, size, other) in enumerate([("l", rows, width), ("r", width, rows)] * ROUNDS)]


def permuted(position: Column, n: int, seed: object, repeat: Column) -> Column:
    """Where a keyed permutation of 0 .. n - 1 sends ``position``; another one for every ``repeat``.

    Positions are written as two digits, and each digit in turn is moved by a hash of the other; what leaves the range goes on until it is back.  Every row finds its place
    by itself: no shuffle, no table of the permutation.  A digit has about sqrt(n) values, so a task hashes each of them once and looks the rest up.
    """
    rows = 1
    while rows * rows < n:
        rows += 1
    width = max(1, -(-n // rows))
    tables: dict[int, list[np.ndarray]] = {}

    def once(x: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
        left, right = x // width, x % width
        for k, move in enumerate(moves):
            if k % 2 == 0:
                left = (left + move[right]) % rows
            else:
                right = (right + move[left]) % width
        return left * width + right

    def place(x: pa.Array, r: pa.Array) -> pa.Array:
        at, which = x.to_numpy(zero_copy_only=False).astype(np.int64), r.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.empty(len(at), np.int64)
        for own in np.unique(which).tolist():
            if own not in tables:
                tables[own] = permutation_tables(seed, own, rows, width)
            mine = np.flatnonzero(which == own)
            moved = once(at[mine], tables[own])
            for _ in range(WALK):
                outside = np.flatnonzero(moved >= n)
                if not len(outside):
                    break
                moved[outside] = once(moved[outside], tables[own])
            out[mine] = moved
        return pa.array(out)
    place.__annotations__ = {"x": pa.Array, "r": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "long")(position.cast("bigint"), repeat.cast("bigint"))


def sort_key(v: Column) -> Column:
    """A double as the 64-bit integer that orders it: the bits of its size, negated below zero; both zeros give 0."""
    size = F.abs(v)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("double")
    two = F.lit(2.0)
    # the logarithm may round across a power of two
    power = F.when(F.pow(two, guess) > size, F.greatest(guess - 1, F.lit(-1022.0))).when(F.pow(two, guess + 1) <= size, guess + 1).otherwise(guess)
    # below 2^-1022 the fraction is less than 1, which is how such numbers are stored
    bits = (size / F.pow(two, power) * float(1 << 52)).cast("bigint") + (power.cast("bigint") + 1022) * F.lit(1 << 52)
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, bits).when(v < 0, -bits)


def _wanted_ranks(n: Column, probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """Lower rank, upper rank and the part between them, for each probability among ``n`` values."""
    positions = [(n - 1) * F.lit(p) for p in probs]
    return [(F.floor(x), F.ceil(x), x - F.floor(x)) for x in positions]


def _holders(placed: DataFrame, probs: Sequence[float]) -> Column:
    """Whether the rows from rank ``_start`` on, ``_c`` of them, hold a wanted rank."""
    sides = [side for low, high, _ in _wanted_ranks(F.col("_n"), probs) for side in (low, high)]
    return reduce(lambda a, b: a | b, [(F.col("_start") <= r) & (r < F.col("_start") + F.col("_c")) for r in sides])


def _refine(values: DataFrame, groups: list[str], probs: Sequence[float]) -> DataFrame:
    """Cut each bucket of ``values`` into ``CELLS`` cells of equal width between its ends and keep the cells that hold a wanted rank.

    ``values`` (groups, ``_b``, ``_start``, ``_n``, ``_k``, ``v``, ``_c``) has one row per distinct value; a cell becomes the bucket of the next step.
    """
    bucket = [*groups, "_b"]
    ends = values.groupBy(*bucket).agg(F.min("_k").alias("_low"), F.max("_k").alias("_high"))
    # both ends lie in one bucket, so their difference does not overflow
    width = F.floor((F.col("_high") - F.col("_low")) / CELLS) + 1
    celled = _same(values.alias("l"), ends.select(*bucket, "_low", width.alias("_width")).alias("r"), bucket, "inner").select(
        "l.*", F.expr("(l._k - r._low) div r._width").alias("_cell"))
    counts = celled.groupBy(*bucket, "_start", "_n", "_cell").agg(F.sum("_c").alias("_c"), F.min("_k").alias("_first"))
    earlier = Window.partitionBy(*bucket).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    kept = placed.where(_holders(placed, probs)).select(*bucket, "_cell", "_start", "_first")
    # a cell is known by its first value, which no other cell of the group has
    return _same(celled.alias("l"), kept.alias("r"), [*bucket, "_cell"], "inner").select(
        *[F.col(f"l.{g}").alias(g) for g in groups], F.col("r._first").alias("_b"), F.col("r._start").alias("_start"), "l._n", "l._k", "l.v", "l._c")


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                   weight: str | None = None, leave_out: str | None = None, sets: tuple[Sequence[str], Callable[[Sequence[Column]], Column]] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per group and column.

    Result: ``by…, column, n, q`` with ``q`` an array in the order of ``probs``.
    Nulls and NaN are skipped; a group without values has n = 0.  ``weight`` is an integer multiplicity column.

    With ``leave_out``, a column of few values without nulls, there is one row per value (and group): the quantiles of all rows but those of that value.  The rows are counted once per value;
    what is left without one is added up from the counts.

    ``sets`` does the same for any parts, which may overlap: columns of few values, and what makes of them an array of (``_set``, ``_in``), the parts and whether rows with these values are in each.
    There is one row per ``_set`` (and group); rows are counted once per combination of the columns.

    Radix search over the values as 64-bit integers: one pass counts them by their leading bits, with map-side sums; a second one counts the
    distinct values of the buckets that hold a wanted rank.  While a bucket has more than ``LEAF`` of them it is cut again, so no task orders more than that, however
    close together the values lie.
    """
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    freq = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    value = F.col("v") + F.lit(0.0)  # one zero
    packed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    if leave_out:
        every = sorted(r[0] for r in df.select(leave_out).distinct().collect())
        sets = [leave_out], lambda own: F.array(*[F.struct(F.lit(x).alias("_set"), (own[0] != F.lit(x)).alias("_in")) for x in every])
    of = [f"_of{i}" for i in range(len(sets[0]))] if sets else []
    own = [F.col(c).alias(o) for c, o in zip(sets[0], of)] if sets else []
    dealt = F.inline(sets[1]([F.col(o) for o in of])) if sets else None
    long = df.select(*by, *own, freq.alias("_w"), F.inline(packed)).withColumn("v", F.when(~F.isnan("v"), value)).withColumn("_k", sort_key(F.col("v")))
    long = long.withColumn("_b", F.shiftright("_k", LEADING))
    groups = [*by, "column"]
    counts = long.groupBy(*groups, *of, "_b").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("_w"))), F.lit(0)).alias("_c"))
    known, name = long.where(F.col("v").isNotNull()), leave_out or "_set"
    if sets:
        counts = counts.select(*groups, "_b", "_c", dealt).groupBy(*groups, F.col("_set").alias(name), "_b").agg(F.sum(F.when(F.col("_in"), F.col("_c")).otherwise(0)).alias("_c"))
        by, groups = [*by, name], [*by, name, "column"]
    group = Window.partitionBy(*groups)
    placed = counts.withColumn("_n", F.sum("_c").over(group)).withColumn(
        "_start", F.sum("_c").over(group.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    wanted = placed.where(_holders(placed, probs) | (F.col("_n") == 0)).select(*groups, "_b", "_start", "_n")
    if by:
        wanted = cut_lineage(wanted)  # its size is then known to the planner
    else:
        wanted = F.broadcast(wanted)  # two buckets per column and probability at most
    if sets:
        # rows of a wanted bucket are added up before they are dealt to the sets
        shared = [g for g in groups if g != name] + ["_b"]
        near = _same(known.alias("l"), wanted.select(*shared).distinct().alias("r"), shared, "left_semi").groupBy(*shared, *of, "_k", "v").agg(F.sum("_w").alias("_w"))
        known = near.select(*shared, "_k", "v", "_w", dealt).where("_in").withColumnRenamed("_set", name)
    inside = _same(known.alias("l"), wanted.alias("r"), [*groups, "_b"], "inner").select("l.*", "r._start", "r._n")
    values = cut_lineage(inside.groupBy(*groups, "_b", "_start", "_n", "_k", "v").agg(F.sum("_w").alias("_c")).where("_c > 0"))
    while (values.groupBy(*groups, "_b").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0) > LEAF:
        values = cut_lineage(_refine(values, groups, probs))
    earlier = Window.partitionBy(*groups, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ordered = values.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    picks = []
    for i, (low, high, _) in enumerate(_wanted_ranks(F.col("_n"), probs)):
        for side, rank in (("lo", low), ("hi", high)):
            hit = (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_c"))
            picks.append(F.max(F.when(hit, F.col("v"))).alias(f"_{side}{i}"))
    wide = ordered.groupBy(*groups).agg(F.max("_n").alias("n"), *picks)
    quantiles = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part for i, (_, _, part) in enumerate(_wanted_ranks(F.col("n"), probs))]
    found = wide.select(*groups, "n", F.array(*quantiles).alias("q"))
    if by:
        return found.unionByName(wanted.where("_n = 0").select(*groups, F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("array<double>").alias("q")))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    return every.join(found, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"), "q")


class _Count:
    """Counts values by their bits down to ``shift``, for every pair of a set and a column, of those (``wanted``) that begin with given bits above ``above``."""

    def __init__(self, members: Mapping[int, Sequence[int]], columns: int, wanted: Sequence[tuple[int, int]], above: int, shift: int):
        self.cells = np.array(sorted(members), np.int64)
        most = max(map(len, members.values()), default=0)
        self.sets = np.array([[*members[c], *[-1] * (most - len(members[c]))] for c in self.cells.tolist()], np.int64).reshape(len(self.cells), most)
        self.columns, self.above, self.shift, self.whole = columns, above, shift, not wanted
        self.pairs = (int(self.sets.max()) + 1 if self.sets.size else 0) * columns
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.pairs)]
        for j, (pair, begin) in enumerate(wanted):
            own[pair].append((j, begin))
        self.width = max(map(len, own), default=0)
        self.of = np.array([[*(j for j, _ in x), *[-1] * (self.width - len(x))] for x in own], np.int64).reshape(self.pairs, self.width)
        self.begin = np.array([[*(b for _, b in x), *[0] * (self.width - len(x))] for x in own], np.int64).reshape(self.pairs, self.width)
        self.begins = np.array([b for _, b in wanted], np.int64)

    def _hits(self, cell: np.ndarray, values: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(what is counted, bits) of all values that count."""
        sets = self.sets[np.searchsorted(self.cells, cell)]
        for c, v in enumerate(values):
            some = np.flatnonzero(~np.isnan(v))
            bits = np.abs(v[some]).view(np.int64)
            key = np.where(v[some] < 0, -bits, bits)
            for s in sets[some].T:
                here = np.flatnonzero(s >= 0)
                pair, k = s[here] * self.columns + c, key[here]
                if self.whole:
                    yield pair, k >> self.shift
                for w in range(self.width):
                    j = self.of[pair, w]
                    hit = np.flatnonzero((j >= 0) & (k >> self.above == self.begin[pair, w]))
                    yield j[hit], k[hit] >> self.shift

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = -(1 << (63 - self.shift)) if self.whole else self.begins << (self.above - self.shift)
        dense = self.whole or self.above - self.shift <= STEP
        size = 1 << (64 if self.whole else self.above) - self.shift if dense else 0
        counts = np.zeros((self.pairs if self.whole else len(self.begins)) * size if dense else 0, np.int64)
        for batch in batches:
            cell, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for j, bits in self._hits(cell, values):
                if dense:
                    np.add.at(counts, j * size + bits - (first if self.whole else first[j]), 1)
                elif len(j):
                    found, n = np.unique(np.stack([j, bits]), axis=1, return_counts=True)
                    yield self._batch(found[0], found[1], n)
        if dense:
            at = np.flatnonzero(counts)
            j = at // size
            yield self._batch(j, at % size + (first if self.whole else first[j]), counts[at])

    @staticmethod
    def _batch(j: np.ndarray, bits: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (j, bits, n)], names=["j", "bits", "n"])


def quantiles_of_sets(df: DataFrame, cell: str, members: Mapping[int, Sequence[int]], cols: Sequence[str], probs: Sequence[float]) -> dict[tuple[int, int], tuple[int, list[float]]]:
    """Exact quantiles, as in ``quantile_table``, of sets of rows that may overlap: (n, quantiles) by set and number of the column; none for a set without values.

    ``cell`` is a long column; ``members`` names the sets of the rows of each of its values.  Every pass counts values by some more of their leading bits, for all sets at once, in
    arrays that a task adds to; the driver sees counts alone.
    """
    rows = df.select(F.col(cell).cast("bigint"), *[F.col(c).cast("double") for c in cols])

    def counted(wanted: Sequence[tuple[int, int]], above: int, shift: int) -> dict[int, list[tuple[int, int]]]:
        count = _Count(members, len(cols), wanted, above, shift)
        found = rows.mapInArrow(count.run, "j long, bits long, n long").groupBy("j", "bits").agg(F.sum("n").alias("n")).toArrow()
        out: dict[int, list[tuple[int, int]]] = {}
        for j, bits, n in sorted(zip(*(found.column(c).to_pylist() for c in ("j", "bits", "n")))):
            out.setdefault(j, []).append((bits, n))
        return out

    shift = 52  # sign and exponent
    table = counted([], 64, shift)
    sizes = {pair: sum(n for _, n in own) for pair, own in table.items()}
    ranks = {pair: [((n - 1) * p) for p in probs] for pair, n in sizes.items()}
    #: (pair, rank) -> place in ``table``, rank there
    open_ = {(pair, r): (pair, r) for pair, x in ranks.items() for q in x for r in (int(np.floor(q)), int(np.ceil(q)))}
    while True:
        held: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (pair, r), (j, rank) in open_.items():
            for bits, n in table[j]:
                if rank < n:
                    held[pair, r] = (bits, rank, n)
                    break
                rank -= n
        if shift == 0:
            break
        wanted = sorted({(pair, bits) for (pair, _), (bits, _, _) in held.items()})
        near = sum({(pair, bits): n for (pair, _), (bits, _, n) in held.items()}.values())
        above, shift = shift, 0 if near <= NEAR else max(0, shift - STEP)
        table = counted(wanted, above, shift) if wanted else {}
        place = {w: j for j, w in enumerate(wanted)}
        open_ = {(pair, r): (place[pair, bits], rank) for (pair, r), (bits, rank, _) in held.items()}

    def value(pair: int, r: int) -> float:
        bits = held[pair, r][0]
        size = float(np.array([abs(bits)], np.int64).view(np.float64)[0])
        return -size if bits < 0 else size
    out = {}
    for pair, x in ranks.items():
        sides = [(value(pair, int(np.floor(q))), value(pair, int(np.ceil(q))), q - np.floor(q)) for q in x]
        out[pair // len(cols), pair % len(cols)] = (sizes[pair], [float(low if low == high else low + (high - low) * part) for low, high, part in sides])
    return out


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe join of the sides aliased l and r."""
    return left.join(right, reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]), how)


def agg_with_medians(df: DataFrame, metrics: Mapping[str, Column], by: Sequence[str], medians: Mapping[str, Column]) -> DataFrame:
    """Aggregates plus medians of row expressions."""
    out = df.groupBy(*by).agg(*[v.alias(k) for k, v in metrics.items()])
    table = quantile_table(df.select(*by, *[v.alias(k) for k, v in medians.items()]), list(medians), [0.5], by)
    if not by:
        lookup = table.agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("q")[0].alias("m")))).alias("m")).scalar()
        return out.withColumns({k: F.element_at(lookup, F.lit(k)) for k in medians})
    wide = table.groupBy(*by).agg(*[F.max(F.when(F.col("column") == k, F.col("q")[0])).alias(k) for k in medians])
    return _same(out.alias("l"), wide.alias("r"), list(by), "inner").select("l.*", *[F.col(f"r.{k}").alias(k) for k in medians])


def quantile_columns(df: DataFrame, cols: Sequence[str], names: dict[str, float], by: Sequence[str] = (),
                     **kw: object) -> DataFrame:
    """``quantile_table`` with the quantiles spread into named columns."""
    table = quantile_table(df, cols, list(names.values()), by, **kw)
    return table.select(*by, "column", "n", *[F.col("q")[i].alias(k) for i, k in enumerate(names)])


def scalar_quantiles(df: DataFrame, col: str, probs: Sequence[float], **kw: object) -> list[Column]:
    """Whole-table quantiles as scalar-subquery columns (run once, inlined as literals)."""
    q = quantile_table(df, [col], probs, **kw).select("q").scalar()
    return [q.getItem(i) for i in range(len(probs))]
