"""Bootstrap over clusters without a join: each group of blocks works out by itself how often every draw takes each of its clusters.

A draw takes as many clusters as there are, with replacement.  The clusters stand in hash order; a fixed binary tree cuts that order into blocks, and at each node
a seeded binomial divides what a draw takes between the halves.  A group of neighbouring blocks walks down to its own subtree, goes through that once, deals what each block gets to its
clusters by hash, and ships one row of sums a draw.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import hash_index
from plumbline.session import cut_lineage

# task code travels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: clusters of one block, as long as the tree has no more than ``MOST_BLOCKS`` leaves
LEAF = 1024
MOST_BLOCKS = 4096
#: standard deviations of a binomial that are looked at on either side, and whole steps besides; beyond lies less than a double tells from 0
REACH, STEPS = 9, 40
#: groups of blocks, and clusters of one of them beyond which there are more groups
GROUPS, GROUP_CLUSTERS = 64, 1 << 17
#: cells of a draws x clusters matrix that are held at once: they fit a core's cache
CELLS = 1 << 16
_FACTOR = np.uint32(0x45D9F3B)


def block_count(n: int, leaf: int = LEAF) -> int:
    """Leaves of the tree over ``n`` clusters: a power of two."""
    count = 1
    while count * leaf < n and count < MOST_BLOCKS:
        count *= 2
    return count


def block_start(block: int, n: int, blocks: int) -> int:
    return -(-block * n // blocks)


def uniform(seed: object, draws: np.ndarray, node: int) -> np.ndarray:
    """One number in [0, 1) per draw and node of the tree (root 1, children 2k and 2k + 1)."""
    return np.array([int(md5(f"{seed}|{d}|{node}".encode()).hexdigest()[:13], 16) for d in draws.tolist()]) / float(1 << 52)


def binomial(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Smallest k whose distribution function among ``n`` trials of chance ``p`` reaches ``u``."""
    if p >= 1 or p <= 0:
        return n * int(p >= 1)
    out = np.zeros(len(n), np.int64)
    order = np.argsort(n, kind="stable")
    trials, first = np.unique(n[order], return_index=True)  # draws with the same number of trials share a table
    spread = REACH * np.sqrt(trials * p * (1 - p)) + STEPS
    low, high = np.maximum(0, np.floor(trials * p - spread)).astype(np.int64), np.minimum(trials, np.ceil(trials * p + spread)).astype(np.int64)
    width = int((high - low).max(initial=0)) + 1
    step, ends = max(1, CELLS // width), np.append(first, len(n))
    for start in range(0, len(trials), step):
        at = slice(start, start + step)
        k = low[at, None] + np.arange(width)
        # each weight from the one before; what is left out at both ends weighs nothing
        weight = np.where(k <= high[at, None], (trials[at, None] - k + 1) / np.maximum(k, 1) * (p / (1 - p)), 0.0)
        weight[:, 0] = 1.0
        reached = np.cumsum(np.cumprod(weight, axis=1), axis=1)
        for i, own in enumerate(reached, start):
            rows = order[ends[i]:ends[i + 1]]
            out[rows] = np.minimum(low[i] + np.searchsorted(own, u[rows] * own[-1], "left"), high[i])
    return out


def group_count(n: int, blocks: int) -> int:
    """Groups of neighbouring blocks that are dealt together: a power of two."""
    count = min(blocks, GROUPS)
    while count < blocks and count * GROUP_CLUSTERS < n:
        count *= 2
    return count


def taken_by_blocks(wanted: Sequence[int], n: int, blocks: int, draws: np.ndarray, seed: object) -> Iterator[tuple[int, np.ndarray]]:
    """How many clusters each draw takes, for the (sorted) ``wanted`` blocks: every node above them is divided once."""
    open_ = [(0, blocks, 1, np.full(len(draws), n, np.int64))]
    while open_:
        left, right, node, taken = open_.pop()
        if bisect_left(wanted, left) == bisect_left(wanted, right):
            continue
        if right - left == 1:
            yield left, taken
            continue
        middle = (left + right) // 2
        a, b, c = (block_start(x, n, blocks) for x in (left, middle, right))
        first = binomial(uniform(seed, draws, node), taken, (b - a) / (c - a))
        open_ += [(middle, right, 2 * node + 1, taken - first), (left, middle, 2 * node, first)]


def _mix(x: np.ndarray) -> np.ndarray:
    """32-bit hash of each number; products wrap."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * _FACTOR
    return x ^ (x >> np.uint32(16))


def positions(seed: object, draws: np.ndarray, owner: np.ndarray, block: int, j: np.ndarray, size: int) -> np.ndarray:
    """Which of the ``size`` clusters of a block the ``j``-th pick of the draw ``draws[owner]`` takes: 52 hash bits, modulo."""
    base = _mix(np.uint32(crc32(str(seed).encode())) + draws.astype(np.uint32))
    base = _mix(base + np.uint32(block))
    other = _mix(base ^ np.uint32(0x5BD1E995))[owner]
    first = _mix(base[owner] + j.astype(np.uint32))
    high, low = _mix(first ^ other), _mix(first + other)
    wide = (high.astype(np.int64) << 20) + (low >> np.uint32(12))
    return wide - wide // size * size


def dealt(block: int, size: int, taken: np.ndarray, seed: object) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(draws, matrix draws x clusters of the block): what each draw takes of the block, dealt to its clusters, some draws at a time."""
    every = np.arange(len(taken))
    step = max(1, CELLS // max(1, size))
    for start in range(0, len(taken), step):
        mine, count = every[start:start + step], taken[start:start + step]
        owner = np.repeat(np.arange(len(mine)), count)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = owner * size + positions(seed, mine, owner, block, j, size)
        yield mine, np.bincount(at, minlength=len(mine) * size).reshape(len(mine), size)


def multiplicities(block: int, n: int, blocks: int, draws: int, seed: object) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(draws, matrix draws x clusters of the block): how often each draw takes each cluster, some draws at a time."""
    for _, taken in taken_by_blocks([block], n, blocks, np.arange(draws), seed):
        yield from dealt(block, block_start(block + 1, n, blocks) - block_start(block, n, blocks), taken, seed)


def place_clusters(clusters: DataFrame, cluster: str, seed: object, leaf: int = LEAF) -> tuple[DataFrame, int, int]:
    """``clusters`` with ``_idx`` (hash order) and ``_block``; their number and that of the blocks."""
    indexed = cut_lineage(hash_index(clusters, [cluster], seed, name="_idx"))
    n = indexed.count()
    blocks = block_count(n, leaf)
    return indexed.withColumn("_block", F.expr(f"(_idx * {blocks}L) div {max(1, n)}L")), n, blocks


def _adder(n: int, blocks: int, groups: int, draws: int, seed: object) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        group, each = table["_group"][0].as_py(), blocks // groups
        first, last = block_start(group * each, n, blocks), block_start((group + 1) * each, n, blocks)
        flat = table["values"].combine_chunks()
        values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(table), -1)
        placed = np.zeros((last - first, values.shape[1]))
        placed[table["_idx"].to_numpy() - first] = values
        total = np.zeros((draws, values.shape[1]))
        for block, taken in taken_by_blocks(range(group * each, (group + 1) * each), n, blocks, np.arange(draws), seed):
            start, end = block_start(block, n, blocks), block_start(block + 1, n, blocks)
            for mine, counts in dealt(block, end - start, taken, seed):
                total[mine] += counts @ placed[start - first:end - first]
        offsets = pa.array(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32))
        return pa.table({"draw": np.arange(draws), "total": pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))})
    return run


def _grouped(blocks: int, groups: int) -> Column:
    return F.expr(f"_block div {blocks // groups}L").alias("_group")


def resampled_sums(placed: DataFrame, n: int, blocks: int, width: int, draws: int, seed: object) -> DataFrame:
    """(draw, total): sums of the array column ``values`` (``width`` doubles without nulls) of ``placed`` clusters over what each draw takes."""
    # the rows are few and the work is not: about one task a group
    groups = group_count(n, blocks)
    rows = placed.select(_grouped(blocks, groups), "_idx", "values").repartition(groups, "_group")
    sums = rows.groupBy("_group").applyInArrow(_adder(n, blocks, groups, draws, seed), "draw long, total array<double>")
    return sums.groupBy("draw").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))


def _expander(n: int, blocks: int, draws: int, seed: object, held: list[list[int]]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        of, idx = table["_block"].to_numpy(), table["_idx"].to_numpy()
        cell, v, c = table["cell"].to_numpy(), table["v"].to_numpy(), table["c"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        holders: dict[int, np.ndarray] = {k: np.array([d for d, own in enumerate(held) if k in own]) for k in np.unique(cell).tolist()}
        for block, taken in taken_by_blocks(np.unique(of).tolist(), n, blocks, np.arange(draws), seed):
            start, inside = block_start(block, n, blocks), np.flatnonzero(of == block)
            rows = {k: inside[cell[inside] == k] for k in np.unique(cell[inside]).tolist()}
            for mine, counts in dealt(block, block_start(block + 1, n, blocks) - start, taken, seed):
                for k, own in rows.items():
                    some = holders[k]
                    some = some[np.searchsorted(some, mine[0]):np.searchsorted(some, mine[-1], "right")]
                    m = counts[np.ix_(some - mine[0], idx[own] - start)]
                    i, j = np.nonzero(m)
                    found.append((some[i], own[j], m[i, j] * c[own[j]]))
        draw, row, m = (np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"draw": draw, "cell": pa.array(cell[row].astype(np.int32)), "v": v[row], "m": m})
    return run


def resampled_values(rows: DataFrame, n: int, blocks: int, draws: int, seed: object, held: list[list[int]], together: bool = True) -> DataFrame:
    """(draw, cell, v, m): how often each draw takes a value, for the cells ``held[draw]`` alone.

    ``rows`` (``_block``, ``_idx``, ``cell``, ``v``, ``c``, ``part``) are values of placed clusters with their counts; a block's rows may be dealt to several parts.
    Neighbouring blocks are expanded ``together`` unless their rows are many.
    """
    groups = group_count(n, blocks) if together else blocks
    dealt_rows = rows.select(_grouped(blocks, groups), "_block", "_idx", "cell", "v", "c", "part").repartition(2 * groups, "_group", "part")
    return dealt_rows.groupBy("_group", "part").applyInArrow(_expander(n, blocks, draws, seed, held), "draw long, cell int, v double, m long")
