"""Forests and boosted trees for every held-out part at once, from histograms that add up.

As in MLlib a feature has at most ``maxBins`` bins, and a split of a node needs no more than the sums of weights and targets in each of them.  The bins of a part come
from its training rows alone.  Rows are stored once, ordered by bins, so that rows of equal bins lie together: a level of all trees of all parts is one pass that adds up such rows first and sends them
down the trees as one.  The splits are chosen per part and tree on the executors; the driver holds the trees.  A forest's bootstrap draws are a hash of row and tree, equal in every pass.
Where few combinations of bins occur, a boosting round is one pass: it ships the sums of each combination, and all levels of the next tree grow from them, for all losses and parts at once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import restore_target
from plumbline.operators.ordering import quantile_table
from plumbline.plans.gram import prepared
from plumbline.session import cut_lineage

# task code travels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: category names, levels and sums held per pass up to which trees are grown here; beyond, MLlib fits part by part
MOST_LABELS, MOST_DEPTH, HELD = 256, 10, 1 << 24
#: combinations of bins up to which whole trees grow from their sums; rows that are added up together, and places in trees looked at together
MOST_CELLS, BLOCK, WALKED = 1 << 18, 1 << 18, 1 << 20
_FOREST = {"numTrees": 20, "maxDepth": 5, "maxBins": 32, "featureSubsetStrategy": "auto", "bootstrap": True}
_BOOSTED = {"maxIter": 20, "maxDepth": 5, "maxBins": 32, "stepSize": 0.1}
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- bootstrap draws ---------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x * _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))
_DRAW = np.searchsorted(_POISSON, np.arange(1 << 16) / 65536, "right").astype(np.uint8)
_DRAW[np.unique((_POISSON * 65536).astype(np.int64).clip(max=65535))] = 255  # needs more bits


def draws(row: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each row is drawn for each tree: Poisson of mean 1, as MLlib draws with replacement.  ``trees`` are neighbours, the first a multiple of 4."""
    groups = np.arange(trees[0] // 4, trees[-1] // 4 + 1, dtype=np.uint64)
    own = _mix(row.astype(np.uint64) + _mix(np.array([seed % (1 << 32)], np.uint64)))
    bits = _mix(own[:, None] + groups).view(np.uint16).reshape(len(row), -1)[:, :len(trees)]
    out = _DRAW[bits]
    i, j = np.nonzero(out == 255)
    more = (_mix(own[i] ^ (trees[j].astype(np.uint64) + np.uint64(1 << 40))) >> np.uint64(11)) / 2.0 ** 53
    out[i, j] = np.searchsorted(_POISSON, (bits[i, j] + more) / 65536, "right")
    return out


# ---- bins --------------------------------------------------------------------------------------

@dataclass
class Bins:
    """Codes of the stored rows and, per part, what its own training rows make of them.

    A numeric code is the number of thresholds (of any part) below the value, the next one is null; a category's is its place among the labels from 1, 0 unknown, the last null.
    The features of a part are numeric, then missing flags, then categories.
    """

    parts: list[int]
    thresholds: list[np.ndarray]
    labels: list[list[str]]
    maps: list[list[np.ndarray]]  # per part and column: bin of each code
    slots: list[list[tuple[int, int]]]  # per part: (feature, label) that may be split, label -1 for thresholds
    shift: np.ndarray  # mean target of each part's training rows
    medians: np.ndarray  # of the untransformed target

    @property
    def sizes(self) -> list[int]:
        """Bins of each feature."""
        numeric = len(self.thresholds)
        return [*(max(int(m[j].max()) + 1 for m in self.maps) for j in range(numeric)), *[2] * numeric, *(len(x) + 1 for x in self.labels)]

    def features(self, part: int, codes: np.ndarray) -> np.ndarray:
        numeric, maps = len(self.thresholds), self.maps[part]
        flags = [codes[:, j] == len(self.thresholds[j]) + 1 for j in range(numeric)]
        return np.stack([*(maps[j][codes[:, j]] for j in range(numeric)), *flags, *(maps[i][codes[:, i]] for i in range(numeric, codes.shape[1]))], 1).astype(np.int32)


def _few_values(rows: DataFrame, fold: str, numeric: Sequence[str], parts: Sequence[int], most: int) -> dict[tuple[str, int], list[float]]:
    """The distinct training values of a column and part that has at most ``most``."""
    packed = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) + F.lit(0.0)).alias("v")) for c in numeric])
    seen = rows.select(F.col(fold).alias("_of"), F.inline(packed)).where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.collect_set("_of").alias("_in"))
    outside = F.filter(F.array(*[F.lit(k) for k in parts]), lambda k: F.exists("_in", lambda o: o != k))
    seen = cut_lineage(seen.select("column", "v", F.explode(outside).alias("_part")))
    few = seen.groupBy("column", "_part").count().where(F.col("count") <= most)
    out: dict[tuple[str, int], list[float]] = {}
    for r in seen.join(F.broadcast(few), ["column", "_part"]).collect():
        out.setdefault((r["column"], r["_part"]), []).append(r["v"])
    return {key: sorted(v) for key, v in out.items()}


def find_bins(rows: DataFrame, fold: str, spec: object, most: int) -> Bins | None:
    """Bins of ``prepared`` rows with a target; None where a part has no training rows or there are too many categories."""
    numeric, categorical = list(spec.numeric), list(spec.categorical)
    stats = {r[fold]: r for r in rows.groupBy(fold).agg(F.count("*").alias("n"), F.sum("_y").alias("y"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(numeric)]).collect()}
    parts, names = sorted(stats), {}
    if len(parts) < 2:
        return None
    if categorical:
        packed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in categorical])
        counts = rows.select(F.col(fold).alias("_of"), F.inline(packed)).where(F.col("value").isNotNull()).groupBy("column", "value", "_of").count()
        found = counts.limit(MOST_LABELS * len(parts) + 1).collect()
        names = {(r["column"], r["value"], r["_of"]): r["count"] for r in found}
        if len(found) > MOST_LABELS * len(parts) or len({key[:2] for key in names}) > MOST_LABELS:
            return None
    labels = [sorted({v for column, v, _ in names if column == c}) for c in categorical]
    probs = [0.5, *(i / most for i in range(1, most))]
    extra = ["_t"] if spec.weighted else []
    ranks = {(r["column"], r[fold]): r["q"] for r in quantile_table(rows, [*numeric, *extra], probs, leave_out=fold).collect()} if numeric or extra else {}
    few = _few_values(rows, fold, numeric, parts, most) if numeric else {}

    def cuts(column: str, k: int) -> np.ndarray:
        if (column, k) in few:
            v = np.array(few[column, k])
            return (v[:-1] + v[1:]) / 2
        return np.unique((ranks[column, k] or [])[1:])

    own = [[cuts(c, k) for c in numeric] for k in parts]
    every = [np.unique(np.concatenate([o[j] for o in own])) for j in range(len(numeric))]
    maps, slots, shift = [], [], []
    for k, mine in zip(parts, own):
        rest = [r for f, r in stats.items() if f != k]
        n = sum(r["n"] for r in rest)
        shift.append(sum(r["y"] for r in rest) / n)
        of = []
        for j, c in enumerate(numeric):
            median = (ranks[c, k] or [0.0])[0]
            of.append(np.concatenate([[0], np.searchsorted(mine[j], every[j], "right"), [np.searchsorted(mine[j], median)]]))
        can = [(j, -1) for j in range(len(numeric))]
        can += [(len(numeric) + j, -1) for j in range(len(numeric)) if sum(r[f"n_{j}"] for r in rest) < n]
        for i, (c, known) in enumerate(zip(categorical, labels)):
            counts = np.array([sum(names.get((c, v, f), 0) for f in parts if f != k) for v in known], np.int64)
            mode = int(np.argmax(counts)) + 1 if len(known) else 0  # labels are sorted, so the first of equals by name
            of.append(np.array([0, *range(1, len(known) + 1), mode]))
            can += [(2 * len(numeric) + i, v + 1) for v in np.flatnonzero(counts).tolist()]
        maps.append(of)
        slots.append(can)
    medians = np.array([(ranks["_t", k] or [0.0])[0] if spec.weighted else 1.0 for k in parts])
    return Bins(parts, every, labels, maps, slots, np.array(shift), medians)


def _coded(rows: DataFrame, bins: Bins, spec: object) -> tuple[DataFrame, list[str]]:
    """``rows`` with a short integer per column of the spec."""
    codes = [f"_code{i}" for i in range(len(spec.numeric) + len(spec.categorical))]
    for c, at, name in zip(spec.numeric, bins.thresholds, codes):
        if len(at):  # a bucket holds its lower end, a bin its upper one
            splits = [-np.inf, *np.nextafter(at, np.inf).tolist(), np.inf]
            rows = Bucketizer(splits=splits, inputCol=c, outputCol=name, handleInvalid="keep").transform(rows)
        else:
            rows = rows.withColumn(name, F.when(F.col(c).isNotNull(), F.lit(0)))
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(len(at) + 1)).cast("short"))
    for c, known, name in zip(spec.categorical, bins.labels, codes[len(spec.numeric):]):
        place = F.array_position(F.array(*[F.lit(v) for v in known]).cast("array<string>"), F.col(c))
        rows = rows.withColumn(name, F.coalesce(place, F.lit(len(known) + 1)).cast("short"))
    return rows, codes


# ---- trees -------------------------------------------------------------------------------------

@dataclass
class Trees:
    """Binary trees by part and number; children of node i are 2i and 2i + 1, the root is 1; feature -1 marks a leaf."""

    feature: np.ndarray
    at: np.ndarray  # bin up to which rows go left, or the category that goes right
    value: np.ndarray
    categorical: int  # features from here on are categories

    @staticmethod
    def empty(parts: int, trees: int, depth: int, categorical: int) -> Trees:
        shape = (parts, trees, 2 << depth)
        return Trees(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), categorical)

    def nodes(self, part: int, trees: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
        """Where the rows ``x`` of features stand in each tree after so many levels."""
        node = np.ones((len(x), len(trees)), np.int64)
        first, flat = trees * self.feature.shape[2], x.ravel()
        feature, at = self.feature[part].ravel(), self.at[part].ravel()
        row = (np.arange(len(x)) * x.shape[1])[:, None]
        for _ in range(levels):
            place = first + node
            f, cut = feature[place], at[place]
            value = flat[row + np.maximum(f, 0)]
            right = np.where(f >= self.categorical, value == cut, value > cut)
            node = np.where(f >= 0, 2 * node + right, node)
        return node

    def predict(self, part: int, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of the trees' values for each row of features."""
        trees, value, size = np.arange(self.feature.shape[1]), (self.value[part] * weights[:, None]).ravel(), self.feature.shape[2]
        out, step = np.empty(len(x)), max(1, WALKED // max(1, len(trees)))
        if size <= 16 and len(x):
            kept, reached = self._leaves(part, x.max(0) + 1)
            value, trees = value.reshape(-1, size)[trees[:, None], reached].ravel(), trees * 256
        for i in range(0, len(x), step):
            if size <= 16:  # a tree leaves one bit of its byte, whatever the order of its splits
                some = x[i:i + step]
                node = np.full((len(some), len(trees)), 255, np.uint8)
                for f, table in kept.items():
                    node &= table[some[:, f]]
                out[i:i + step] = value[trees + node].sum(1)
            else:
                node = self.nodes(part, trees, x[i:i + step], size.bit_length() - 2)
                out[i:i + step] = value[trees * size + node].sum(1)
        return out

    def _leaves(self, part: int, sizes: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Trees of up to eight leaves: per feature which leaves (bits) of each tree a bin leaves open, and the node reached for every set of open leaves."""
        feature, at, size = self.feature[part], self.at[part], self.feature.shape[2]
        kept = {f: np.full((sizes[f], len(feature)), 255, np.uint8) for f in np.unique(feature[feature >= 0]).tolist()}
        half = size // 2
        ends = np.arange(half, size) + np.zeros((len(feature), 1), np.int64)  # where each leaf of a full tree stands
        for node in range(half - 1, 0, -1):
            leaves = [v for v in range(half) if (half + v) >> (half.bit_length() - node.bit_length()) == node]
            lower, upper = (sum(1 << v for v in side) for side in (leaves[:len(leaves) // 2], leaves[len(leaves) // 2:]))
            ends[np.ix_(feature[:, node] < 0, leaves)] = node
            for f, table in kept.items():
                own = np.flatnonzero(feature[:, node] == f)
                bins = np.arange(len(table))[:, None]
                right = bins == at[own, node] if f >= self.categorical else bins > at[own, node]
                table[:, own] &= np.where(right, 255 - lower, 255 - upper).astype(np.uint8)
        first = np.array([0, *((m & -m).bit_length() - 1 for m in range(1, 256))])
        return kept, ends[:, np.minimum(first, half - 1)]

    def with_next(self, tree: Trees) -> Trees:
        return Trees(*(np.concatenate([getattr(self, c), getattr(tree, c)], 1) for c in ("feature", "at", "value")), self.categorical)

    def learn(self, splits: Sequence[Mapping[str, object]], shift: np.ndarray) -> None:
        """Takes up the splits found for open nodes."""
        for r in splits:
            p, t, node = r["part"], r["tree"], r["node"]
            if node == 1:
                self.value[p, t, 1] = r["mean"] + shift[p]
            if r["feature"] >= 0:
                self.feature[p, t, node], self.at[p, t, node] = r["feature"], r["at"]
                self.value[p, t, 2 * node], self.value[p, t, 2 * node + 1] = r["low"] + shift[p], r["high"] + shift[p]


def _starts(columns: Sequence[np.ndarray], n: int) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _cells(codes: Sequence[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where neighbouring rows of equal codes begin, each row's place among these cells, and the codes of each."""
    start = _starts(codes, n)
    code = np.stack([c[start] for c in codes], 1) if codes else np.zeros((len(start), 0), np.int64)
    return start, np.repeat(np.arange(len(start)), np.diff(np.append(start, n))), code


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of so many rows together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield _numbers(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _numbers(pa.Table.from_batches(held))


def _numbers(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in batch.columns]


@dataclass
class Growth:
    """What a pass needs to add up one level of some trees of all parts."""

    bins: Bins
    trees: Trees
    before: tuple[np.ndarray, Trees] | None  # boosting: weights and trees so far
    objective: str
    weighted: bool
    bootstrap: bool
    seed: int
    level: int
    members: np.ndarray  # numbers of the trees

    def sums(self, columns: list[np.ndarray], total: list[list[np.ndarray]]) -> None:
        """Adds rows (codes, fold, target, untransformed target, id) to ``total``: per part and feature weights and targets by tree, node and bin."""
        *codes, fold, y, raw, row = columns
        start, cell, code = _cells(codes, len(y))
        if not self.before and self.bootstrap:
            piece = _starts([cell, fold], len(y))
            drawn = draws(row, self.members, self.seed).astype(float)
            of, whose = cell[piece], fold[piece]
            count, pull = (np.add.reduceat(x, piece, axis=0) for x in (drawn, drawn * y[:, None]))
            first = np.searchsorted(of, np.arange(len(start)))
            every = [np.add.reduceat(x, first, axis=0) for x in (count, pull)]
        for p, k in enumerate(self.bins.parts):
            x = self.bins.features(p, code)
            if not self.before and self.bootstrap:
                w, s = every[0].copy(), every[1].copy()
                mine = np.flatnonzero(whose == k)
                w[of[mine]] -= count[mine]
                s[of[mine]] -= pull[mine]
                s -= w * self.bins.shift[p]
                s[w == 0] = 0.0
            else:
                w, s = (np.repeat(v[:, None], len(self.members), 1) for v in self.by_cell(p, x, fold, y, raw, cell))
            self._add(p, x, w, s, total[p])

    def by_cell(self, part: int, x: np.ndarray, fold: np.ndarray, y: np.ndarray, raw: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and weighted targets of a part's training rows in each cell."""
        one = (fold != self.bins.parts[part]).astype(float)
        if self.weighted:
            one *= np.clip(np.sqrt(raw / self.bins.medians[part]), 0.5, 2.0)
        return np.bincount(cell, one, len(x)), np.bincount(cell, one * self._target(part, x, y, cell), len(x))

    def _target(self, part: int, x: np.ndarray, y: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The target, or its pseudo-residual as MLlib's losses have it."""
        if not self.before:
            return y - self.bins.shift[part]
        weights, trees = self.before
        left = y - trees.predict(part, x, weights)[cell]
        return 2 * left if self.objective == "squared" else np.where(left < 0, -1.0, 1.0)

    def _add(self, part: int, x: np.ndarray, w: np.ndarray, s: np.ndarray, total: list[np.ndarray]) -> None:
        width = 1 << self.level
        node = self.trees.nodes(part, self.members, x, self.level) - width
        open_ = (node >= 0) & (w > 0)
        i, j = np.nonzero(open_)
        place, w, s = j * width + node[open_], w[open_], s[open_]
        for f, size in enumerate(self.bins.sizes):
            at = place * size + x[i, f]
            for side, v in enumerate((w, s)):
                total[f][side] += np.bincount(at, v, total[f].shape[1])

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(self.members) << self.level
        total = [[np.zeros((2, cells * size)) for size in self.bins.sizes] for _ in self.bins.parts]
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                self.sums(_numbers(batch), total)
        for p in range(len(self.bins.parts) if some else 0):
            by_tree = np.concatenate([t.reshape(2, len(self.members), -1) for t in total[p]], 2).transpose(1, 0, 2)
            payload = [np.ascontiguousarray(t).tobytes() for t in by_tree]
            n = len(payload)
            yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array(self.members, pa.int32()), pa.array(payload, pa.binary())], names=["part", "tree", "sums"])

    def split(self, per_node: float | None) -> Callable[[pa.Table], pa.Table]:
        """Chooses the splits of one tree's open nodes; ``per_node`` is the share of features each one looks at."""
        bins, width, seed = self.bins, 1 << self.level, self.seed

        def run(table: pa.Table) -> pa.Table:
            part, tree = table.column("part")[0].as_py(), table.column("tree")[0].as_py()
            total = sum(np.frombuffer(b.as_buffer(), float) for b in table.column("sums").combine_chunks()).reshape(2, -1)
            edges = np.cumsum([0, *(width * size for size in bins.sizes)])
            by_feature = [total[:, a:b].reshape(2, width, -1) for a, b in zip(edges[:-1], edges[1:])]
            return pa.Table.from_pylist(_choose(bins, part, tree, width, by_feature, per_node, seed), _SPLIT)

        return run


def _choose(bins: Bins, part: int, tree: int, width: int, by_feature: Sequence[np.ndarray], per_node: float | None, seed: int) -> list[dict[str, object]]:
    """Best split of every open node of a level, from weights and targets by node and bin of each feature."""
    slots, out = bins.slots[part], []
    for node in range(width):
        w, s = by_feature[0][:, node].sum(1)
        if not w > 0:
            continue
        looked = range(len(slots))
        if per_node is not None:
            looked = sorted(np.random.default_rng([seed % (1 << 32), part, tree, width + node]).choice(len(slots), int(np.ceil(per_node * len(slots))), replace=False).tolist())
        best, least = (0.0, -1, 0, 0.0, 0.0), 1e-9 * min(w, 1.0)
        for f, label in (slots[i] for i in looked):
            here = by_feature[f][:, node]
            if label < 0:
                left = np.cumsum(here, 1)[:, :-1]
            else:
                left = np.array([[w - here[0, label]], [s - here[1, label]]])
            right = np.array([[w], [s]]) - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - s * s / w
            gain[(left[0] <= least) | (right[0] <= least)] = -1.0
            at = int(np.argmax(gain)) if len(gain) else -1
            if at >= 0 and gain[at] > max(best[0], 1e-13 * s * s / w):
                best = (float(gain[at]), f, at if label < 0 else label, float(left[1, at] / left[0, at]), float(right[1, at] / right[0, at]))
        out.append(dict(zip(_SPLIT.names, (part, tree, width + node, float(s / w), *best[1:]))))
    return out


_SPLITS = "part int, tree int, node int, mean double, feature int, at int, low double, high double"
_SPLIT = pa.schema([*((c, pa.int32()) for c in ("part", "tree", "node")), ("mean", pa.float64()), ("feature", pa.int32()), ("at", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])


def _grow(rows: DataFrame, bins: Bins, trees: int, depth: int, per_node: float | None, **how: object) -> Trees:
    """Trees of all parts, a pass a level (and per group of trees whose sums fit); ``rows`` are codes, fold, target, untransformed target, id."""
    numeric, shift = len(bins.thresholds), _shift(bins, how["before"])
    grown = Trees.empty(len(bins.parts), trees, depth, 2 * numeric)
    grown.value[:, :, 1] = shift[:, None]
    for level in range(depth):
        each = max(4, HELD // (2 * len(bins.parts) * sum(bins.sizes) << level) // 4 * 4)
        found = []
        for start in range(0, trees, each):
            growth = Growth(bins, grown, level=level, members=np.arange(start, min(trees, start + each)), **how)
            sums = rows.mapInArrow(growth.run, "part int, tree int, sums binary")
            found += sums.groupBy("part", "tree").applyInArrow(growth.split(per_node), _SPLITS).collect()
        grown.learn(found, shift)
        if not any(r["feature"] >= 0 for r in found):
            break
    return grown


def _shift(bins: Bins, before: tuple[np.ndarray, Trees] | None) -> np.ndarray:
    """What is added to values learned: the first tree learns from targets less their mean."""
    return bins.shift if before is None else np.zeros(len(bins.parts))


def _joined(before: tuple[np.ndarray, Trees] | None, tree: Trees, step: float) -> tuple[np.ndarray, Trees]:
    return (np.ones(1), tree) if before is None else (np.append(before[0], step), before[1].with_next(tree))


@dataclass
class Round:
    """A round of boosting for several runs: a pass adds up rows of equal bins, then the next tree of each run and part grows from these sums."""

    bins: Bins
    runs: list[Growth]
    depth: int

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *codes, fold, y, raw, _ in _blocks(batches, BLOCK):
            _, cell, code = _cells(codes, len(y))
            out = []
            for p in range(len(self.bins.parts)):
                x = self.bins.features(p, code)
                for r, growth in enumerate(self.runs):
                    w, s = growth.by_cell(p, x, fold, y, raw, cell)
                    some = w > 0
                    out.append((r, p, code[some].astype(np.int16).tobytes(), np.stack([w[some], s[some]]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["run", "part", "codes", "sums"])

    def grow(self) -> Callable[[pa.Table], pa.Table]:
        """Grows all levels of a run's next tree of a part; ``tree`` is the run's number."""
        return lambda table: self._grown(table)

    def _grown(self, table: pa.Table) -> pa.Table:
        run, part = table.column("run")[0].as_py(), table.column("part")[0].as_py()
        code = np.concatenate([np.frombuffer(b.as_buffer(), np.int16) for b in table.column("codes").combine_chunks()]).reshape(-1, len(self.bins.maps[part]))
        w, s = np.concatenate([np.frombuffer(b.as_buffer(), float).reshape(2, -1) for b in table.column("sums").combine_chunks()], 1)
        x, sizes, out = self.bins.features(part, code), self.bins.sizes, []
        tree = Trees.empty(1, 1, self.depth, 2 * len(self.bins.thresholds))
        for level in range(self.depth):
            width = 1 << level
            node = tree.nodes(0, np.zeros(1, np.int64), x, level)[:, 0] - width
            here = node >= 0
            at, weight, pull = node[here], w[here], s[here]
            by_feature = [np.stack([np.bincount(at * size + x[here, f], v, width * size) for v in (weight, pull)]).reshape(2, width, size) for f, size in enumerate(sizes)]
            found = _choose(self.bins, part, run, width, by_feature, None, 0)
            tree.learn([{**r, "part": 0, "tree": 0} for r in found], np.zeros(1))
            out += found
            if not any(r["feature"] >= 0 for r in found):
                break
        return pa.Table.from_pylist(out, _SPLIT)


def _boost(rows: DataFrame, bins: Bins, objectives: Sequence[tuple[str, bool]], rounds: int, depth: int, step: float) -> list[tuple[np.ndarray, Trees]]:
    """The ensembles of all (objective, weighted), a pass a round; ``rows`` as for ``_grow``."""
    ensembles: list[tuple[np.ndarray, Trees] | None] = [None] * len(objectives)
    for _ in range(rounds):
        growths = [Growth(bins, None, before, objective, weighted, False, 0, 0, np.zeros(1, np.int64)) for before, (objective, weighted) in zip(ensembles, objectives)]
        turn = Round(bins, growths, depth)
        sums = rows.mapInArrow(turn.sums, "run int, part int, codes binary, sums binary")
        found = sums.repartition(len(growths) * len(bins.parts), "run", "part").groupBy("run", "part").applyInArrow(turn.grow(), _SPLITS).collect()
        for r, before in enumerate(ensembles):
            tree = Trees.empty(len(bins.parts), 1, depth, 2 * len(bins.thresholds))
            shift = _shift(bins, before)
            tree.value[:, :, 1] = shift[:, None]
            tree.learn([{**x.asDict(), "tree": 0} for x in found if x["tree"] == r], shift)
            ensembles[r] = _joined(before, tree, step)
    return ensembles


def _few_cells(rows: DataFrame, codes: Sequence[str]) -> bool:
    """Whether the bins of ``rows``, which lie together, have few combinations."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _blocks(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([len(_starts(columns, len(columns[0])))])], names=["n"])
    return (rows.select(*codes).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0) <= MOST_CELLS


@dataclass
class Stored:
    """Rows ordered by their bins, in a stored table that several ensembles can share."""

    rows: DataFrame
    codes: list[str]
    bins: Bins
    weighted: bool  # whether every part's rows can be weighted


def _settings(spec: object, params: Mapping[str, object]) -> dict[str, object] | None:
    """All parameters; None where the ensemble is not grown here."""
    forest = spec.algorithm == "forest"
    known = _FOREST if forest else _BOOSTED
    p = {**known, **params}
    if (set(params) - set(known) or not spec.columns or p["maxDepth"] > MOST_DEPTH or min(p["maxDepth"], p.get("numTrees", 1), p.get("maxIter", 1)) < 1
            or (forest and (spec.weighted or not p["bootstrap"] or p["featureSubsetStrategy"] not in ("auto", "all", "onethird"))) or spec.objective not in ("squared", "absolute")):
        return None
    return p


def store(df: DataFrame, fold: str, spec: object, params: Mapping[str, object]) -> Stored | None:
    """What the ensembles of all specs that differ in objective, weighting and algorithm alone share; None where there is none."""
    p = _settings(spec, params)
    if p is None:
        return None
    whole = df.where(F.col(fold).isNotNull()).withColumn("_all", F.struct(*df.columns))
    rows = prepared(whole.withColumn("_t", F.col(spec.target).cast("double")), spec)
    seen = rows.where(F.col("_y").isNotNull())
    bins = find_bins(seen, fold, spec, p["maxBins"])
    if bins is None:
        return None
    weighted = spec.weighted and bool((bins.medians > 0).all()) and not seen.where(F.col("_t") < 0).limit(1).count()
    coded, codes = _coded(rows.select(fold, *spec.columns, "_y", "_t", "_all"), bins, spec)
    coded = coded.select(*codes, F.col(fold).cast("long").alias("_of"), "_y", "_t", F.monotonically_increasing_id().alias("_id"), "_all")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Stored(cut_lineage(coded.repartitionByRange(tasks, *codes, "_id").sortWithinPartitions(*codes, "_of")), codes, bins, weighted)


def out_of_fold(df: DataFrame, fold: str, spec: object, params: Mapping[str, object]) -> DataFrame | None:
    """Every row predicted by the ensemble of the other folds' rows; None where this is not done here."""
    found = out_of_fold_runs(df, fold, [spec], params)
    return found and found[0]


def out_of_fold_runs(df: DataFrame, fold: str, specs: Sequence[object], params: Mapping[str, object]) -> list[DataFrame] | None:
    """``out_of_fold`` of specs that differ in objective and weighting alone, all from the same stored rows; None where this is not done here."""
    spec = specs[0]
    settings = [_settings(s, params) for s in specs]
    if any(p is None for p in settings):
        return None
    stored = store(df, fold, replace(spec, weighted=any(s.weighted for s in specs)), params)
    if stored is None or any(s.weighted and not stored.weighted for s in specs):
        return None
    p, bins = settings[0], stored.bins
    train = stored.rows.where(F.col("_y").isNotNull()).select(*stored.codes, "_of", "_y", "_t", "_id")
    if spec.algorithm == "forest":
        strategy = p["featureSubsetStrategy"]
        share = None if strategy == "all" or (strategy == "auto" and p["numTrees"] == 1) else 1 / 3
        trees = [_grow(train, bins, p["numTrees"], p["maxDepth"], share, before=None, bootstrap=True, objective=s.objective, weighted=s.weighted, seed=s.seed) for s in specs]
        ensembles = [(np.full(p["numTrees"], 1.0 / p["numTrees"]), t) for t in trees]
    elif _few_cells(train, stored.codes):
        ensembles = _boost(train, bins, [(s.objective, s.weighted) for s in specs], p["maxIter"], p["maxDepth"], float(p["stepSize"]))
    else:
        ensembles = []
        for s in specs:
            before = None
            for _ in range(p["maxIter"]):
                tree = _grow(train, bins, 1, p["maxDepth"], None, before=before, bootstrap=False, objective=s.objective, weighted=s.weighted, seed=s.seed)
                before = _joined(before, tree, float(p["stepSize"]))
            ensembles.append(before)
    return [_predicted(stored, ensemble, s) for ensemble, s in zip(ensembles, specs)]


def _predicted(stored: Stored, ensemble: tuple[np.ndarray, Trees], spec: object) -> DataFrame:
    codes, bins, m = stored.codes, stored.bins, len(stored.codes)
    weights, trees = ensemble

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _numbers(pa.RecordBatch.from_arrays(batch.columns[:m + 1], names=batch.schema.names[:m + 1]))
            start = _starts(columns, batch.num_rows)
            code, of, raw = np.stack([c[start] for c in columns[:m]], 1), columns[m][start], np.full(len(start), np.nan)
            for p, k in enumerate(bins.parts):
                mine = np.flatnonzero(of == k)
                x = bins.features(p, code[mine])
                raw[mine] = trees.predict(p, x, weights)
            every = np.repeat(raw, np.diff(np.append(start, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(m + 1), pa.array(every)], names=["_all", "_raw_prediction"])

    out = T.StructType([stored.rows.schema["_all"], T.StructField("_raw_prediction", T.DoubleType())])
    unit = F.col(spec.unit) if spec.unit else None
    scored = stored.rows.select(*codes, "_of", "_all").mapInArrow(run, out).select("_all.*", "_raw_prediction")
    return scored.withColumn("prediction", restore_target(F.col("_raw_prediction"), spec.transform, unit)).drop("_raw_prediction")
