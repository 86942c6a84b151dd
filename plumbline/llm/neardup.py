"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

A text is a weighted set of five-word shingles: how often each occurs, times a damped inverse document frequency.  ``SAMPLES`` consistent weighted samples make up
``BANDS`` band keys; texts that share one are candidates.  In each bucket every text is compared with the bucket's representative, never with
all others; links are pairs whose weighted Jaccard similarity, computed from the whole texts, reaches the threshold.  Buckets that still hold several
classes are split by one more sample and compared again around other representatives.  What then still shares a bucket in different classes is compared
whole: a bucket's texts are dealt to salted cells, and each pair of cells compares all its pairs across classes at once.  Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import blocks, stored, with_columns
from plumbline.llm.words import find_words, mix, seeds, span_hashes, windows

SHINGLE = 5
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
ROUNDS = 3
THRESHOLD = 0.8
#: document frequencies are counted in so many slots, by hash; a shared slot only makes a shingle weigh a little less
SLOTS = 1 << 18
#: a shingle found everywhere weighs 1, a unique one 1 + DAMPING: a large group's common shingles keep their say
DAMPING = 0.25
BLOCK = 1 << 20
#: texts and bytes of one cell of a bucket that still holds several classes
CELL_ROWS, CELL_BYTES = 512, 8 << 20
_COLUMNS = 4096


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at n midpoints, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


class Sampler:
    """Draws a text's samples; one per task."""

    def __init__(self) -> None:
        self.step = _gamma_quantiles(1 << 12).astype(np.float32)
        self.log_c = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
        self.factor = seeds(SAMPLES, 21)

    def draw(self, hashes: np.ndarray, log_weight: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Samples (texts, SAMPLES) of elements sorted by text; rows of texts without elements are 0."""
        out = np.zeros((texts, SAMPLES), np.int32)
        if not len(hashes):
            return out
        first = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
        size = np.diff(np.append(first, len(owner)))
        rows = owner[first]
        for k, factor in enumerate(self.factor):
            v = hashes * factor
            r = self.step[v >> np.uint64(52)]
            beta = ((v >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
            t = np.floor(log_weight / r + beta)
            a = self.log_c[(v >> np.uint64(36)) & np.uint64(0xFFFF)] - r * (t - beta + 1)
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), size))
            at = least[np.searchsorted(least, first)]  # the first of equals
            chosen = mix(hashes[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[rows, k] = (chosen & np.uint64(0x7FFFFFFF)).astype(np.int32)
        return out


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle of each text; a text of fewer than five words has one shingle of all of them."""
    w = find_words(data, offsets)
    words, of, counts = span_hashes(data, w.start, w.end, fold_case=True), w.owner(), w.counts()
    value, first = windows(words, w.at, SHINGLE)
    values, owners = [value], [of[first]]
    for n in range(1, SHINGLE):
        if (counts == n).any():
            value, first = windows(words, w.at, n)
            whole = counts[of[first]] == n
            values.append(value[whole])
            owners.append(of[first][whole])
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort([value, owner])
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (np.diff(owner) != 0) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


def slot_weights(docs: DataFrame, text: Column) -> np.ndarray:
    """Damped inverse document frequency of each slot, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, data, at in blocks(batch.column(0), BLOCK):
                total += np.bincount((shingles(data, at)[1] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    rows = docs.select(text.alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(SLOTS)
    seen[rows["slot"].to_numpy(np.int64)] = rows["n"]
    seen = np.maximum(seen - np.median(seen), 0)  # what the usual load of a slot does not explain
    return (1 + DAMPING * (1 - np.log1p(seen) / np.log1p(max(seen.max(), 1)))).astype(np.float32)


def weigh(value: np.ndarray, count: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return count * weights[(value & np.uint64(SLOTS - 1)).astype(np.int64)]


def similarity(left: pa.Array, right: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each row."""
    out = []
    for rows, data, at in blocks(left, BLOCK):
        sides = []
        for column in (left[rows], right[rows]):
            own = [(owner + part.start, value, count) for part, d, a in blocks(column, BLOCK) for owner, value, count in [shingles(d, a)]]
            owner, value, count = (np.concatenate(x) for x in zip(*own))
            sides.append((mix(value + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), owner, weigh(value, count, weights)))
        (ka, oa, wa), (kb, ob, wb) = sides
        n = rows.stop - rows.start
        _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        shared = np.bincount(oa[ia], np.minimum(wa[ia], wb[ib]), n)
        every = np.bincount(oa, wa, n) + np.bincount(ob, wb, n) - shared
        out.append(np.where(every > 0, shared / np.maximum(every, 1e-9), 0.0))
    return np.concatenate(out)


def signatures(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` (id, key, text) with ``sig`` instead of the text; null without a word."""
    sampler: list[Sampler] = []

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not sampler:
            sampler.append(Sampler())
        parts, full = [], []
        for part, data, at in blocks(batch.column(batch.num_columns - 1), BLOCK):
            owner, value, count = shingles(data, at)
            n = part.stop - part.start
            parts.append(sampler[0].draw(value, np.log(weigh(value, count, weights)).astype(np.float32), owner, n))
            full.append(np.bincount(owner, minlength=n) > 0)
        flat, full = np.concatenate(parts), np.concatenate(full)
        ends = np.concatenate([[0], np.cumsum(full) * SAMPLES]).astype(np.int32)
        return {"sig": pa.ListArray.from_arrays(pa.array(ends, mask=np.concatenate([~full, [False]])), pa.array(flat[full].ravel()))}

    return with_columns(rows, {"sig": T.ArrayType(T.IntegerType())}, run, ["id", "key"], ["text"])


def _mark(edges: DataFrame) -> tuple[object, ...]:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(key, root): the lowest key of each node's connected component, for the nodes that have a link.

    Every round hangs all neighbours of a node, and the node, on the lowest of them, until nothing moves; a few rounds suffice as paths shrink to stars.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("n"), F.least("hi", "m").alias("m"))
        large = edges.select(F.col("hi").alias("n"), F.col("lo").alias("o")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("o"))).where(
            "o > n").join(low, "n").select(F.col("o").alias("hi"), F.col("m").alias("lo"))
        large = stored(large.where("hi != lo").distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        small = stored(small)
        before, edges = _mark(edges), small
        if _mark(edges) == before:
            return edges.select(F.col("hi").alias("key"), F.col("lo").alias("root"))


def _candidates(buckets: DataFrame, roots: DataFrame | None, round_: int) -> DataFrame:
    """Pairs (a, b) of each bucket's texts with its representative; from the second round on only across classes, in buckets split once more."""
    order = F.struct(F.xxhash64(F.lit(round_), "key").alias("o"), "key", "root") if round_ else F.struct(F.col("key").alias("o"), "key", "root")
    if roots is None:
        rows = buckets.select("bucket", "key", F.col("key").alias("root"))
    else:
        rows = buckets.join(roots, "key", "left").select(F.xxhash64("bucket", F.col("extra")[round_ - 1]).alias("bucket"), "key", F.coalesce("root", "key").alias("root"))
    heads = rows.groupBy("bucket").agg(F.min(order).alias("head"), F.max("root").alias("most"), F.min("root").alias("least")).where("least < most").select(
        "bucket", F.col("head.key").alias("b"), F.col("head.root").alias("b_root"))
    return rows.join(heads, "bucket").where("root != b_root").select(F.greatest("key", "b").alias("a"), F.least("key", "b").alias("b")).distinct()


def classify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``class_id``, the lowest id in the row's class; ``class_key``, a number of the class that is never
    null; ``text_key``, equal for equal texts; and ``class_first``, true for the text with the lowest id of the class (for every row equal in id and text).

    Equal texts are one class, so null texts are too; texts without a word are only alike if equal.  Ids may repeat or be null: ``class_id`` is the lowest that is not,
    null if none is.  Case of A-Z and white space do not count in shingles.  Columns of ``docs`` named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("class_id", "class_key", "text_key", "class_first")]
    own = F.col(text).cast("string")
    key = F.coalesce(F.xxhash64(own), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), own.alias("text"))
    weights = slot_weights(docs, own)
    texts = stored(signatures(rows, weights).groupBy("key").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(
        F.xxhash64(i, F.slice("sig", i * ROWS + 1, ROWS)).alias("bucket"),
        F.array(*[F.element_at("sig", (i * ROWS + ROWS + r) % SAMPLES + 1) for r in range(ROUNDS - 1)]).alias("extra")))
    buckets = stored(texts.where(F.col("sig").isNotNull()).select("key", F.inline(band)))
    links, tested, roots = None, None, None
    for round_ in range(ROUNDS):
        pairs = _candidates(buckets, roots, round_)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        scored = stored(_verify(stored(pairs), rows, texts, weights))
        new = scored.where(F.col("similarity") >= threshold).select("a", "b")
        links = new if links is None else links.unionByName(new)
        tested = scored.select("a", "b") if tested is None else tested.unionByName(scored.select("a", "b"))
        if round_ == 0 or not new.isEmpty():
            roots = components(links)
    roots = components(links.unionByName(_rest(buckets, roots, rows, texts, weights, threshold)))
    classes = texts.join(roots, "key", "left").select("key", "id", F.coalesce("root", "key").alias("class_key"))
    lowest = classes.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    classes = stored(classes.select("key", "class_key").join(lowest, "class_key").select("key", "class_key", "first.id", F.col("first.key").alias("first_key")))
    return docs.select(F.struct(*keep).alias("kept"), F.col(id_col).alias("own_id"), key.alias("key")).join(classes, "key").select(
        "kept.*", F.col("id").alias("class_id"), "class_key", F.col("key").alias("text_key"), (F.col("own_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("first_key"))).alias("class_first"))


def _texts(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, text) of each row of ``wanted`` (key, id)."""
    one = F.col("r.key").eqNullSafe(F.col("w.key")) & F.col("r.id").eqNullSafe(F.col("w.id"))  # copies are told apart by id, so a hot text is not one task's
    return stored(rows.alias("r").join(wanted.alias("w"), one).select("r.key", "r.text").groupBy("key").agg(F.first("text").alias("text")))


def _rest(buckets: DataFrame, roots: DataFrame, rows: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) between different classes of one bucket, from all pairs of its texts that the rounds left in different classes."""
    placed = buckets.select("bucket", "key").distinct().join(roots, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("bucket")
    open_ = stored(placed.join(mixed, "bucket"))
    whole = _texts(open_.select("key").distinct().join(texts.select("key", "id"), "key"), rows)
    sizes = open_.join(whole.select("key", F.octet_length("text").cast("long").alias("bytes")), "key")
    cells = sizes.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("bytes") / CELL_BYTES), F.lit(1)).cast("int").alias("cells"))
    own = F.pmod(F.xxhash64("key", F.lit(9)), F.col("cells")).cast("int")
    dealt = open_.join(cells, "bucket").withColumn("cell", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select(F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "bucket", "key", "root", "cell").join(whole, "key")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, root, cell = (table.column(c).to_numpy() for c in ("key", "root", "cell"))
        a, b = cross_links(table.column("text").combine_chunks(), root, cell, weights, threshold)
        return pa.table({"a": np.maximum(key[a], key[b]), "b": np.minimum(key[a], key[b])})

    return stored(dealt.select("bucket", "i", "j", "key", "root", "cell", "text").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long"))


def cross_links(text: pa.Array, root: np.ndarray, cell: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a spanning set of the pairs that reach the threshold, are of different roots and, if there are two cells, of different cells."""
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    n = len(text)
    own = [(owner + part.start, value, count) for part, d, a in blocks(text, BLOCK) for owner, value, count in [shingles(d, a)]]
    owner, value, count = (np.concatenate(x) for x in zip(*own))
    total = np.bincount(owner, weigh(value, count, weights), n)
    # the least of two counts is the number of levels that both reach
    level = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    owner, value = np.repeat(owner, count), np.repeat(value, count)
    order = np.lexsort([level, value])
    owner, value, level = owner[order], value[order], level[order]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(level) != 0) | (value[1:] != value[:-1])])) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(value)))
    shared_by = size > 1
    column, owner = np.repeat(np.cumsum(shared_by) - 1, size)[np.repeat(shared_by, size)], owner[np.repeat(shared_by, size)]
    weight = weigh(value[start[shared_by]], np.ones(int(shared_by.sum()), np.int64), weights).astype(float)
    shared = np.zeros((n, n))
    for first in range(0, len(weight), _COLUMNS):
        low, high = np.searchsorted(column, [first, first + _COLUMNS])
        w = weight[first:first + _COLUMNS]
        has = np.zeros((n, len(w)))
        has[owner[low:high], column[low:high] - first] = np.sqrt(w)[column[low:high] - first]
        shared += has @ has.T
    every = total[:, None] + total - shared
    near = (shared >= (threshold - 1e-9) * every) & (every > 0) & (root[:, None] != root)
    if len(np.unique(cell)) > 1:
        near &= cell[:, None] != cell
    top = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    links = []
    for a, b in np.argwhere(np.triu(near, 1)).tolist():
        x, y = find(int(root[a])), find(int(root[b]))
        if x != y:
            top[max(x, y)] = min(x, y)
            links.append((a, b))
    out = np.array(links, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _verify(pairs: DataFrame, rows: DataFrame, texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """``pairs`` with the weighted Jaccard similarity of the two texts, read once for each key that occurs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", "id"), "key")
    whole = _texts(wanted, rows)
    both = pairs.join(whole.select(F.col("key").alias("b"), F.col("text").alias("right")), "b").join(whole.select(F.col("key").alias("a"), F.col("text").alias("left")), "a")

    def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {"similarity": similarity(batch.column(2), batch.column(3), weights)}

    return with_columns(both, {"similarity": T.DoubleType()}, run, ["a", "b"], ["left", "right"]).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
