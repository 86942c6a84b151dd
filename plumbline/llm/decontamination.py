"""Benchmark decontamination: rare seeds find where a text may hold a test item, alignment scores how much of it.

Test items are few beside the corpus; they are taken in blocks of bounded size, each against all texts.  Seeds are word n-grams of an item that some text holds: of ``GRAM`` words
those that are rare in the corpus, and of common ones the rarest of ``SPREAD`` neighbours; of ``PAIR`` words the rare ones, which count only where ``PAIRS`` of them lie
on one stretch of a text, as in a copy with every third word changed.  Around a seed the item is aligned
to the text by Smith-Waterman over words; the score is the share of what a verbatim copy reaches, so changed, lost and added words lower it gradually.
Characters of scripts without spaces are words of their own, two of them as long as one word.  Shorter items are found where a text holds them whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import blocks, with_columns
from plumbline.llm.words import Words, find_words, span_hashes, windows

GRAM, SPREAD = 3, 2
PAIR, PAIRS = 2, 3
#: an n-gram is rare up to this many occurrences, or this share of all words of the corpus
RARE, RARE_SHARE = 100, 1e-6
#: items of fewer words are too short to align: only a whole copy tells from chance
LEAST_WORDS = 8
MATCH, MISS, GAP = 2, -1, 1
THRESHOLD = 0.5
#: bytes of item text in one block
ITEM_BYTES = 8 << 20
_FILTER = 1 << 20
_CELLS = 1 << 21
#: first two bytes of characters of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, CJK and its later planes
_SINGLE = np.zeros(1 << 16, bool)
for _low, _high in ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE2BA, 0xE384), (0xE386, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBD, 0xEFBE), (0xF0A0, 0xF0B3)):
    _SINGLE[_low:_high + 1] = True


def find_units(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, of which characters of scripts without spaces are split off; the number of the word each lies in; whether it is such a character."""
    w = find_words(data, offsets)
    lead = np.flatnonzero(data[:-1] >= 0xE0)
    lead = lead[_SINGLE[data[lead].astype(np.int64) << 8 | data[lead + 1]]]
    if not len(lead):
        return w, np.arange(len(w)), np.zeros(len(w), bool)
    after = lead + np.where(data[lead] >= 0xF0, 4, 3)
    after = after[after < w.end[np.searchsorted(w.start, lead, "right") - 1]]
    start = np.unique(np.concatenate([w.start, lead, after]))
    word = np.searchsorted(w.start, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data)), w.end[word])
    return Words(start, end, np.searchsorted(start, offsets)), word, np.isin(start, lead)


@dataclass
class Items:
    names: list[object]
    words: np.ndarray  # hashes of all items' words
    at: np.ndarray
    gram: np.ndarray  # sorted hashes of n-grams, with the item and the word each starts at
    item: np.ndarray
    place: np.ndarray
    pair: np.ndarray  # whether the n-gram has PAIR words
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: sorted hashes of whole items, and the items

    def __post_init__(self) -> None:
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self.gram & np.uint64(_FILTER - 1)] = True

    @staticmethod
    def index(names: list[object], texts: list[str], short: bool = False) -> "Items":
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
        w, _, single = find_units(data, offsets)
        hashes = span_hashes(data, w.start, w.end, fold_case=True)
        grams, firsts = zip(*(windows(hashes, w.at, n) for n in (GRAM, PAIR)))
        gram, first, pair = np.concatenate(grams), np.concatenate(firsts), np.repeat([False, True], [len(g) for g in grams])
        item = w.owner()[first] if len(first) else first
        large = 2 * w.counts() - np.bincount(w.owner(), single, len(texts)) >= 2 * LEAST_WORDS
        enough = large[item]
        gram, first, item, pair = gram[enough], first[enough], item[enough], pair[enough]
        order = np.argsort(gram, kind="stable")
        whole = {}
        for n in np.unique(w.counts()[~large]).tolist() if short else []:
            if n:
                value, at = windows(hashes, w.at, n)
                own = w.owner()[at]
                fits = (w.counts()[own] == n) & ~large[own]
                by = np.argsort(value[fits], kind="stable")
                whole[n] = value[fits][by], own[fits][by]
        return Items(names, hashes, w.at, gram[order], item[order], (first - w.at[item])[order], pair[order], whole)

    def seeds(self, seen: np.ndarray, words: int) -> "Items":
        """The n-grams worth looking for, where ``seen`` counts each of ``gram`` in a corpus of ``words`` words; what no text holds finds nothing and is left out."""
        rare = (seen > 0) & (seen <= max(RARE, RARE_SHARE * words))
        # common ones compete with their common neighbours alone: a rarer neighbour may be one that edits left behind elsewhere
        common = np.flatnonzero((seen > 0) & ~rare & ~self.pair)
        common = common[np.lexsort([self.place[common], self.item[common]])]
        stay = np.zeros(len(common), bool)
        if len(common):
            window = np.arange(SPREAD)
            run = np.minimum(np.arange(len(common))[:, None] + window, len(common) - 1)
            near = (self.item[common[run]] == self.item[common][:, None]) & (self.place[common[run]] - self.place[common][:, None] == window)
            count = np.where(near, seen[common[run]], np.iinfo(np.int64).max)
            stay[run[np.arange(len(common)), count.argmin(axis=1)]] = True
        kept = rare
        kept[common[stay]] = True
        return Items(self.names, self.words, self.at, self.gram[kept], self.item[kept], self.place[kept], self.pair[kept], self.short)

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``gram``, entry of the index) of equal n-grams."""
        at = np.flatnonzero(self.filter[gram & np.uint64(_FILTER - 1)])
        found, entry = _equal(gram[at], self.gram)
        return at[found], entry

    def whole(self, words: np.ndarray, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last word) of the first whole copy of each short item in each text."""
        for n, (value, item) in self.short.items():
            run, first = windows(words, w.at, n)
            found, entry = _equal(run, value)
            text, which, at = w.owner()[first[found]], item[entry], first[found]
            order = np.lexsort([at, which, text])
            text, which, at = text[order], which[order], at[order]
            new = np.ones(len(text), bool)
            new[1:] = (np.diff(text) != 0) | (np.diff(which) != 0)
            for t, i, b in zip(text[new].tolist(), which[new].tolist(), at[new].tolist()):
                yield t, i, b, b + n - 1


def _equal(values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in ``values``, position in the sorted ``index``) of equal numbers."""
    low, high = np.searchsorted(index, values, "left"), np.searchsorted(index, values, "right")
    n = high - low
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(values)), n), np.repeat(low, n) + within


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row of ``items`` with the same row of ``texts`` and the text position where it ends.

    Rows are filled up with numbers that are equal to nothing.  Gaps cost the same for each word, so a row of the matrix is a running maximum.
    """
    n, width = texts.shape
    slope = GAP * np.arange(width, dtype=np.int32)
    row, best, end = np.zeros((n, width), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        step = np.where(texts == items[:, i:i + 1], np.int32(MATCH), np.int32(MISS))
        step[:, 1:] += row[:, :-1]
        np.maximum(step, row - GAP, out=step)
        np.maximum(step, 0, out=step)
        step += slope
        row = np.maximum.accumulate(step, axis=1) - slope
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def _padded(words: np.ndarray, start: np.ndarray, length: np.ndarray, fill: int, backwards: bool) -> np.ndarray:
    column = np.arange(int(length.max()))
    inside = column < length[:, None]
    index = start[:, None] + (length[:, None] - 1 - column if backwards else column)
    return np.where(inside, words[np.where(inside, index, 0)], np.uint64(fill))


def find(data: np.ndarray, offsets: np.ndarray, items: Items, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first and last word in the text) of the best place of each item in each text."""
    w, word, _ = find_units(data, offsets)
    words = span_hashes(data, w.start, w.end, fold_case=True)
    best: dict[tuple[int, int], tuple[float, int, int]] = {(t, i): (1.0, b, e) for t, i, b, e in items.whole(words, w)}
    gram, first = _grams(words, w)
    at, entry = items.hits(gram)
    if len(at):
        best |= _aligned(w, words, first, at, entry, items, threshold)
    for (t, i), (s, b, e) in sorted(best.items()):
        yield t, i, s, int(word[b] - word[w.at[t]]), int(word[e] - word[w.at[t]])


def _grams(words: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of both lengths, and the number of the first word of each."""
    grams, firsts = zip(*(windows(words, w.at, n) for n in (GRAM, PAIR)))
    return np.concatenate(grams), np.concatenate(firsts)


def _aligned(w: Words, words: np.ndarray, first: np.ndarray, at: np.ndarray, entry: np.ndarray, items: Items, threshold: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """Score and place of the best alignment of each item that has a seed in a text, by (text, item)."""
    text, item = w.owner()[first[at]], items.item[entry]
    size = np.diff(items.at)[item]
    begin = first[at] - items.place[entry]  # where the item would begin
    place, pair = items.place[entry], items.pair[entry]
    order = np.lexsort([begin, item, text])
    text, item, size, begin, place, pair = text[order], item[order], size[order], begin[order], place[order], pair[order]
    # seeds of one text and item whose beginnings lie within the item's length share a place, counted on a fixed grid
    cell = np.floor_divide(begin, size)
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(cell) != 0)
    group = np.flatnonzero(new)
    last = np.append(group[1:], len(text)) - 1
    # pairs of words alone count where PAIRS different ones lie within a quarter of the item's length of each other's diagonal, here or across the edge of the grid
    number = np.repeat(np.arange(len(group)), last + 1 - group)
    longer = np.bincount(number, ~pair, len(group)) > 0
    several = np.zeros(len(text), bool)
    if len(text) >= PAIRS:
        a, b = np.arange(len(text) - PAIRS + 1), np.arange(PAIRS - 1, len(text))
        near = (text[a] == text[b]) & (item[a] == item[b]) & (begin[b] - begin[a] <= size[a] // 4) & (place[a] != place[b])
        for k in range(PAIRS):
            several[a[near] + k] = True
    worth = longer | (np.bincount(number, several, len(group)) > 0)
    group, last = group[worth], last[worth]
    if not len(group):
        return {}
    text, item, size = text[group], item[group], size[group]
    low = np.maximum(begin[group] - size // 2, w.at[text])
    high = np.minimum(begin[last] + size + size // 2, w.at[text + 1])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    by_size = np.argsort(size, kind="stable")
    start = 0
    while start < len(by_size):
        rows = by_size[start:start + max(1, _CELLS // (4 * int(size[by_size[min(len(by_size) - 1, start + 2000)]])))][:2000]
        start += len(rows)
        score, end = align(_padded(items.words, items.at[item[rows]], size[rows], 1, False), _padded(words, low[rows], high[rows] - low[rows], 2, False))
        share = score / (MATCH * size[rows])
        good = share >= threshold
        rows, share, end = rows[good], share[good], low[rows[good]] + end[good]
        if not len(rows):
            continue
        _, back = align(_padded(items.words, items.at[item[rows]], size[rows], 1, True), _padded(words, low[rows], end + 1 - low[rows], 2, True))
        for r, s, e, b in zip(rows, share, end, end - back):
            key = int(text[r]), int(item[r])
            if key not in best or s > best[key][0]:
                best[key] = float(s), int(b), int(e)
    return best


def _count_seen(texts: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How often each of the index's n-grams occurs in all ``texts`` (one column), and how many words they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(len(items.gram), np.int64), 0
        for batch in batches:
            for _, data, at in blocks(batch.column(0)):
                w = find_units(data, at)[0]
                _, entry = items.hits(_grams(span_hashes(data, w.start, w.end, fold_case=True), w)[0])
                total += np.bincount(entry, minlength=len(total))
                words += len(w)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], words))], names=["entry", "n"])

    out, words = np.zeros(len(items.gram), np.int64), 0
    rows = texts.mapInArrow(run, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).toPandas()
    found = rows["entry"].to_numpy(np.int64) >= 0
    out[rows["entry"].to_numpy(np.int64)[found]] = rows["n"][found]
    return out, int(rows["n"][~found].sum())


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
          threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES, short: bool = False) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``leaks``: the items the text holds, an array of (item_id, score, first_word, last_word).

    Null and empty texts hold nothing; null items, items without a word and null ids of items are never found; items under ``LEAST_WORDS`` words are found if ``short``,
    where a text holds all of their words in a row; repeated rows and items are treated one by one.  Whole texts are searched.  A column of ``docs`` named ``leaks`` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "leaks"]
    out = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("__text"))
    texts = docs.select(F.col(text).cast("string"))
    kind = benchmark.schema[item_id].dataType
    found = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.IntegerType()),
                                      T.StructField("last_word", T.IntegerType())]))
    tests = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text"))
    parts = max(1, -(-int(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    names = []
    for part in range(parts):
        mine = tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).orderBy("id", "text").collect()
        items = Items.index([r[0] for r in mine], [r[1] for r in mine], short)
        items = items.seeds(*_count_seen(texts, items))
        names.append(f"__leaks{part}")
        out = with_columns(out, {names[-1]: found}, _searcher(items, threshold, found, names[-1]), out.columns, ["__text"])
    return out.select("kept.*", F.flatten(F.array(*names)).alias("leaks"))


def _searcher(items: Items, threshold: float, kind: T.ArrayType, name: str) -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
    arrow = to_arrow_type(kind)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(batch.schema.get_field_index("__text"))
        rows: list[list[dict[str, object]]] = [[] for _ in range(batch.num_rows)]
        for part, data, at in blocks(column):
            for t, i, score, begin, end in find(data, at, items, threshold):
                rows[part.start + t].append({"item_id": items.names[i], "score": score, "first_word": begin, "last_word": end})
        return {name: pa.array(rows, type=arrow)}

    return run
