"""Katz backoff of any order (three by default): discounted counts, exactly normalised backoff weights, in tables partitioned by hash.

Texts are cut into blocks.  A block sends the distinct words it holds, packed, to the buckets of the word table, and gets back one code per word that carries its training
count.  Then, order by order, it sends its distinct n-grams whose context and whose tail (the n-gram without its first word) training holds to the buckets of that
order's table, chosen by the context, and gets back each count, those seen once too.  For the contexts of held-out texts it also gets the sums that the backoff weight is made of.
A token's probability is the longest n-gram's discounted share if training has it, else its context's backoff weight times the probability in the
next shorter context, and so on down to words never seen.  The first word of a text follows the end of another; longer contexts do not reach beyond that end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import blocks, free, stored
from plumbline.llm.words import find_words, mix, span_hashes
from plumbline.session import brief_shuffles, drop, table_path

ORDER = 3
#: counts above this are not discounted
TRUSTED = 5
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
END = np.uint64(0x0123456789ABCDEF)
_BITS = 57
MESSAGE = "block long, bucket int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; small numbers of a wide type cost little."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return head + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, as unsigned integers of their width."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    shape = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    raw = zstandard.ZstdDecompressor().decompress(data[8 + 16 * n:])
    out, at = [], 0
    for width, length in shape.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * length, at).reshape(width, length).T).view(f"<u{width}").reshape(length))
        at += width * length
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, the first from 0."""
    return np.diff(x, prepend=x.dtype.type(0))


def pack_grams(words: list[np.ndarray], *others: np.ndarray) -> bytes:
    """Rows sorted by their last word, then by the one before it: differences of both, then the rest."""
    *rest, second, last = words
    new = np.diff(last, prepend=np.uint64(0)) != 0  # no code or number is 0
    return pack(steps(last), np.where(new, second, steps(second)), *rest, *others)


def unpack_grams(payload: bytes, n: int) -> list[np.ndarray]:
    """The words in their order, then the other columns."""
    last, second, *others = unpack(payload)
    start = np.flatnonzero(last)
    running = np.cumsum(second)
    second = running - np.repeat(running[start] - second[start], np.diff(np.append(start, len(last))))
    return [*others[:n - 2], second, np.cumsum(last), *others[n - 2:]]


def number_rows(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one row of each distinct key, in the order of the keys, and the number of each row's key."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits < 64:  # sorting numbers that carry their place is faster
        both = np.sort(key << bits | np.arange(len(key)))
        order, ranked = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key)
        ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def word_codes(count: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Distinct codes that carry the counts: bit length, count, and a number.  0: never seen.

    Numbers differ between all words and are small for frequent ones, as a word is numbered by its rank in its bucket: of r words seen c times or more, c * r is at most the
    number of tokens, so count and number fit.
    """
    code = np.zeros(len(count), np.uint64)
    many = np.flatnonzero(count > 0)
    order = many[np.argsort(-count[many], kind="stable")]
    c = count[order].astype(np.uint64)
    length = np.frexp(c.astype(float))[1].astype(np.uint64)
    code[order] = length << np.uint64(_BITS) | c << (np.uint64(_BITS) - length) | (np.arange(len(c)) * buckets + bucket).astype(np.uint64)
    return code


def code_counts(code: np.ndarray) -> np.ndarray:
    length = code >> np.uint64(_BITS)
    body = code & np.uint64((1 << _BITS) - 1)
    return np.where(length > 0, body >> (np.uint64(_BITS) - np.maximum(length, 1)), 0).astype(np.int64)


def code_numbers(code: np.ndarray) -> np.ndarray:
    """The words' numbers, from 1.  0: never seen."""
    length = code >> np.uint64(_BITS)
    below = (np.uint64(1) << (np.uint64(_BITS) - np.maximum(length, np.uint64(1)))) - np.uint64(1)
    return np.where(length > 0, (code & below) + np.uint64(1), np.uint64(0))


@dataclass
class Discounts:
    """Good-Turing discounts of the counts 1 to TRUSTED (index 0 unused); a ratio that the data do not support is 1."""

    share: np.ndarray

    @staticmethod
    def of(n: np.ndarray) -> "Discounts":
        """``n[r]``: how many things were seen r times, r up to TRUSTED + 1."""
        share = np.ones(TRUSTED + 1)
        top = (TRUSTED + 1) * n[TRUSTED + 1] / n[1] if n[1] else 1.0
        for r in range(1, TRUSTED + 1):
            if n[r] and n[r + 1] and top < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top)
                share[r] = d if 0 < d < 1 else 1.0
        return Discounts(share)

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count <= TRUSTED, self.share[np.minimum(count, TRUSTED)], 1.0) * count


@dataclass
class Unigrams:
    tokens: int
    words: int
    discounts: Discounts
    total: float  # what counts are divided by
    unseen: float  # probability of each word never seen

    @staticmethod
    def of(counts: np.ndarray, number: np.ndarray) -> "Unigrams":
        tokens, words = int((counts * number).sum()), int(number[counts > 0].sum())
        n = np.array([number[counts == r].sum() for r in range(TRUSTED + 2)])
        discounts = Discounts.of(n)
        left = tokens - float((discounts(counts) * number).sum())
        total = float(tokens) if left > 1e-9 else tokens + 1.0  # with nothing left, one unseen word more is taken as seen
        return Unigrams(tokens, words, discounts, total, max(left, 1.0 if left <= 1e-9 else 0.0) / total / max(1, int(n[1])))

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounts(count) / self.total, self.unseen)


@dataclass
class Block:
    """Texts as numbers of their distinct words (sorted by hash); every text ends with the end token."""

    length: np.ndarray  # tokens of each text
    train: np.ndarray
    token: np.ndarray


def make_block(data: np.ndarray, at: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Distinct word hashes, their training counts, and the packed ``Block``."""
    parts, counts = [], []
    for rows in _slices(at, 4 << 20):
        piece, offsets = data[at[rows.start]:at[rows.stop]], at[rows.start:rows.stop + 1] - at[rows.start]
        w = find_words(piece, offsets)
        parts.append(np.insert(span_hashes(piece, w.start, w.end, fold_case=True), w.at[1:], END))
        counts.append(w.counts() + 1)
    length = np.concatenate(counts)
    hashes, token = np.unique(np.concatenate(parts), return_inverse=True)
    seen = np.bincount(token, np.repeat(train, length), len(hashes)).astype(np.uint32)
    often = np.argsort(-np.bincount(token, minlength=len(hashes)), kind="stable")  # frequent words get small numbers, which pack well
    number = np.empty(len(hashes), np.uint32)
    number[often] = np.arange(len(hashes), dtype=np.uint32)
    return hashes, seen, pack(length.astype(np.uint32), train.astype(np.uint8), number[token], often.astype(np.uint32))


def read_block(payload: bytes) -> Block:
    length, train, token, often = unpack(payload)
    return Block(length.astype(np.int64), train.astype(bool), often.astype(np.int64)[token])


def _slices(at: np.ndarray, limit: int) -> Iterator[slice]:
    start = 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield slice(start, end)
        start = end


def _cut(docs: DataFrame, buckets: int, keep: list[str]) -> DataFrame:
    """Rows of kind ``block`` (payload and the kept columns of its texts) and ``words`` (a bucket's part of its distinct words and counts)."""
    kept = T.ArrayType(T.StructType([docs.schema[c] for c in keep]))
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()),
                           T.StructField("payload", T.BinaryType()), T.StructField("kept", kept)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            train = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            for rows, data, at in blocks(batch.column(len(keep)), BLOCK_BYTES):
                hashes, seen, payload = make_block(data, at, train[rows])
                of = (hashes >> np.uint64(32)).astype(np.int64) * buckets >> 32
                edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
                messages = [(int(of[a]), pack(steps(hashes[a:b]), seen[a:b])) for a, b in zip(edges[:-1], edges[1:])]
                values = pa.StructArray.from_arrays([batch.column(i)[rows] for i in range(len(keep))], fields=list(arrow.field("kept").type.value_type))
                n = len(messages)
                offsets = pa.array(np.array([0, len(values), *[len(values)] * n], np.int32), mask=np.array([False, *[True] * n, False]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(["block", *["words"] * n]), pa.array([block] * (n + 1)), pa.array([-1, *(m[0] for m in messages)], pa.int32()),
                    pa.array([payload, *(m[1] for m in messages)], pa.binary()), pa.ListArray.from_arrays(offsets, values).cast(arrow.field("kept").type)], schema=arrow)
                block += 1

    return docs.mapInArrow(run, schema)


def _message(rows: list[tuple[str, int, int, bytes]]) -> pa.Table:
    kind, block, bucket, payload = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.string()), "block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _count_words(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """One bucket of the word table: ``answer`` to each block, ``totals`` (how many words have which count)."""

    def run(table: pa.Table) -> pa.Table:
        bucket, sent = table.column("bucket")[0].as_py(), [unpack(p) for p in table.column("payload").to_pylist()]
        words, place = np.unique(np.concatenate([np.cumsum(h) for h, _ in sent]), return_inverse=True)
        count = np.bincount(place, np.concatenate([n for _, n in sent])).astype(np.int64)
        code = word_codes(count, bucket, buckets)
        ends = np.cumsum([len(h) for h, _ in sent])
        rows = [("answer", block, bucket, pack(code[place[e - len(h):e]])) for block, e, (h, _) in zip(table.column("block").to_pylist(), ends, sent)]
        value, number = np.unique(count, return_counts=True)
        return _message([*rows, ("totals", -1, bucket, pack(value.astype(np.uint64), number.astype(np.uint64)))])

    return run


def _shares(count: np.ndarray, buckets: int, hot: float) -> np.ndarray:
    """In how many buckets the n-grams of a context lie."""
    return np.clip(np.ceil(count / max(hot, 1.0)), 1, buckets).astype(np.int64)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = mix(columns[0])
    for c in columns[1:]:
        h = mix(h * np.uint64(3) + c)
    return h


@dataclass
class Sent:
    """What a block sends for one order: distinct n-grams (``of`` gives each token's, -1 for none) and contexts whose sums it asks for, both by bucket."""

    context: np.ndarray  # of each token, -1 for none
    context_count: np.ndarray
    of: np.ndarray
    owner: np.ndarray  # context of each n-gram
    grams: list[np.ndarray]  # numbers of the words (code of a pair's second), training count, count of the tail
    gram_bucket: np.ndarray
    gram_order: np.ndarray
    asked: np.ndarray
    asks: list[np.ndarray]  # numbers of the words
    ask_bucket: np.ndarray

    def messages(self) -> Iterator[tuple[int, bytes]]:
        for bucket in np.union1d(self.gram_bucket, self.ask_bucket).tolist():
            a, b = np.searchsorted(self.gram_bucket, [bucket, bucket + 1])
            c, d = np.searchsorted(self.ask_bucket, [bucket, bucket + 1])
            grams, n = [x[a:b] for x in self.grams], len(self.asks) + 1
            yield bucket, pack_grams(grams[:n], *grams[n:], *(x[c:d] for x in self.asks))


@dataclass
class Walk:
    """The tokens of a block, order by order: number and training count of each one's n-gram, what that count is divided by, log10 of its probability."""

    block: Block
    code: np.ndarray  # of the block's words, in the order of their hashes
    unigrams: Unigrams
    buckets: int
    hot: float
    order: int = 1
    word: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        numbers = code_numbers(self.code)
        by_number = np.argsort(numbers, kind="stable")
        place = np.empty(len(self.code), np.int64)
        place[by_number] = np.arange(len(self.code))
        self.codes, self.numbers, self.word = self.code[by_number], numbers[by_number], place[self.block.token]
        self.counts = code_counts(self.codes)
        length = self.block.length
        self.starts = np.cumsum(length) - length
        self.end = self.word[self.starts[0] + length[0] - 1]
        self.within = np.arange(len(self.word)) - np.repeat(self.starts, length)
        self.held = np.repeat(~self.block.train, length)
        self.gram, self.count, self.total = self.word, self.counts[self.word], np.full(len(self.word), self.unigrams.total)
        self.value = np.log10(self.unigrams.probability(self.counts))[self.word] if self.unigrams.tokens else np.zeros(len(self.word))

    def _place(self, token: np.ndarray, n: int) -> np.ndarray:
        """Number of the word ``n`` before each of the tokens; before a text stands an end."""
        if n == 0:
            return self.word[token]
        return np.where(self.within[token] >= n, self.word[np.maximum(token - n, 0)], self.end)

    def back(self, token: np.ndarray, n: int) -> np.ndarray:
        return self.numbers[self._place(token, n)]

    def sent(self) -> Sent:
        """For n-grams of one word more than now."""
        n = self.order
        context, context_count = np.full(len(self.word), -1), np.zeros(len(self.word), np.int64)
        context[1:], context_count[1:] = self.gram[:-1], self.count[:-1]
        if n == 1:
            context[self.starts], context_count[self.starts] = self.end, self.counts[self.end]
        else:
            context_count[self.within < n - 1] = 0
        context[context_count == 0] = -1
        used = np.flatnonzero((context >= 0) & (self.count > 0))
        first, number = number_rows(self.gram[used] * len(self.codes) + self._place(used, n))
        of = np.full(len(self.word), -1)
        of[used] = number
        token = used[first]
        shares = _shares(context_count, self.buckets, self.hot)
        grams = [self.back(token, i) for i in range(n, -1, -1)]
        if n == 1:  # the bucket needs the count of the second word
            grams[1] = self.codes[self.word[token]]
        bucket = self._bucket(grams[:-1], (mix(grams[-1]) >> np.uint64(33)).astype(np.int64) % shares[token])
        counts = [np.bincount(number, ~self.held[used], len(first)).astype(np.uint32)]
        tails = [self.count[token].astype(np.uint64)] if n > 1 else []
        order = self._by_bucket(bucket)
        # sums are needed where a token may be unseen, and to know what is left where several buckets hold a context
        wanted = np.flatnonzero((context >= 0) & (self.held | (shares > 1)))
        one, _ = number_rows(context[wanted])
        asked = context[wanted[one]]
        times = shares[wanted[one]]
        ask, asked = np.repeat(wanted[one], times), np.repeat(asked, times)
        asks = [self.back(ask, i) for i in range(n, 0, -1)]
        where = self._bucket(asks, np.arange(len(ask)) - np.repeat(np.cumsum(times) - times, times))
        place = self._by_bucket(where)
        return Sent(context, context_count, of, context[token], [x[order] for x in [*grams, *counts, *tails]], bucket[order], order,
                    asked[place], [x[place] for x in asks], where[place])

    def _bucket(self, context: list[np.ndarray], share: np.ndarray) -> np.ndarray:
        return ((_hash(context) >> np.uint64(33)).astype(np.int64) + share) % self.buckets

    def _by_bucket(self, bucket: np.ndarray) -> np.ndarray:
        return np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")  # numbers of 16 bits need no comparisons

    def take(self, sent: Sent, answers: list[bytes], discounts: Discounts) -> None:
        """One order more, by the answers of the buckets in their order."""
        parts = [unpack(p) for p in answers]
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(TRUSTED + 3)]
        count = np.zeros(len(sent.owner), np.int64)
        count[sent.gram_order] = columns[0] >> np.uint64(TRUSTED)
        contexts = int(sent.context.max(initial=-1)) + 1
        seen = np.zeros(contexts, np.int64)  # which small counts a context has, as bits
        seen[sent.owner[sent.gram_order]] = columns[0] & np.uint64((1 << TRUSTED) - 1)
        sums = [np.bincount(sent.asked, c.astype(float), contexts) for c in columns[1:-1]]
        shared = np.bincount(sent.asked, columns[-1].view(np.float64), contexts)
        seen[sent.asked] = sum((sums[r] > 0)[sent.asked].astype(np.int64) << r for r in range(TRUSTED))
        left = sum(1 << (r - 1) for r in range(1, TRUSTED + 1) if discounts.share[r] < 1)
        have = np.flatnonzero(sent.context >= 0)
        shorter = self.total if self.order > 1 else np.ones(len(self.word))  # all tails of a context have the same total; words come as probabilities
        total = sent.context_count.astype(float)
        total[have] += (seen[sent.context[have]] & left) == 0  # with nothing left, one n-gram more is taken as seen
        self.count = np.where(sent.of >= 0, count[sent.of], 0) if len(count) else np.zeros(len(self.word), np.int64)
        self.gram, self.total = sent.of, total
        known = np.flatnonzero(self.count)
        lost = have[self.count[have] == 0]
        used = sum(discounts.share[r] * r * sums[r - 1] for r in range(1, TRUSTED + 1)) + sums[TRUSTED]
        c = sent.context[lost]
        self.value[lost] += np.log10((total[lost] - used[c]) / total[lost] / np.maximum(1 - shared[c] / shorter[lost], 1e-12))
        self.value[known] = np.log10(discounts(self.count[known]) / total[known])
        self.order += 1


def _walk(block: pa.Table, answers: pa.Table, unigrams: Unigrams, discounts: list[Discounts], buckets: int, hot: float) -> Walk:
    """A block's tokens after the orders whose discounts are known; ``about`` is the order that an answer is of."""
    rows = sorted(zip(answers.column("about").to_pylist(), answers.column("bucket").to_pylist(), answers.column("payload").to_pylist()))
    walk = Walk(read_block(block.column("payload")[0].as_py()), np.concatenate([unpack(p)[0] for n, _, p in rows if n == 1]), unigrams, buckets, hot)
    for n, d in enumerate(discounts, 2):
        walk.take(walk.sent(), [p for m, _, p in rows if m == n], d)
    return walk


def _send(unigrams: Unigrams, discounts: list[Discounts], buckets: int, hot: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        name = block.column("block")[0].as_py()
        return _message([("grams", name, bucket, p) for bucket, p in _walk(block, answers, unigrams, discounts, buckets, hot).sent().messages()])

    return run


def _edges(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _by_columns(columns: list[np.ndarray]) -> np.ndarray:
    """Places of the rows in order, the first column first."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 64:
        return np.lexsort(columns[::-1])
    key = columns[0]
    for c, b in zip(columns[1:], bits[1:]):
        key = key << np.uint64(b) | c
    return np.argsort(key)


def _count_grams(n: int, unigrams: Unigrams, tail: Discounts | None) -> Callable[[pa.Table], pa.Table]:
    """One bucket of the table of n-grams: ``answer`` to each block (counts with the small counts of the context as bits; sums of the contexts asked for) and ``totals``."""

    def run(table: pa.Table) -> pa.Table:
        bucket, names = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
        width = n + 1 + (n > 2)
        sent = [unpack_grams(p, n) for p in table.column("payload").to_pylist()]
        columns = [np.concatenate([s[i] for s in sent]) for i in range(width)]
        order = _by_columns([*columns[:n - 1], columns[n - 1] if n > 2 else code_numbers(columns[1])])
        words = [c[order] for c in columns[:n]]
        start = _edges(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        c = np.add.reduceat(columns[n][order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        words = [x[start] for x in words]
        if n > 2:
            low = tail(columns[n + 1][order][start].astype(np.int64))
        else:
            low = unigrams.probability(code_counts(words[1]))
        runs = _edges(words[:-1])
        add = lambda x: np.append(np.add.reduceat(x, runs) if len(runs) else x[:0], x.dtype.type(0))  # noqa: E731  # the last place is for contexts without n-grams here
        sums = [add((c == r).astype(np.uint32)) for r in range(1, TRUSTED + 1)]
        seen = sum((x > 0).astype(np.uint64) << np.uint64(r) for r, x in enumerate(sums))
        sums += [add(np.where(c > TRUSTED, c, 0).astype(np.uint64)), add(np.where(c > 0, low, 0.0)).view(np.uint64)]
        answer = c.astype(np.uint64) << np.uint64(TRUSTED) | np.repeat(seen[:-1], np.diff(np.append(runs, len(c))))
        hashes = _hash([x[runs] for x in words[:-1]])
        by_hash = np.append(np.argsort(hashes), len(runs))
        hashes = hashes[by_hash[:-1]]
        rows, at = [], 0
        for name, s in zip(names, sent):
            mine = place[at:at + len(s[0])]
            at += len(s[0])
            asked = _hash([x.astype(np.uint64) for x in s[width:]])
            found = np.searchsorted(hashes, asked)
            found[found < len(hashes)] = np.where(hashes[found[found < len(hashes)]] == asked[found < len(hashes)], found[found < len(hashes)], len(hashes))
            rows.append(("answer", name, bucket, pack(answer[mine], *(x[by_hash[found]] for x in sums))))
        number = np.array([0, *((c == r).sum() for r in range(1, TRUSTED + 2))], np.uint64)
        return _message([*rows, ("totals", -1, bucket, pack(number))])

    return run


def _score(unigrams: Unigrams, discounts: list[Discounts], buckets: int, hot: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        walk = _walk(block, answers, unigrams, discounts, buckets, hot)
        base = np.log10((walk.counts + 1) / (unigrams.tokens + unigrams.words + 1))[walk.word]
        known = (walk.counts > 0)[walk.word].astype(np.int64)
        kept = block.column("kept").combine_chunks().flatten()
        return pa.table([*kept.flatten(), pa.array(walk.block.length), *(pa.array(x) for x in (
            np.add.reduceat(known, walk.starts), np.full(len(walk.starts), unigrams.tokens), np.add.reduceat(base, walk.starts), np.add.reduceat(walk.value, walk.starts)))], schema=schema)

    return run


def score(docs: DataFrame, train: Column, text: str = "text", keep: list[str] | None = None, order: int = ORDER) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    The model, of n-grams up to ``order`` words, learns from the rows where ``train`` holds.  Tokens are words with A-Z in lower case, then one end.  Null and empty texts are an end alone.  Nothing learned: all scores are 0.
    Repeated rows count as often as they occur.  Columns of ``docs`` named like the new ones are replaced.  Memory follows the longest text.
    """
    made = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    own = free(docs, "own_text")
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(own), F.coalesce(train, F.lit(False)).alias(free(docs, "own_train")))
    size = rows.agg(F.sum(F.octet_length(own))).first()[0] or 0
    buckets = max(1, -(-int(size) // BUCKET_BYTES))
    spark, path = docs.sparkSession, table_path(docs.sparkSession)
    cut = stored(_cut(rows, buckets, keep), "kind", path=path)
    texts, schema = cut.where("kind = 'block'"), "kind string, " + MESSAGE
    with brief_shuffles(spark):
        words = stored(cut.where("kind = 'words'").select("block", "bucket", "payload").groupBy("bucket").applyInArrow(_count_words(buckets), schema), "kind")
    drop(spark, f"{path}/kind=words")
    totals = [unpack(r[0]) for r in words.where("kind = 'totals'").select("payload").collect()]
    counts, number = (np.concatenate([t[i] for t in totals]).astype(np.int64) if totals else np.zeros(0, np.int64) for i in (0, 1))
    unigrams = Unigrams.of(counts, number)
    hot = unigrams.tokens / (64 * buckets ** 0.5)  # so many n-grams of one context share a bucket
    answers = words.where("kind = 'answer'").select("block", "bucket", "payload", F.lit(1).alias("about"))
    discounts: list[Discounts] = []
    for n in range(2, order + 1):
        sent = texts.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send(unigrams, list(discounts), buckets, hot), schema)
        with brief_shuffles(spark):
            grams = stored(sent.select("block", "bucket", "payload").groupBy("bucket").applyInArrow(_count_grams(n, unigrams, discounts[-1] if discounts else None), schema), "kind")
        number = sum((unpack(r[0])[0].astype(np.int64) for r in grams.where("kind = 'totals'").select("payload").toLocalIterator()), np.zeros(TRUSTED + 2, np.int64))
        discounts.append(Discounts.of(number))
        answers = answers.unionByName(grams.where("kind = 'answer'").select("block", "bucket", "payload", F.lit(n).alias("about")))
    out = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, t) for c, t in made.items())])
    return texts.select("block", "payload", "kept").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(unigrams, discounts, buckets, hot, to_arrow_schema(out)), out)
