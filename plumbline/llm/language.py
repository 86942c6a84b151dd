"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword.  One binary classifier per bit weighs n-grams by the log ratio of their
frequency in the languages whose bit is 1 and in the others.  A text's margins (mean weight per bit) are decoded to the codeword of least loss, each bit
weighed by how often its classifier is right on that language; a small lead over the second codeword marks the answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import blocks, free, stored, with_columns

BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
#: languages a model may have; more are refused, as the model's size is their number times BUCKETS
MAX_LANGUAGES = 512
#: rows of each language that a model learns from, about
SAMPLE_ROWS = 4_000
ROWS = 64
BLOCK = 1 << 20
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    scale: float  # margins times scale are of size 2
    trust: np.ndarray  # languages x bits, rows add up to 1


def codewords(n: int) -> np.ndarray:
    """Codewords of -1 and 1: all distinct splits for up to five classes, else rows of a Hadamard matrix (half of all bits differ)."""
    if n <= 5:
        columns = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 1 << (n - 1))] if n > 1 else []
        return np.array(columns, np.int8).reshape(len(columns), n).T
    matrix = np.ones((1, 1), np.int8)
    while len(matrix) <= n:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    code = matrix[1:n + 1]
    return code[:, np.abs(code.sum(axis=0)) < n]


def letters(text: Column) -> Column:
    """Lower-case letters of a text, other runs as one space, a space at both ends; null without a letter."""
    only = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(F.length(only) > 0, F.concat(F.lit(" "), only, F.lit(" ")))


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: bucket of each n-gram and the number of its text."""
    wide = data.astype(np.uint32) + np.uint32(1)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for n in ORDERS:
        total = len(data) - n + 1
        if total <= 0:
            return
        h = np.full(total, n * 0x9E3779B9 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h += wide[j:j + total] * _FACTORS[j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
        inside = owner[:total] == owner[n - 1:]
        yield (h >> np.uint32(18))[inside].astype(np.int64), owner[:total][inside]


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams, texts x bits."""
    n = len(offsets) - 1
    out = np.zeros((n, weights.shape[1]))
    for start in range(0, n, ROWS):
        end = min(n, start + ROWS)
        counts = np.zeros((end - start) * BUCKETS)
        for bucket, owner in grams(data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]):
            counts += np.bincount(owner * BUCKETS + bucket, minlength=len(counts))
        counts = counts.reshape(end - start, BUCKETS)
        out[start:end] = (counts.astype(np.float32) @ weights) / np.maximum(counts.sum(axis=1), 1)[:, None]
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from about ``sample_rows`` rows of each language, drawn by a hash of the row: n-gram counts, then the trust in each bit.

    Rows without a text or a language teach nothing; repeated rows are drawn together; an empty table gives a model that knows no language.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0), np.float32), 1.0, np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample_rows / sizes[name]))])
    row = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    drawn = F.pmod(row, F.lit(1 << 30)) < F.element_at(share, F.col(lang).cast("string")) * (1 << 30)
    known = stored(labelled.where(drawn).select(F.col(lang).cast("string").alias("lang"), letters(F.col(text).cast("string")).alias("text")).where("text is not null"))
    number, n = {name: i for i, name in enumerate(languages)}, len(languages)
    code = codewords(n)
    if not code.size:
        return Model(languages, code.reshape(n, 0), np.zeros((BUCKETS, 0), np.float32), 1.0, np.zeros((n, 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * BUCKETS, np.int64)
        for batch in batches:
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for rows, data, at in blocks(batch.column(1), BLOCK):
                for bucket, owner in grams(data, at):
                    total += np.bincount(of[rows][owner] * BUCKETS + bucket, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    cells = known.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(n * BUCKETS)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"]
    frequency = counts.reshape(n, BUCKETS) + 0.5
    frequency /= frequency.sum(axis=1, keepdims=True)
    one, zero = (code > 0).T.astype(float), (code < 0).T.astype(float)
    ratio = np.log((one @ frequency) / one.sum(axis=1, keepdims=True)) - np.log((zero @ frequency) / zero.sum(axis=1, keepdims=True))
    model = Model(languages, code, np.clip(ratio, -4, 4).T.astype(np.float32), 1.0, np.ones(code.shape) / code.shape[1])
    seen = with_columns(known, {"m": T.ArrayType(T.DoubleType())}, lambda b: {"m": _margin_lists(b.column(b.num_columns - 1), model.weights)}, ["lang"], ["text"])
    bits = range(code.shape[1])
    rows = seen.groupBy("lang").agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col("m")[b])).alias(f"a{b}") for b in bits], *[F.avg((F.col("m")[b] > 0).cast("double")).alias(f"p{b}") for b in bits]).collect()
    right = np.ones(code.shape)
    for r in rows:
        i = number[r["lang"]]
        right[i] = [r[f"p{b}"] if code[i, b] > 0 else 1 - r[f"p{b}"] for b in bits]
    size = np.mean([[r[f"a{b}"] for b in bits] for r in rows]) if rows else 1.0
    right += 1e-6
    return Model(languages, code, model.weights, 2 / max(float(size), 1e-6), right / right.sum(axis=1, keepdims=True))


def _margin_lists(column: pa.Array, weights: np.ndarray) -> pa.Array:
    parts = [margins(data, at, weights) for _, data, at in blocks(column)]
    flat = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))


def decode(m: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Best language and probability of each language (softmax of the negative weighted losses)."""
    z = np.clip(m * model.scale, -4, 4)
    loss = np.stack([(np.exp(-z * c) * t).sum(axis=1) for c, t in zip(model.code, model.trust)], axis=1)
    p = np.exp(-2 * (loss - loss.min(axis=1, keepdims=True)))
    return loss.argmin(axis=1), p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, clear: float = 0.8) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` (score under ``clear``).

    A text that is null or has no letter gets ``und``, 0.0 and true, and so does every text if the model knows no language.  Whole texts
    are read, in pieces that fit in memory.  Columns of ``docs`` named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "ambiguous")]

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        column = batch.column(batch.num_columns - 1)
        known = ~column.is_null().to_numpy(zero_copy_only=False) & bool(model.languages)
        best, score = np.zeros(len(known), np.int64), np.ones(len(known))
        if len(model.languages) > 1:
            parts = [decode(margins(data, at, model.weights), model) for _, data, at in blocks(column)]
            best, score = np.concatenate([b for b, _ in parts]), np.concatenate([p.max(axis=1) for _, p in parts])
        names = [model.languages[b] if k else "und" for b, k in zip(best, known)]
        return {"lang_pred": names, "score": np.where(known, score, 0.0)}

    own = free(docs, "letters")
    named = docs.select(*keep, letters(F.col(text).cast("string")).alias(own))
    out = with_columns(named, {"lang_pred": T.StringType(), "score": T.DoubleType()}, run, keep, [own])
    return out.withColumn("ambiguous", F.col("score") < clear)
