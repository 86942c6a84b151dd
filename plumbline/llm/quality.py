"""Quality classifier by compression: a text is good if a dictionary of good text compresses it better than one of bad text.

Two zstandard dictionaries are built from labelled text.  A text is compressed with both, in pieces of ``PIECE`` bytes so that it is the dictionary
that explains them and not the text itself.  The difference of the two sizes over the length, shrunk a little for short
texts, becomes a probability by a rising curve fitted on labelled rows, measured with dictionaries that have not seen them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import blocks, free, stored, with_columns

#: labelled rows per class in each of the two halves of the sample, about
SAMPLE_ROWS = 2_000
#: a sampled text gives the dictionary this many excerpts of EXCERPT characters, evenly spread
EXCERPTS, EXCERPT = 8, 1_024
DICTIONARY_BYTES = 112 << 10
PIECE, LEVEL = 256, 3
LEVEL_ROWS = 8
SHRINK = 64


@dataclass
class Model:
    good: bytes
    bad: bytes
    raw: bool  # the dictionaries are plain text
    at: np.ndarray  # knots of the curve: difference
    share: np.ndarray  # and probability


def _build(samples: list[bytes]) -> bytes:
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def _dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes, bool]:
    try:
        return _build(good), _build(bad), False
    except zstandard.ZstdError:  # too few samples for its statistics: the text itself is the dictionary
        return b"".join(good)[-DICTIONARY_BYTES:], b"".join(bad)[-DICTIONARY_BYTES:], True


class Sizes:
    """Normalised size differences; one per task."""

    def __init__(self, model: Model):
        kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
        self.good, self.bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False,
                                                        write_checksum=False, write_dict_id=False).compress for d in (model.good, model.bad))

    def difference(self, text: memoryview) -> float:
        pieces = [text[i:i + PIECE] for i in range(0, len(text), PIECE)]
        return sum(len(self.bad(p)) - len(self.good(p)) for p in pieces) / (len(text) + SHRINK)


def _differences(docs: DataFrame, model: Model, keep: list[str], text: str, name: str, then: Callable[[np.ndarray], np.ndarray] = lambda d: d) -> DataFrame:
    """``keep`` columns and ``name``, what ``then`` makes of the differences of the column ``text``."""
    made: list[Sizes] = []

    def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        if not model.good or not model.bad:
            return {name: then(np.zeros(batch.num_rows))}
        if not made:
            made.append(Sizes(model))
        out = []
        for _, data, at in blocks(batch.column(batch.num_columns - 1)):
            whole = memoryview(data.tobytes())
            out += [made[0].difference(whole[a:b]) for a, b in zip(at[:-1], at[1:])]
        return {name: then(np.array(out, float))}

    return with_columns(docs, {name: T.DoubleType()}, run, keep, [text])


def fit_curve(d: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to the labels (pool adjacent violators), from the mean of each level to the next.

    Every level's share is drawn a little to one half, so no score is sure; a level has ``LEVEL_ROWS`` rows at least.
    """
    order = np.argsort(d, kind="stable")
    levels: list[list[float]] = []  # weight, weight of good, sum of weight x d, rows
    for x, w, y in zip(d[order], weight[order], good[order]):
        levels.append([w, w * y, w * x, 1])
        while len(levels) > 1 and (levels[-2][1] * levels[-1][0] >= levels[-1][1] * levels[-2][0] or levels[-2][3] < LEVEL_ROWS):
            last = levels.pop()
            levels[-1] = [a + b for a, b in zip(levels[-1], last)]
    unit = float(weight.mean())
    return np.array([s / w for w, _, s, _ in levels]), np.array([(g + unit / 2) / (w + unit) for w, g, _, _ in levels])


def probability(d: np.ndarray, model: Model) -> np.ndarray:
    """The curve at ``d``; a fiftieth of it is a plain sigmoid, so that a larger difference always scores higher."""
    width = max(float(np.ptp(model.at)) / 4, 1e-6)
    slope = 1 / (1 + np.exp(-np.clip((d - model.at.mean()) / width, -30, 30)))
    return 0.98 * np.interp(d, model.at, model.share) + 0.02 * slope


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks 1 (good) or 0.

    Of each class about twice ``sample_rows`` rows, by hash of the id, build the dictionaries; for the curve, each half of them is measured with dictionaries of the other.  An id labelled
    more than once counts as its lowest label; null ids and labels teach nothing.  With one class only, or none, the model gives every text the share of good labels.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).alias("__label"))
    size = {r["__label"]: r["count"] for r in marked.groupBy("__label").count().collect()}
    share = F.when(F.col("__label") == 1, min(1.0, 2 * sample_rows / size.get(1, 1))).otherwise(min(1.0, 2 * sample_rows / size.get(0, 1)))
    draw = F.crc32(F.concat(F.lit("quality-"), F.col("__id").cast("string")).cast("binary")) / float(1 << 32)
    chosen = marked.where(draw < share).select("__id", "__label", (draw < share / 2).alias("__half"))
    # about 4 x sample_rows rows of three numbers
    rows = stored(docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id"))
    step = F.greatest(F.ceil(F.length("__text") / EXCERPTS), F.lit(EXCERPT))
    excerpts = F.transform(F.sequence(F.lit(0), F.lit(EXCERPTS - 1)), lambda i: F.substr("__text", (i * step + 1).cast("int"), F.lit(EXCERPT)))
    sample: dict[tuple[bool, int], list[bytes]] = {(half, c): [] for half in (False, True) for c in (0, 1)}
    for r in rows.select("__id", "__label", "__half", excerpts.alias("parts")).orderBy("__id", "parts").toLocalIterator():
        sample[r["__half"], r["__label"]] += [p.encode() for p in r["parts"] if p]
    good, bad = (sample[False, c] + sample[True, c] for c in (1, 0))
    prior = np.zeros(1), np.array([(size.get(1, 0) + 1) / (size.get(1, 0) + size.get(0, 0) + 2)])
    if not good or not bad:
        return Model(b"", b"", True, *prior)
    model = Model(*_dictionaries(sample[False, 1] or good, sample[False, 0] or bad), *prior)  # as large as those that the curve is fitted with
    seen = []  # each half is measured with the dictionaries of the other
    for half in (False, True):
        if sample[half, 0] and sample[half, 1]:
            other = Model(*_dictionaries(sample[half, 1], sample[half, 0]), *prior)
            seen.append(_differences(rows.where(F.col("__half") != half), other, ["__label"], "__text", "__d").toPandas())
    if not sum(map(len, seen)):
        return model
    held = pd.concat(seen)
    good = held["__label"].to_numpy() == 1
    # the two classes were sampled at different rates; weights restore their true shares
    weight = np.where(good, *(max(1.0, size[c] / (2 * sample_rows)) for c in (1, 0)))
    order = np.lexsort([good, held["__d"]])
    at, shares = fit_curve(held["__d"].to_numpy(float)[order], good[order], weight[order])
    return Model(model.good, model.bad, model.raw, at, shares)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``score`` (0 to 1, higher: better) and ``predicted`` (1 if score >= ``threshold``).

    Whole texts are compressed.  Null and empty texts have no difference and get the curve's value at 0.  Columns of ``docs``
    named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    own = free(docs, "own_text")
    out = _differences(docs.select(*keep, F.col(text).cast("string").alias(own)), model, keep, own, "score", lambda d: probability(d, model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
