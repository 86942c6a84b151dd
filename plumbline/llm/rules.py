"""Quality rules: text statistics and a decision list learned from them by sequential covering.

A rule is a conjunction of thresholds on statistics.  It is grown on one part of the labelled rows, one condition at a time by information
gain, pruned from its end on the other part, and accepted if it is precise enough there; the rows it covers are set aside and the next
rule is grown.  The list becomes one ordered ``CASE WHEN`` of Spark columns: the first rule that holds decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import blocks, free, stored, with_columns
from plumbline.llm.words import find_words, mix, span_hashes, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: labelled rows that a list is learned from, about; a fixed share by hash of the id
SAMPLE_ROWS = 40_000


def _within(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each hash occurs in its text, and the distinct (text, hash) each belongs to."""
    _, back, n = np.unique(mix(key + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    return n[back], back


def count_block(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    texts = len(at) - 1
    words = find_words(data, at)
    out = {"n_words": words.counts()}

    def per_text(mask: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(mask)])
        return running[at[1:]] - running[at[:-1]]

    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    out["word_chars"] = per_text(((data & 0xC0) != 0x80) & (np.cumsum(inside[:-1]) > 0))
    out["n_symbols"] = per_text(SYMBOLS[data])

    breaks = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[full], end[full]
    owner = np.searchsorted(at, start, "right") - 1
    _, group = _within(span_hashes(data, start, end), owner)
    first = np.unique(group, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(owner, minlength=texts) - np.bincount(owner[first], minlength=texts)

    window, first_word = windows(span_hashes(data, words.start, words.end), words.at, 3)
    of = words.owner()
    repeated = first_word[_within(window, of[first_word])[0] > 1]
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[repeated + j] = True
    out["n_repeat_words"] = np.bincount(of[covered], minlength=texts)
    return {k: v.astype(np.int64) for k, v in out.items()}


def text_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with the columns ``COUNTS`` of the whole text; a null or empty text has only zeros.

    Columns of ``docs`` named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]

    def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        parts = [count_block(data, at) for _, data, at in blocks(batch.column(batch.num_columns - 1))]
        return {c: np.concatenate([p[c] for p in parts]) for c in COUNTS}

    own = free(docs, "own_text")
    return with_columns(docs.select(*keep, F.col(text).cast("string").alias(own)), {c: T.LongType() for c in COUNTS}, run, keep, [own])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def features() -> dict[str, Column]:
    """What conditions may be about: counts that grow with the text are taken per word."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "chars_per_word": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words,
            "dup_lines": F.col("n_dup_lines").cast("double"), "repeat_share": F.col("n_repeat_words") / words}


@dataclass
class Rule:
    conditions: list[tuple[str, str, float]]

    def covers(self, x: pd.DataFrame) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, op, t in self.conditions:
            hit &= (x[name] >= t).to_numpy() if op == ">=" else (x[name] <= t).to_numpy()
        return hit


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def column(self, columns: dict[str, Column]) -> Column:
        """False where a rule holds, tested in order, else true."""
        verdict = F.lit(True)
        for rule in reversed(self.rules):
            hit = F.lit(True)
            for name, op, t in rule.conditions:
                hit = hit & (columns[name] >= t if op == ">=" else columns[name] <= t)
            verdict = F.when(hit, F.lit(False)).otherwise(verdict)
        return verdict

    def __str__(self) -> str:
        return "\n".join(f"WHEN {' AND '.join(f'{n} {o} {t:.6g}' for n, o, t in r.conditions)} THEN drop" for r in self.rules) + "\nELSE keep"


def _best_condition(x: pd.DataFrame, bad: np.ndarray, names: list[str], cuts: int) -> tuple[float, tuple[str, str, float]] | None:
    """The condition of the largest FOIL gain; ties go to the earlier name, then to the lower threshold."""
    p0, n0 = bad.sum(), (~bad).sum()
    prior, best = np.log2(p0 / (p0 + n0)), None
    for name in names:
        v = x[name].to_numpy()
        for t in np.unique(np.quantile(v[bad], np.linspace(0, 1, cuts))):
            for op, hit in ((">=", v >= t), ("<=", v <= t)):
                p, n = (hit & bad).sum(), (hit & ~bad).sum()
                gain = p * (np.log2(p / (p + n)) - prior) if p else -1.0
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, (name, op, float(t)))
    return best


def learn(x: pd.DataFrame, bad: np.ndarray, precision: float = 0.9, support: int = 5, cuts: int = 33, most: int = 16) -> DecisionList:
    """Grow, prune and collect rules for the rows marked ``bad``; every third row prunes.

    A rule needs ``support`` bad rows and the share ``precision`` of bad rows among those it covers, in both parts together and among the pruning rows.
    """
    names, rules = list(x.columns), []
    prune = np.arange(len(x)) % 3 == 2
    open_ = np.ones(len(x), bool)
    while len(rules) < most:
        grow = open_ & ~prune
        if not (grow & bad).any():
            break
        rule, rows = Rule([]), grow.copy()
        while (rows & bad).any() and (rows & ~bad).any() and len(rule.conditions) < 2 * len(names):
            found = _best_condition(x[rows], bad[rows], names, cuts)
            if found is None:
                break
            rule.conditions.append(found[1])
            rows = grow & rule.covers(x)
        if not rule.conditions:
            break

        def worth(k: int) -> float:
            hit = open_ & prune & Rule(rule.conditions[:k]).covers(x)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule.conditions = rule.conditions[:max(range(1, len(rule.conditions) + 1), key=lambda k: (worth(k), -k))]
        hit = open_ & rule.covers(x)
        if (hit & bad).sum() < support or (hit & bad).sum() < precision * hit.sum() or (worth(len(rule.conditions)) + 1) / 2 < precision:
            break
        rules.append(rule)
        open_ &= ~hit
    return DecisionList(rules)


def learn_from(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """A list from rows of ``counts`` that ``labels`` marks (0: bad), a sample of about ``sample_rows`` of them by hash of the id.

    An id labelled more than once counts as its lowest label; null ids and labels teach nothing; without labels the list is empty.
    """
    bad, own = free(counts, "label_"), free(counts, "id_")
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias(bad))
    share = min(1.0, sample_rows / max(1, labels.count()))
    marked = marked.where(F.crc32(F.concat(F.lit("rules-"), F.col(id_col).cast("string")).cast("binary")) < share * (1 << 32))
    rows = counts.join(marked, id_col).select(F.col(id_col).alias(own), (F.col(bad) == 0).alias("bad"), *[c.alias(n) for n, c in features().items()])
    sample = rows.where(~base_failed_features()).toPandas().sort_values([own, *features()], ignore_index=True)
    return learn(sample[list(features())], sample["bad"].to_numpy(bool))


def base_failed_features() -> Column:
    return (F.col("n_words") < 50) | (F.col("repeat_share") > 0.5)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text_counts`` of ``docs`` with ``base_failed`` and ``kept``: false if the base rules fail, else the verdict of a list learned from ``labels``.

    Null and empty texts fail the base rules, very long ones are counted whole, repeated rows are judged alike, an empty table gives an empty table.  Columns of ``docs`` named like
    the new ones are replaced.  The table of counts is stored once, so texts are read once.
    """
    counts = stored(text_counts(docs, text, keep))
    rules = learn_from(counts, labels, id_col, sample_rows=sample_rows)
    return counts.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & rules.column(features())})
