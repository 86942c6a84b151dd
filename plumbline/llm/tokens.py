"""Token counts under a byte-level BPE vocabulary, by rank-synchronous merging of numpy arrays.

The pre-tokens of a block of texts are held as one ragged array of symbols.  In each round every
sequence applies its own lowest-rank pair at all its places at once, until no sequence has a known pair; the surviving
symbols are the tokens.  Every merge makes a symbol of its own, so a pair with the new symbol always
has a higher rank, and the rounds give what merging one pair at a time gives.  Each distinct pre-token of a task is merged once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import blocks, free, with_columns

#: fixed value: how byte-level vocabularies split a text before the merges
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(np.iinfo(np.int32).max)
#: distinct pre-tokens a task remembers before it starts its memory anew
MEMORY = 400_000


@dataclass
class Vocabulary:
    byte_symbol: np.ndarray  # byte -> symbol
    pair: np.ndarray  # known pairs, first << 32 | second, sorted
    rank: np.ndarray  # of each known pair
    merged: np.ndarray  # rank -> symbol it makes
    added: list[str]  # strings that are one token wherever they stand

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """Read a ``tokenizers`` file; kinds of model that this method does not cover are refused."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE files are covered")
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first, second, made = (np.array([ids[s] for s in side], np.int64) for side in (*zip(*merges), [a + b for a, b in merges]))
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same symbol")
        key = first << 32 | second
        order = np.argsort(key)
        return Vocabulary(np.array([ids[c] for c in byte_letters()], np.int32), key[order], order.astype(np.int32), made.astype(np.int32),
                          sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True))

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first.astype(np.int64) << 32 | second
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NO_RANK)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next unused letter from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    unused = count(256)
    return [chr(b if b in prints else next(unused)) for b in range(256)]


def surviving(symbol: np.ndarray, length: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Number of symbols left of each sequence (none empty) after all merges."""
    out, name = length.copy(), np.arange(len(length))
    last = np.zeros(len(symbol), bool)
    last[np.cumsum(length) - 1] = True
    rank = np.full(len(symbol), NO_RANK, np.int32)
    inner = np.flatnonzero(~last)
    rank[inner] = vocabulary.ranks(symbol[inner], symbol[inner + 1])
    while len(name):
        low = np.minimum.reduceat(rank, np.cumsum(length) - length)
        live = low < NO_RANK
        if not live.all():
            out[name[~live]] = length[~live]
            stay = np.repeat(live, length)
            symbol, rank, last = symbol[stay], rank[stay], last[stay]
            name, length, low = name[live], length[live], low[live]
            if not len(name):
                break
        owner = np.repeat(np.arange(len(name)), length)
        hit = np.flatnonzero(rank == low[owner])
        new_run = np.ones(len(hit), bool)
        new_run[1:] = np.diff(hit) > 1
        hit = hit[(hit - np.maximum.accumulate(np.where(new_run, hit, 0))) % 2 == 0]  # aaa holds one aa
        symbol[hit] = vocabulary.merged[low[owner[hit]]]
        last[hit] = last[hit + 1]
        length = length - np.bincount(owner[hit], minlength=len(name))
        stay = np.ones(len(symbol), bool)
        stay[hit + 1] = False
        place = np.cumsum(stay)[hit] - 1
        symbol, rank, last = symbol[stay], rank[stay], last[stay]
        before = place[place > 0] - 1
        changed = np.concatenate([place, before[~last[before]]])
        ends = last[changed]
        rank[changed[ends]] = NO_RANK
        changed = changed[~ends]
        rank[changed] = vocabulary.ranks(symbol[changed], symbol[changed + 1])
    return out


class Counter:
    """Counts tokens of texts; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(SPLIT).findall
        self.added = regex.compile("|".join(map(regex.escape, vocabulary.added))) if vocabulary.added else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens = np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.number) > MEMORY:
            self.forget()
        number, seen = self.number, [np.zeros(0, np.int32)]
        pieces, extra = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            if self.added is not None and self.added.search(text):
                parts = self.added.split(text)
                extra[i] = len(parts) - 1
            for part in parts:
                found = self.split(part)
                seen.append(np.fromiter((number.setdefault(p, len(number)) for p in found), np.int32, len(found)))
                pieces[i] += len(found)
        fresh = list(number)[len(self.tokens):]
        if fresh:
            data = [p.encode() for p in fresh]
            length = np.fromiter(map(len, data), np.int64, len(data))
            symbol = self.vocabulary.byte_symbol[np.frombuffer(b"".join(data), np.uint8)]
            self.tokens = np.concatenate([self.tokens, surviving(symbol, length, self.vocabulary)])
        ends = np.cumsum(pieces)
        total = np.concatenate([[0], np.cumsum(self.tokens[np.concatenate(seen)])])
        return total[ends] - total[ends - pieces] + extra


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Counts are those of the ``tokenizers`` library without begin or end tokens; added strings inside a text are one token each.
    Null and empty texts have 0 bytes and 0 tokens.  Columns of ``docs`` named like the new ones are replaced.
    """
    vocabulary = Vocabulary.load(path)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens", "over_limit")]
    counters: list[Counter] = []

    def run(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        if not counters:
            counters.append(Counter(vocabulary))
        column = batch.column(batch.num_columns - 1)
        tokens = [counters[0].count([t or "" for t in column[rows].to_pylist()]) for rows, _, _ in blocks(column)]
        return {"n_tokens": np.concatenate(tokens)}

    own = free(docs, "own_text")
    named = docs.select(*keep, F.col(text).cast("string").alias(own))
    out = with_columns(named.withColumn("n_bytes", F.coalesce(F.octet_length(own), F.lit(0)).cast("long")), {"n_tokens": T.LongType()},
                       run, [*keep, "n_bytes"], [own])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
