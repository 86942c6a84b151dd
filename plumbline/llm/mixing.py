"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / source size times.  The whole part is taken as it is.  The fractions
are rounded by the pivotal method: two documents exchange words at random until one of them is taken whole or not at all, so
the words taken stay the same and each document keeps its expectation.  A source is dealt to groups of about ``GROUP_ROWS`` rows, in descending order
of size; each leaves one fractional document at most, and these meet in the next level of a reduction tree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.words import mix
from plumbline.operators.ordering import row_index, running_total

GROUP_ROWS = 2_000
WEIGHTS = (5, 2, 1)
TOP = 3
WORD = r"[^\x20\x09-\x0D]+"
_EDGE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, top: int = TOP) -> DataFrame:
    """One row per source: ``source_size`` and ``target``, which add up to all sizes; no target is above ``top`` times its size.

    Sources in order of their code points, null last, weigh ``weights``, repeating.  Filled by water level: in order of ``top`` x size / weight a source is
    cut off while its share of what is left is above that.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # sources may be as many as rows: ranks and running totals are range-partitioned
    ranked = row_index(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], name="rank").drop("last")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    limit = F.col("source_size") * top
    level = ranked.withColumns({"weight": weight, "limit": limit}).withColumn("level", F.col("limit") / F.col("weight"))
    level = running_total(level, ["level", "rank"], F.col("limit"), before="limits", total="all_limits")
    level = stored(running_total(level, ["level", "rank"], F.col("weight"), before="weights", total="heavy"))
    left, share = F.col("all_limits") / top - F.col("limits"), F.col("heavy") - F.col("weights")
    cut = level.withColumn("cut", F.col("weight") * left > F.col("limit") * share)
    rest = cut.agg((F.sum("source_size") - F.sum(F.when(F.col("cut"), F.col("limit")).otherwise(0))).alias("free"),
                   F.sum(F.when(F.col("cut"), 0).otherwise(F.col("weight"))).alias("heavy")).select(F.col("free") / F.nullif("heavy", F.lit(0))).scalar()
    return cut.withColumn("target", F.when(F.col("cut"), F.col("limit").cast("double")).otherwise(F.col("weight") * rest)).select(
        "source", "source_size", "source_rows", "target")


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Sequential pivotal rounding of fractions ``p`` of documents of ``size`` words; all but one at most come out as 0 or 1.

    What two documents exchange are words, so the words taken stay the same, and each keeps its expected fraction.
    """
    out, words = p.astype(float).tolist(), size.astype(float).tolist()
    at = None  # the one that carries a fraction
    for j, x in enumerate(out):
        if x < _EDGE or x > 1 - _EDGE or not words[j]:
            out[j] = float(x > 0.5)
            continue
        if at is None:
            at = j
            continue
        a, b = out[at] * words[at], x * words[j]
        first, second = min(words[at], a + b), min(words[j], a + b)  # most that each can hold
        low = a + b - second
        a = first if draws[j] * (first - low) < a - low else low
        b = out[at] * words[at] + b - a
        out[at], out[j] = a / words[at], b / words[j]
        for i in (at, j):
            if out[i] < _EDGE or out[i] > 1 - _EDGE:
                out[i] = float(out[i] > 0.5)
        at = next((i for i in (at, j) if 0 < out[i] < 1), None)
    return np.array(out)


def _draws(n: int, *key: object) -> np.ndarray:
    salt = np.uint64(int(pd.util.hash_array(np.array([repr(key)], object))[0]))
    return (mix(np.arange(n, dtype=np.uint64) + salt) >> np.uint64(11)) / float(1 << 53)


def _group_rounder(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["size", "tie", "more_tie"], ascending=[False, True, True], ignore_index=True)
        draws = _draws(len(p), seed, level, p["place"][0], int(p["group"][0]))
        done = pivot(p["fraction"].to_numpy(), p["size"].to_numpy(), draws)
        return p.assign(fraction=np.round(done) if last else done)  # at last one document of the source is left: the nearer
    return run


def round_fractions(units: DataFrame, parts: int, seed: int, group_rows: int) -> DataFrame:
    """``units`` (place, part, tie, more_tie, size, fraction) with every fraction rounded to 0 or 1, the words of each place kept up to one document."""
    schema = "place string, part long, group long, tie long, more_tie long, size long, fraction double"
    done, level, width = [], 0, parts
    rest = units
    while True:
        reach = 1 if level == 0 else group_rows ** level
        width, last = -(-parts // reach), -(-parts // reach) <= 1
        out = stored(rest.select("place", "part", F.floor(F.col("part") / reach).alias("group"), "tie", "more_tie", "size", "fraction").groupBy("place", "group").applyInPandas(
            _group_rounder(seed, level, last), schema)).drop("group")
        open_ = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        done.append(out.where(~open_))
        if last:
            break
        rest, level = out.where(open_), level + 1
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return done[0]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, top: int = TOP, seed: int = 11, text: str = "text", source: str = "source",
                id_col: str = "doc_id", keep: list[str] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` is how often the mix takes the row, 0 to ``top``.  Null texts have size 0, a null source is a source of its own, an empty table gives an empty
    table.  Rows equal in id, text and source are one unit: of the copies that all of them are wanted, the whole part is taken exactly and the rest is rounded.  The same
    rows give the same copies in any order and partitioning (equal ones in the order they are stored).  Columns of ``docs`` named like the new ones are replaced.
    """
    made = ("size", "source_size", "target", "copies")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    place = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    own = [F.col(id_col), F.col(text), F.col(source)]
    flags = [c.isNull() for c in own]  # a hash passes over nulls
    key = {"place": place, "tie": F.xxhash64(*own, *flags), "more_tie": F.xxhash64(F.lit("more"), *flags, *own)}
    unit = list(key)
    units = stored(docs.select(*[v.alias(k) for k, v in key.items()], word_count(F.col(text).cast("string")).alias("size")).groupBy(*unit).agg(
        F.max("size").alias("size"), F.count("*").alias("n")))
    by_source = units.select(F.when(F.col("place") != "null", F.substr("place", F.lit(2))).alias("source"), (F.col("size") * F.col("n")).alias("size"), "n")
    sources = stored(source_targets(by_source, weights, top).withColumn("place", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + _EDGE)
    largest = sources.agg(F.max("source_rows")).first()[0] or 0
    parts = max(1, -(-largest // group_rows))  # of the largest source; smaller ones have fewer
    deal = F.greatest(F.ceil(F.col("source_rows") / group_rows), F.lit(1))
    placed = units.join(sources, "place").withColumn("extra", F.greatest((wanted - whole) * F.col("n"), F.lit(0.0)))
    chosen = round_fractions(placed.select("place", F.pmod("tie", deal).alias("part"), "tie", "more_tie", "size", (F.col("extra") - F.floor(F.col("extra") + _EDGE)).alias("fraction")),
                             parts, seed, group_rows).select(*unit, F.col("fraction").cast("int").alias("one_more"))
    taken = stored(placed.join(chosen, unit).select(*unit, "size", "n", "source_size", "target", whole.cast("int").alias("whole"),
                                                    (F.floor(F.col("extra") + _EDGE) + F.col("one_more")).alias("more")))
    rows = docs.select(F.struct(*keep).alias("kept"), *[v.alias(k) for k, v in key.items()])
    single = rows.join(taken.where("n = 1"), unit).withColumn("before", F.lit(0).cast("long"))
    # a table of its own, so the planner knows how small it is and need not shuffle the rows again
    repeated = stored(rows.join(stored(taken.where("n > 1")), unit).withColumn("at", F.monotonically_increasing_id()))
    numbered = running_total(repeated, ["at"], F.lit(1).cast("long"), unit, before="before").drop("at")
    return single.unionByName(numbered).select("kept.*", "size", "source_size", "target", (F.col("whole") + (F.col("before") < F.col("more")).cast("int")).alias("copies"))
