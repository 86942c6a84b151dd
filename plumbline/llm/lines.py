"""Line dedup over three-line windows: of every run of three lines found more than once anywhere, the first stays.

A window is three consecutive lines that hold a word; blank lines between them belong to it.  Windows are hashed, their first
occurrences found by one aggregation, and the lines that later occurrences cover, merged where they overlap, are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

SPAN = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, text: Column, key: list[str], span: int = SPAN) -> DataFrame:
    """One row per window: ``key``, ``window`` (hash), ``first`` and ``last`` line."""
    worded = F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("at"), F.when(x.rlike(HAS_WORD), F.xxhash64(x)).alias("hash"))), lambda x: x["hash"].isNotNull())
    starts = F.when(F.size("w") >= span, F.sequence(F.lit(0), F.size("w") - span)).otherwise(F.array().cast("array<int>"))
    window = F.transform(starts, lambda i: F.struct(
        F.xxhash64(*[F.col("w")[i + j]["hash"] for j in range(span)]).alias("window"), F.col("w")[i]["at"].alias("first"), F.col("w")[i + (span - 1)]["at"].alias("last")))
    return docs.where(text.isNotNull()).select(*key, worded.alias("w")).select(*key, F.inline(window))


def drop_repeated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, span: int = SPAN) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all but the text) with ``n_lines``, ``n_removed`` and the cleaned text.

    First is the lowest id (null before all), then the lowest line.  A window that repeats inside one text counts like any other, so a line
    repeated in a block stays once or more.  Null texts have no lines and stay null, empty ones have one empty line; texts of fewer than
    three worded lines stay whole.  Rows equal in id and text count as one document and are cleaned alike.  Columns of ``docs`` named like the new ones are replaced.
    """
    made = ("n_lines", "n_removed", text)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    own = F.col(text).cast("string")
    rows = docs.select(F.struct(*keep).alias("kept"), own.alias("text"), F.col(id_col).alias("id"), F.xxhash64(own).alias("hash"))
    windows = stored(line_windows(rows, F.col("text"), ["id", "hash"], span))
    occurrence = F.struct("id", "hash", "first")
    origins = windows.groupBy("window").agg(F.count("*").alias("n"), F.min(occurrence).alias("origin")).where("n > 1").select("window", "origin")
    later = windows.join(origins, "window").where(~occurrence.eqNullSafe(F.col("origin")))
    covered = later.select("id", "hash", F.explode(F.sequence("first", "last")).alias("line")).groupBy("id", "hash").agg(F.collect_set("line").alias("gone"))
    joined = rows.alias("r").join(covered.alias("c"), F.col("r.hash").eqNullSafe(F.col("c.hash")) & F.col("r.id").eqNullSafe(F.col("c.id")), "left").select(
        "kept", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    lines = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return joined.withColumn("lines", lines).select("kept.*", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.size("gone").alias("n_removed"), F.when(
        F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")).alias(text))
