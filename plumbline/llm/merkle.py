"""Merkle manifest of a table: every row a leaf, one tree per group, one tree over the groups.

A leaf's place is its rank among the ids of its group.  The ids of a group are a sparse bitmap: one 64-bit mask per word of 64
neighbouring ids, empty words left out, masks of all tasks merged by OR.  Counts per word and offsets of chunks of words make the
directory, so a rank is one look-up and one popcount and no leaf is sorted.  Blocks of ``RUN ** LEVELS`` places
then climb ``LEVELS`` levels at once in arrays keyed by place, and the way back hands each leaf the siblings on its path.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import fold, stored
from plumbline.operators.ordering import row_index, running_total

#: children of a node
RUN = 8
#: levels that one shuffle climbs; a task holds ``RUN ** LEVELS`` digests of one block
LEVELS = 4
#: words of one chunk of the directory, as a power of two
CHUNK = 10
#: rows equal in every field are numbered in pieces of so many
PIECE = 4096
#: no id lies in this word; rows without an id come first
NO_ID = -(1 << 62)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sized(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(sized, fields)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels between ``leaves`` leaves and their root."""
    levels = 0
    while RUN ** levels < leaves:
        levels += 1
    return levels


def directory(ids: DataFrame) -> DataFrame:
    """Merged bitmaps of ``ids`` (tree, id) with their popcount directory: tree, word, ``mask``, ``n`` rows, rows ``before`` the word, ``leaves`` of the tree."""
    bit = F.expr("shiftleft(1L, cast(id & 63 AS int))")
    words = stored(ids.select("tree", word_of("id").alias("word"), bit.alias("bit")).groupBy("tree", "word").agg(
        F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("mask"), F.count("*").alias("n")).withColumn("chunk", F.shiftright("word", CHUNK)))
    chunks = running_total(words.groupBy("tree", "chunk").agg(F.sum("n").alias("rows")), ["chunk"], F.col("rows"), ["tree"], before="offset", total="leaves")
    earlier = Window.partitionBy("tree", "chunk").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    inside = words.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return inside.join(chunks, ["tree", "chunk"]).select("tree", "word", "mask", "n", (F.col("offset") + F.col("inside")).alias("before"), "leaves")


def word_of(id_col: str) -> Column:
    return F.coalesce(F.shiftright(id_col, 6), F.lit(NO_ID))


def place(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, id, leaf, shown) with ``slot``, their rank by id in their tree, and ``leaves`` of the tree.

    Rows that share an id follow each other by leaf; they, and rows without an id, are the only ones that are ordered.
    """
    ranked = stored(leaves.withColumn("word", word_of("id")).join(directory(leaves.select("tree", "id")), ["tree", "word"]))
    below = F.expr("bit_count(mask & ~shiftleft(-1L, cast(id & 63 AS int)))")
    once = F.col("n") == F.bit_count("mask")
    simple = ranked.where(once).select("tree", "leaves", "id", "leaf", "shown", (F.col("before") + below).alias("slot"))
    equal = ranked.where(~once).groupBy("tree", "word", "leaves", "before", "id", "leaf", "shown").agg(F.count("*").alias("copies"))
    ordered = running_total(equal, ["id", "leaf"], F.col("copies"), ["tree", "word"], before="earlier")
    pieces = ordered.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE)))).repartition("tree", "word", "id", "leaf", "piece")
    numbers = F.sequence(F.col("piece") * PIECE, F.least("copies", (F.col("piece") + 1) * PIECE) - 1)
    repeated = pieces.withColumn("copy", F.explode(numbers)).select("tree", "leaves", "id", "leaf", "shown", (F.col("before") + F.col("earlier") + F.col("copy")).alias("slot"))
    return simple.unionByName(repeated)


def _levels(table: pa.Table, step: int) -> tuple[list[int], list[list[str]]]:
    """Places within the block of the rows of ``table``, and the digests of each level that this step climbs."""
    at = [s % RUN ** LEVELS for s in table["slot"].to_pylist()]
    nodes = [""] * len(at)
    for i, d in zip(at, table["digest"].to_pylist()):
        nodes[i] = d
    levels = [nodes]
    for _ in range(max(0, min(LEVELS, height(table["leaves"][0].as_py()) - LEVELS * step))):
        nodes = [digest("".join(nodes[i:i + RUN])) for i in range(0, len(nodes), RUN)]
        levels.append(nodes)
    return at, levels


def _climber(step: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        _, levels = _levels(table, step)
        return pa.table({"tree": [table["tree"][0].as_py()], "slot": pa.array([table["slot"][0].as_py() // RUN ** LEVELS]), "leaves": pa.array([table["leaves"][0].as_py()]),
                         "digest": levels[-1]})
    return run


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of every ``LEVELS``-th level of all trees: ``nodes`` (tree, slot, leaves, digest) first, one node a tree last."""
    steps = [nodes]
    most = nodes.agg(F.max("leaves")).first()[0] or 1
    while len(steps) == 1 or RUN ** (LEVELS * (len(steps) - 1)) < most:
        blocks = steps[-1].select("tree", "slot", "leaves", "digest").groupBy("tree", F.floor(F.col("slot") / RUN ** LEVELS))
        steps.append(stored(blocks.applyInArrow(_climber(len(steps) - 1), "tree string, slot long, leaves long, digest string")))
    return steps


PATH = "tree string, slot long, before array<string>, after array<string>, subroot string, root string"


def _paths(table: pa.Table, above: pa.Table, step: int) -> tuple[list[list[str]], list[list[str]]]:
    """Per row the siblings left and right of its path, level by level up to the root."""
    at, levels = _levels(table, step)
    up = above["before"][0].as_py(), above["after"][0].as_py()
    before, after = [], []
    for i in at:
        left, right = [], []
        for nodes in levels[:-1]:
            i, k = divmod(i, RUN)
            left.append("".join(nodes[i * RUN:i * RUN + k]))
            right.append("".join(nodes[i * RUN + k + 1:(i + 1) * RUN]))
        before.append(left + up[0])
        after.append(right + up[1])
    return before, after


def _spreader(step: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        before, after = _paths(table, above, step)
        n, strings = len(before), pa.list_(pa.string())
        return pa.table({"tree": table["tree"], "slot": table["slot"], "before": pa.array(before, strings), "after": pa.array(after, strings),
                         "subroot": pa.array(above["subroot"].to_pylist() * n, pa.string()), "root": pa.array(above["root"].to_pylist() * n, pa.string())})
    return run


def _prover(table: pa.Table, above: pa.Table) -> pa.Table:
    before, after = _paths(table, above, 0)
    proofs, folded = [], []
    for left, right, node in zip(before, after, table["shown"].to_pylist()):
        proofs.append(digest("".join(x for pair in zip(left, right) for x in pair)))
        for x, y in zip(left, right):
            node = digest(x + node + y)
        folded.append(node)
    n = len(proofs)
    return pa.table({"id": table["id"], "slot": table["slot"], "leaf": table["digest"], "subroot": pa.array(above["subroot"].to_pylist() * n, pa.string()),
                     "root": pa.array(above["root"].to_pylist() * n, pa.string()), "proof_sha256": proofs, "folded_root": folded})


def _in_blocks(nodes: DataFrame, paths: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    block = F.floor(F.col("slot") / RUN ** LEVELS)
    return nodes.groupBy("tree", block).cogroup(paths.groupBy("tree", F.col("slot"))).applyInArrow(fn, schema)


def descend(steps: list[DataFrame], tops: DataFrame, least: int) -> DataFrame:
    """Paths of the nodes of ``steps[least]``; ``tops`` holds those of the trees' own roots."""
    paths = tops
    for step in reversed(range(least, len(steps) - 1)):
        paths = stored(_in_blocks(steps[step], paths, _spreader(step), PATH))
    return paths


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group: str = "lang", shown: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``slot``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``.

    A leaf is the sha256 of ``fields``; ``shown`` is the leaf that a holder of the row presents (default the true one), and ``folded_root`` what
    it and the row's siblings add up to.  Other columns of ``docs`` are left out.  Nulls are values of their own: rows without an id are the first of their group, rows
    without a group the first group.  Rows that share an id follow each other by leaf; rows equal in all fields are leaves of their own.  Empty and very long texts are
    hashed whole.  An empty table gives an empty manifest.  Ids are 64-bit integers of any sign and density.
    """
    own = leaf_hash(*map(F.col, fields))
    leaves = stored(docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"), F.col(id_col).cast("long").alias("id"),
                                own.alias("leaf"), (own if shown is None else shown).alias("shown")))
    placed = stored(place(leaves))
    steps = climb(placed.select("tree", "id", "shown", "slot", "leaves", F.col("leaf").alias("digest")))
    groups = steps[-1].select(F.col("tree").alias("of"), F.col("digest").alias("subroot"))
    n = groups.agg(F.count("*")).scalar()
    ranked = stored(row_index(groups, ["of"], name="slot").select(F.lit("").alias("tree"), "slot", n.alias("leaves"), F.col("subroot").alias("digest"), "of"))
    over = climb(ranked)
    none = F.array().cast("array<string>")
    top = over[-1].select("tree", "slot", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    found = descend(over, top, 0).join(ranked.select("slot", "of", "digest"), "slot")
    tops = found.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("slot"), "before", "after", F.col("digest").alias("subroot"), "root")
    return _in_blocks(steps[0], descend(steps, tops, 1), _prover, "id long, slot long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def verify(docs: DataFrame, tampered: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The manifest of ``docs`` with ``verified``: whether a copy whose A-Z are lower-cased wherever ``tampered`` divides crc32 of the id still proves each row.

    Rows without an id, and texts that are null, stay as they are.
    """
    changed = leaf_hash(*[lower_ascii(F.col(c)) if c == text else F.col(c) for c in FIELDS])
    shown = F.when(fold(id_col, tampered) == 0, changed).otherwise(leaf_hash(*map(F.col, FIELDS)))
    return manifest(docs, id_col=id_col, shown=shown).withColumn("verified", F.col("folded_root") == F.col("root"))
