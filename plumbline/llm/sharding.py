"""Sharding by Karmarkar-Karp differencing: equal texts stay together, bytes per shard come out nearly equal.

Groups of equal texts are dealt to buckets of about ``BUCKET_GROUPS``.  Each bucket starts with one partial
partition per group and repeatedly joins the two with the largest spread, the fullest slot of one
with the emptiest of the other, until one partial partition of ``shards`` slots is left.  The buckets'
partial partitions are joined in the same way, level by level, so no task holds more than
``BUCKET_GROUPS`` of them.  A group's shard is its slot followed through the levels.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import free, stored

BUCKET_GROUPS = 50_000
ROW_BYTES = 16
SLOT_ROWS = 100_000


def difference(loads: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions ``loads`` (n, k): for each its k slots' places in the joint partition.

    Ties are broken by position, so equal input gives equal output.
    """
    n, k = loads.shape
    order = np.argsort(-loads, axis=1, kind="stable")  # slots from fullest to emptiest
    sums = [row[o] for row, o in zip(loads, order)]
    heap = [(-(int(s[0]) - int(s[-1])), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    children: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joint = sums[a] + sums[b][::-1]
        place = np.argsort(-joint, kind="stable")
        sums[a] = sums[b] = None
        sums.append(joint[place])
        children.append((a, b, place))
        heapq.heappush(heap, (-(int(sums[-1][0]) - int(sums[-1][-1])), len(sums) - 1))
    # walk down: to[node][j] is the final place of the node's j-th fullest slot
    to: list[np.ndarray | None] = [None] * (n + len(children))
    to[-1] = np.arange(k)
    for node in range(n + len(children) - 1, n - 1, -1):
        a, b, place = children[node - n]
        before = np.empty(k, np.int64)
        before[place] = to[node]
        to[a], to[b], to[node] = before, before[::-1], None
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, order, np.array(to[:n]).reshape(n, k), axis=1)
    return out


def assign_shards(groups: DataFrame, shards: int, load: str = "bytes", key: str = "key", bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """``groups`` (one row per key) with the column ``shard``."""
    n = groups.count()
    buckets = max(1, -(-n // bucket_groups))
    first = stored(groups.select(key, load, F.pmod(F.xxhash64(F.lit(1), key), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInPandas(
        lambda p: _first_level(p, key, load, shards), f"{key} {groups.schema[key].dataType.simpleString()}, bucket long, slot int, loads array<long>"))
    moves = []  # per level: bucket, slot -> parent bucket, place
    level = first.where(F.col("loads").isNotNull()).select("bucket", "loads")
    width = buckets
    while True:
        fan = max(2, min(width, bucket_groups // shards))
        joined = stored(level.withColumn("parent", F.floor(F.col("bucket") / fan)).groupBy("parent").applyInPandas(
            lambda p: _next_level(p, shards), "bucket long, parent long, places array<int>, loads array<long>"))
        moves.append(joined.select("bucket", "parent", "places"))
        width = -(-width // fan)
        if width <= 1:
            break
        level = joined.where(F.col("loads").isNotNull()).select(F.col("parent").alias("bucket"), "loads")
    placed = first.select(key, "bucket", "slot")
    for m in moves:
        placed = placed.join(m, "bucket").select(key, F.col("parent").alias("bucket"), F.element_at("places", F.col("slot") + 1).alias("slot"))
    return placed.select(key, F.col("slot").alias("shard"))


def _first_level(p: pd.DataFrame, key: str, load: str, shards: int) -> pd.DataFrame:
    p = p.sort_values([load, key], ascending=[False, True], ignore_index=True)
    start = np.zeros((len(p), shards), np.int64)
    start[:, 0] = p[load]
    slot = difference(start)[:, 0]
    loads = np.bincount(slot, weights=p[load], minlength=shards).astype(np.int64)
    return pd.DataFrame({key: p[key], "bucket": p["bucket"], "slot": slot.astype(np.int32), "loads": [loads] + [None] * (len(p) - 1)})


def _next_level(p: pd.DataFrame, shards: int) -> pd.DataFrame:
    p = p.sort_values("bucket", ignore_index=True)
    loads = np.array(p["loads"].tolist(), np.int64).reshape(len(p), shards)
    places = difference(loads)
    total = np.zeros(shards, np.int64)
    for load, place in zip(loads, places):
        total[place] += load
    return pd.DataFrame({"bucket": p["bucket"], "parent": p["parent"], "places": list(places.astype(np.int32)), "loads": [total] + [None] * (len(p) - 1)})


def number_slots(df: DataFrame, shard: str, order: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``df`` with ``slot``: rows of a shard numbered from 0 without gaps, by parts of about ``slot_rows`` rows."""
    n = df.count()
    parts = max(1, -(-n // slot_rows))
    part, own, before_ = free(df, "own_part"), free(df, "own_number"), free(df, "own_before")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(F.lit(2), *order), F.lit(parts)))
    before = dealt.groupBy(shard, part).agg(F.count("*").alias(own)).select(
        shard, part, (F.sum(own).over(Window.partitionBy(shard).orderBy(part)) - F.col(own)).alias(before_))
    number = F.row_number().over(Window.partitionBy(shard, part).orderBy(*order)) - 1
    return dealt.withColumn(own, number).join(before, [shard, part]).withColumn(
        "slot", (F.col(own) + F.col(before_)).cast("long")).drop(part, own, before_)


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", bucket_groups: int = BUCKET_GROUPS,
                    keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``size``, ``text_crc32`` and ``shard``.

    Size is the UTF-8 bytes of the text plus 16.  Rows of equal text share a shard; a null text counts as empty.
    Repeated rows and null ids are rows like any other; an empty table gives an empty table.  Columns of
    ``docs`` named like the new ones are replaced.  A group larger than an even share makes its shard larger: it is indivisible.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "text_crc32", "shard")]
    whole, own = F.coalesce(F.col(text).cast("string"), F.lit("")), free(docs, "own_key")
    rows = docs.select(*keep, (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
                       F.xxhash64(whole).alias(own))
    groups = stored(rows.groupBy(F.col(own).alias("key")).agg(F.sum("size").alias("bytes")))
    placed = assign_shards(groups, shards, bucket_groups=bucket_groups).withColumnRenamed("key", own)
    return rows.join(placed, own).drop(own)
