"""What the operators share: stored intermediate tables, fold keys, Arrow helpers.

``stored`` writes a table to the folder named by ``spark.checkpoint.dir``: its result survives lost
executors and is not computed again by later passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut_lineage

#: bytes of text that numpy code works on at once
BLOCK_BYTES = 4 << 20


#: written to the shared folder and read back; ``plumbline.session.drop_tables`` removes these tables
stored = cut_lineage


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id gets -1 and so belongs to no held-out fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % k, F.lit(-1))


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, schema: dict[str, T.DataType], fn: Callable[[pa.RecordBatch], dict[str, object]],
                 keep: list[str], use: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` plus the columns ``fn`` makes of each Arrow batch of ``use``; rows stay as they are."""
    names = list(dict.fromkeys([*keep, *use]))
    fields = {f.name: f for f in df.schema.fields}
    out = T.StructType([*(fields[c] for c in keep), *(T.StructField(n, t) for n, t in schema.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in schema)], names=[*keep, *schema])

    return df.select(*names).mapInArrow(run, out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its values; a null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes (one row at least) with their bytes and offsets."""
    data, at = text_buffer(column)
    start = 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield slice(start, end), data[at[start]:at[end]], at[start:end + 1] - at[start]
        start = end

