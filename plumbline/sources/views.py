"""Named report views and snapshots computed from data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_view(spark: SparkSession, name: str, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """Temp view over inline rows (SELECT … UNION ALL)."""
    def text(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, float):
            return f"{value!r}D"
        if isinstance(value, int):
            return str(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    selects = ["SELECT " + ", ".join(f"{text(v)} AS `{k}`" for k, v in row.items()) for row in rows]
    df = spark.sql(" UNION ALL ".join(selects))
    df.createOrReplaceTempView(name)
    return df


def view_of(name: str, df: DataFrame) -> DataFrame:
    """Temp view over a computed report table."""
    df.createOrReplaceTempView(name)
    return df


def snapshot(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Named report tables as (dataset, row_json) rows: one long table, ready for a JSON sink."""
    parts = [df.select(F.lit(name).alias("dataset"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_json"))
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
