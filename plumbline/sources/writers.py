"""Sinks: parquet and CSV twins, staged replacement, check receipts."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, formats: Sequence[str] = ("parquet", "csv")) -> dict[str, int]:
    """Write the same rows in several formats; later formats are written from the first one, counts must agree."""
    spark = df.sparkSession
    counts: dict[str, int] = {}
    first = formats[0]
    df.write.mode("overwrite").format(first).options(**_options(first)).save(f"{path}.{first}")
    rows = spark.read.schema(df.schema).format(first).options(**_options(first)).load(f"{path}.{first}")
    counts[first] = rows.count()
    for fmt in formats[1:]:
        rows.write.mode("overwrite").format(fmt).options(**_options(fmt)).save(f"{path}.{fmt}")
        counts[fmt] = spark.read.schema(df.schema).format(fmt).options(**_options(fmt)).load(f"{path}.{fmt}").count()
    if len(set(counts.values())) != 1:
        raise ValueError(f"row counts differ between formats: {counts}")
    return counts


def _options(fmt: str) -> dict[str, str]:
    return {"header": "true"} if fmt == "csv" else {}


def write_atomic(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside the target, then swap by rename: a failed job leaves the old table untouched, a failed swap puts it back.

    Between the two renames the path is missing; readers that may come then should read a versioned path instead.
    """
    spark = df.sparkSession
    staged, retired = f"{path}.staged-{uuid4().hex}", f"{path}.retired-{uuid4().hex}"
    df.write.format(fmt).save(staged)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to_path(path)):
        fs.rename(to_path(path), to_path(retired))
    if not fs.rename(to_path(staged), to_path(path)):
        if fs.exists(to_path(retired)):
            fs.rename(to_path(retired), to_path(path))
        raise OSError(f"could not move {staged} to {path}")
    if fs.exists(to_path(retired)):
        fs.delete(to_path(retired), True)


def write_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite), one commit per job."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_receipt(checks: DataFrame, path: str) -> None:
    """Check rows as sorted-key JSON lines in name order."""
    line = F.to_json(F.struct(*sorted(checks.columns)), {"ignoreNullFields": "false"})
    checks.orderBy("name").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_receipt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, status string, observed string, expected string").json(path)
