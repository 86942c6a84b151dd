"""Keys, canonical text, digests and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP_NULLS = {"ignoreNullFields": "false"}


def with_run_key(df: DataFrame, fields: Sequence[str], name: str = "run_key") -> DataFrame:
    """Composite key as compact JSON in the given field order; null fields are kept."""
    return df.withColumn(name, F.to_json(F.struct(*fields), KEEP_NULLS))


def canonical_json(cols: Sequence[str]) -> Column:
    """Row text with sorted keys, so equal content gives equal text."""
    return F.to_json(F.struct(*sorted(cols)), KEEP_NULLS)


def digest_text(schema: T.StructType, cols: Sequence[str]) -> Column:
    """Canonical row text; doubles are written so that different ones differ (shortest exact form, one zero, one NaN)."""
    parts = []
    for c in sorted(cols):
        kind = schema[c].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            parts.append((F.col(c).cast("double") + F.lit(0.0)).cast("string").alias(c))
        else:
            parts.append(F.col(c).cast("string").alias(c))
    return F.to_json(F.struct(*parts), KEEP_NULLS)


def row_number_of_text(text: Column) -> Column:
    """First 60 bits of md5 as an exact integer."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def table_digest(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-free digest: (rows, digest, schema).  A sum of row hashes needs no sort and one tiny shuffle."""
    cols = list(cols or df.columns)
    schema = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in sorted(cols))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(row_number_of_text(digest_text(df.schema, cols))), F.lit(0)).cast("string").alias("digest"),
    ).withColumn("schema", F.lit(schema))


def grouped_digest(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.sum(row_number_of_text(digest_text(df.schema, cols))).cast("string").alias("digest"))


def fingerprint(*parts: Column) -> Column:
    """sha256 over the JSON of the named parts: changes when any part changes."""
    return F.sha2(F.to_json(F.struct(*parts), KEEP_NULLS), 256)


def experiment_id(*cols: str) -> Column:
    return F.concat_ws("__", *[F.col(c).cast("string") for c in cols])


def slug(col: Column) -> Column:
    """Lower-case text with every other run of characters turned into one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")
