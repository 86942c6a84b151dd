"""Registry of named queries: a Spark callable and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles for comparison between engines (summation order differs); -0.0 becomes 0.0."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            r = F.round(F.col(f.name).cast("double"), special.get(f.name, digits))
            out.append(F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rsql(inner: str, keep: str = "", **digits: int) -> str:
    """SQL twin of ``rounded``: ``keep`` columns as they are, the named ones rounded."""
    cols = [f"CASE WHEN round({c}, {d}) = 0 THEN 0.0::DOUBLE ELSE round({c}::DOUBLE, {d}) END AS {c}" for c, d in digits.items()]
    return f"SELECT {', '.join([*([keep] if keep else []), *cols])} FROM ({inner}) q"


def each(names: list[str], template: str) -> str:
    """UNION ALL of one SELECT per name; ``{c}`` is replaced by the name."""
    return " UNION ALL ".join(template.replace("{c}", n) for n in names)
