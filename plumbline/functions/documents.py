"""Nested JSON documents: leaf tables, key search, canonical fields with lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_depth(df: DataFrame, col: str) -> int:
    """An upper bound of how deep objects are nested: the largest number of braces open at once, strings left out."""
    bare = F.regexp_replace(F.regexp_replace(F.col(col), r'"(?:[^"\\]++|\\.)*+"', ""), r"[^{}]+", "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    walked = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), lambda a, s: F.struct(
        (a["now"] + s).alias("now"), F.greatest(a["top"], a["now"] + s).alias("top")))
    return df.agg(F.max(walked["top"])).first()[0] or 1


def flatten_json(df: DataFrame, col: str, keep: Sequence[str], depth: int | None = None) -> DataFrame:
    """Rows (keep…, path, kind, value, length): one per leaf of the JSON document.

    Objects are opened level by level while leaves pass through; a list is a leaf that reports its length.
    Without ``depth`` the documents are read once more before, to count the levels that they have.  With it, an
    object still nested below fails the query, so no leaf is lost silently.
    """
    spark = df.sparkSession
    depth = json_depth(df, col) if depth is None else depth
    level = df.select(*keep, F.lit("").alias("_path"), F.parse_json(F.col(col)).alias("_v"))

    def is_object() -> Column:
        return F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    for _ in range(depth):
        level = level.withColumn("_o", is_object())
        opened = level.lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("_o"), F.col("_v")).outer()))
        name = F.when(F.col("_path") == "", F.col("key")).otherwise(F.concat_ws(".", "_path", "key"))
        # an empty object has no leaves
        level = opened.where(~F.col("_o") | F.col("key").isNotNull()).select(
            *keep, F.when(F.col("_o"), name).otherwise(F.col("_path")).alias("_path"),
            F.when(F.col("_o"), F.col("value")).otherwise(F.col("_v")).alias("_v"))
    kind = F.schema_of_variant("_v")
    is_list = kind.startswith("ARRAY")
    too_deep = F.raise_error(F.concat(F.lit("object nested too deep at "), F.col("_path"))).cast("string")
    return level.where(F.col("_v").isNotNull()).select(
        *keep, F.col("_path").alias("path"),
        F.when(is_object(), too_deep).when(is_list, "list").when(kind == "VOID", "null").otherwise(F.lower(kind)).alias("kind"),
        F.when(~is_list, F.try_variant_get("_v", "$", "string")).alias("value"),
        F.when(is_list, F.size(F.try_variant_get("_v", "$", "array<variant>"))).alias("length"))


def flatten_json_fixed(df: DataFrame, col: str, keep: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Leaf rows for a known list of JSON paths; one projection, no per-level union."""
    packed = F.array(*[F.struct(F.lit(name).alias("path"), F.get_json_object(F.col(col), path).alias("value"))
                       for name, path in fields.items()])
    return df.select(*keep, F.inline(packed)).where(F.col("value").isNotNull())


def has_key(col: Column, key: str) -> Column:
    """Whether the key occurs anywhere in the JSON text (a quoted name followed by a colon)."""
    return col.rlike(r'"\Q' + key + r'\E"\s*:')


def canonicalise(df: DataFrame, doc: str, key: str,
                 rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """First non-null of alternative JSON paths per canonical field, wide.

    ``rules``: field -> ordered JSON paths.
    """
    return df.select(key, *[F.coalesce(*[F.get_json_object(F.col(doc), p) for p in paths]).alias(field)
                            for field, paths in rules.items()])


def canonical_lineage(df: DataFrame, doc: str, key: str, rules: Mapping[str, Sequence[str]],
                      transform: Mapping[str, str] | None = None) -> DataFrame:
    """Lineage rows (key, field, source_field, raw_value, transform, status, reason), one per field."""
    transform = transform or {}
    entries = []
    for field, paths in rules.items():
        raw = [F.get_json_object(F.col(doc), p) for p in paths]
        source = F.coalesce(*[F.when(v.isNotNull(), F.lit(p)) for v, p in zip(raw, paths)])
        value = F.coalesce(*raw)
        entries.append(F.struct(
            F.lit(field).alias("field"), source.alias("source_field"), value.alias("raw_value"),
            F.lit(transform.get(field, "identity")).alias("transform"),
            F.when(value.isNotNull(), "available").otherwise("missing").alias("status"),
            F.when(value.isNull(), "source field absent").alias("reason")))
    return df.select(key, F.inline(F.array(*entries)))
