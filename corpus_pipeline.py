"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes what the one before kept and returns a DataFrame that is written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import decontamination, mixing, neardup, quality, sharding
from plumbline.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 40
#: documents that score lower are rejected
QUALITY = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learned from the labelled ones among them, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=COLUMNS, threshold=QUALITY).where("predicted = 1").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the lowest id; of rows equal in id and text, one."""
    first = neardup.classify(docs, keep=COLUMNS).where("class_first")
    row = F.row_number().over(Window.partitionBy("text_key", "doc_id").orderBy("source", "lang", "n_chars"))
    return first.withColumn("__row", row).where("__row = 1").select(COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS, short=True)
    return found.where(F.size("leaks") == 0).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mixing.mix_sources(docs, keep=COLUMNS)
    return taken.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return sharding.shard_documents(docs, SHARDS, keep=COLUMNS)


STAGES: list[tuple[str, Stage]] = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_leaks), ("mix", mixed), ("shards", sharded)]
#: fitted classifiers and random rounding are beyond SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
