"""Session set-up, the shared folder for intermediate tables, and small literal tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

def build_session(app: str = "plumbline", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only for local runs without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


_written: list[str] = []


def table_path(spark: SparkSession) -> str:
    """A new path in the shared folder, remembered for ``drop_tables``."""
    _written.append(f"{shared_folder(spark)}/table-{uuid4().hex}")
    return _written[-1]


def drop_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; call it when no DataFrame that reads them is needed any more."""
    removed = 0
    while _written:
        removed += drop(spark, _written.pop())
    return removed


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a table, or one partition's folder of it, that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each query that runs inside deletes its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame, *by: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (``path``: a ``table_path``), partitioned ``by`` columns, and read it back.

    The result survives executor loss, is not recomputed by later passes, keeps
    column pruning, and has a known size.  ``drop_tables`` removes it.
    """
    spark = df.sparkSession
    path = path or table_path(spark)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows: Iterable[Sequence[object]], names: Sequence[str],
                types: Sequence[pa.DataType]) -> DataFrame:
    """A configuration-sized table; the Arrow path keeps its size known to the planner."""
    rows = list(rows)
    arrays = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(names)))
