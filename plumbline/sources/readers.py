"""Sources: nested documents, run tables, JSON headers, CSV manifests, dimensions, file inventory."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.predicates import path_allowed
from plumbline.operators.joins import join_many_to_one, unique_guard
from plumbline.session import local_frame

# task code travels with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column, so missing has one spelling."""
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def read_nested(spark: SparkSession, paths: Sequence[str], array_col: str = "configurations", tag_col: str = "task",
                expected: Mapping[str, str] | None = None, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """One JSON document per file with a list of objects: explode the list, stamp the document's tag.

    With ``lines`` a file holds any number of documents, one a line: the form for many of them, since files can be split and need not be as many.

    A document without the list, or whose tag differs from ``expected`` (file
    name without suffix -> tag), fails the query.
    """
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    docs = reader.json(list(paths)).withColumn("_file", F.input_file_name())
    rows = F.when(F.col(array_col).isNotNull(), F.col(array_col)).otherwise(
        F.raise_error(F.concat(F.col("_file"), F.lit(f" has no {array_col} list"))))
    if expected is not None:
        stem = F.regexp_extract("_file", r"([^/]+)\.[^./]+$", 1)
        want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[stem]
        docs = docs.where(F.when(F.col(tag_col).eqNullSafe(want), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.col("_file"), F.lit(f" declares an unexpected {tag_col}")))))
    return docs.select(F.explode(rows).alias("_r"), F.col(tag_col).alias("_tag")).select("_r.*", F.col("_tag").alias(tag_col))


def read_runs(spark: SparkSession, path: str, column: str | None = None, values: Sequence[object] | None = None) -> DataFrame:
    """Parquet run table with an optional IN filter that reaches the scan; NaN is read as null."""
    df = normalise_nan(spark.read.parquet(path))
    return df.where(F.col(column).isin(list(values))) if column and values is not None else df


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def resolve_source(spark: SparkSession, paths: Sequence[str]) -> str:
    """First path that exists, in order."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exist: {list(paths)}")


def read_documents(spark: SparkSession, paths: Sequence[str] | str, forbidden: Sequence[str] = ()) -> DataFrame:
    """Many small JSON files as (path, text): one row per file; a forbidden top-level key fails the query."""
    docs = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    docs = docs.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    for key in forbidden:
        found = F.array_contains(F.json_object_keys("text"), key)
        docs = docs.where(F.when(~F.coalesce(found, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit(f"forbidden key {key} in "), F.col("path")))))
    return docs


def documents_of(manifest: DataFrame, docs: DataFrame, path_col: str, root: str) -> DataFrame:
    """Manifest rows with the document that each names by its path below ``root``.

    Repeated paths on either side and a row without a document fail the query.
    """
    def relative(path: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:/+", "/"), r"/(\./|/)*", "/")
    top = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root or root.startswith("/") else root.strip("/") + "/"
    named = unique_guard(manifest.withColumn("_f", F.ltrim(relative(F.col(path_col)), F.lit("./"))), ["_f"], "manifest")
    below = F.when(F.startswith(relative(F.col("path")), F.lit(top)), F.substr(relative(F.col("path")), F.lit(len(top) + 1)))
    found = unique_guard(docs.withColumn("_f", below).where(F.col("_f").isNotNull()), ["_f"], "documents")
    joined = join_many_to_one(named, found.withColumn("_known", F.lit(True)), "_f")
    missing = F.raise_error(F.concat(F.lit("no document for "), F.col("_f")))
    return joined.where(F.when(F.col("_known"), F.lit(True)).otherwise(missing)).drop("_f", "_known")


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV manifest with an explicit schema (no inference pass)."""
    return spark.read.csv(path, header=True, schema=schema)


_ARROW = {bool: pa.bool_(), int: pa.int64(), float: pa.float64(), str: pa.string()}


def dim(spark: SparkSession, config: Mapping[str, Mapping[str, object]], key: str) -> DataFrame:
    """Configuration map (key -> attributes) as a small dimension; absent attributes are null."""
    names = list(dict.fromkeys(n for attrs in config.values() for n in attrs))
    kinds = []
    for n in names:
        seen = {type(a[n]) for a in config.values() if a.get(n) is not None}
        kinds.append(_ARROW[float] if seen == {int, float} else _ARROW[seen.pop()] if len(seen) == 1 else pa.string())
    rows = [(k, *[a.get(n) for n in names]) for k, a in config.items()]
    return local_frame(spark, rows, [key, *names], [pa.string(), *kinds])


#: a file up to this size is hashed as one value
WHOLE_BYTES = 128 << 20
PIECE_BYTES = 1 << 20
#: names whose content Spark's line reader would unpack
_PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|lzo|xz|br)$"
_MARK = b"\xef\xbb\xbf"


def file_inventory(spark: SparkSession, path: str, glob: str = "*", deny_suffix: Sequence[str] = (),
                   allow_basename: Sequence[str] | None = None) -> DataFrame:
    """(path, bytes, sha256, allowed) per file below ``path``.

    Files up to ``WHOLE_BYTES`` are hashed where they are read.  Larger ones are read in parts, whose pieces one task per file takes in order, as a sha256 depends on all
    bytes in order: its memory does not follow the file's size, and there is no largest size.  Larger ones with a compressed file's suffix stay one value (2 GB at most).
    """
    def read(kind: str, parts: bool) -> DataFrame:
        files = spark.read.format(kind).options(pathGlobFilter=glob, recursiveFileLookup=True, lineSep="\n").load(path)
        large = (F.col("_metadata.file_size") > WHOLE_BYTES) & ~F.rlike("_metadata.file_path", F.lit(_PACKED))  # listing leaves out the other files
        return files.where(large if parts else ~large)
    whole = read("binaryFile", False).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = read("binaryFile", True).select("path", F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("_name"))
    lines = read("text", True).select(F.col("_metadata.file_path").alias("_name"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    pieces = lines.mapInArrow(_pieces, "_name string, bytes long, start long, no long, piece binary")
    hashed = pieces.repartition("_name").sortWithinPartitions("_name", "start", "no").mapInArrow(_digests, "_name string, sha256 string")
    files = whole.unionByName(large.join(hashed, "_name", "left").select("path", "bytes", "sha256"))
    return files.withColumn("allowed", path_allowed(F.col("path"), basename=allow_basename, deny_suffix=deny_suffix))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the same part of a file, joined up to about ``PIECE_BYTES``; ``no`` is their order within a task."""
    no = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        name, size, start, line = batch.columns
        ends = np.cumsum(pc.binary_length(line).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        new = np.diff(ends // PIECE_BYTES, prepend=-1) != 0
        for column in (name, start):
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        first, lines = np.flatnonzero(new), line.to_pylist()
        joined = [b"\n".join(lines[a:b]) for a, b in zip(first, [*first[1:], len(lines)])]
        yield pa.RecordBatch.from_arrays([name.take(first), size.take(first), start.take(first), pa.array(np.arange(no, no + len(first))), pa.array(joined, pa.binary())],
                                         names=["_name", "bytes", "start", "no", "piece"])
        no += len(first)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each file from its pieces in order; Spark's line reader leaves out a byte order mark and the last line's end, which the size gives away."""
    name, size, seen, plain, marked = None, 0, 0, None, None

    def done() -> pa.RecordBatch:
        rest = size - seen
        if rest not in (0, 1, len(_MARK), len(_MARK) + 1):
            raise ValueError(f"{name} has {size} bytes, but {seen} were read")
        digest = marked if rest >= len(_MARK) else plain
        digest.update(b"\n" * (rest % len(_MARK)))
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["_name", "sha256"])

    for batch in batches:
        for row in range(batch.num_rows):
            of, piece = batch.column(0)[row].as_py(), batch.column(4)[row].as_py()
            if of != name:
                if name is not None:
                    yield done()
                name, size, seen, plain, marked = of, batch.column(1)[row].as_py(), len(piece), hashlib.sha256(), hashlib.sha256(_MARK)
            else:
                piece = b"\n" + piece
                seen += len(piece)
            plain.update(piece)
            marked.update(piece)
    if name is not None:
        yield done()
