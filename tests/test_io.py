"""Sources and sinks, round trip through temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.catalog import QUERIES
from plumbline.operators.gates import check_population
from plumbline.plans import matrix as M
from plumbline.sources import readers as R
from plumbline.sources import views as V
from plumbline.sources import writers as W


def test_nested_documents(spark, tmp_path):
    for task, n in (("gpqa", 2), ("chat", 1)):
        (tmp_path / f"{task}.json").write_text(json.dumps({"task": task, "configurations": [{"a": i, "only_" + task: 1.5} for i in range(n)]}, indent=1))
    paths = [str(tmp_path / f"{t}.json") for t in ("gpqa", "chat")]
    df = R.read_nested(spark, paths, expected={"gpqa": "gpqa", "chat": "chat"})
    assert sorted((r["task"], r["a"]) for r in df.collect()) == [("chat", 0), ("gpqa", 0), ("gpqa", 1)]
    assert {"only_gpqa", "only_chat"} <= set(df.columns)
    with pytest.raises(Exception, match="unexpected task"):
        R.read_nested(spark, paths, expected={"gpqa": "gpqa", "chat": "other"}).collect()
    (tmp_path / "bad.json").write_text(json.dumps({"task": "bad", "other": 1, "configurations": None}))
    with pytest.raises(Exception, match="no configurations list"):
        R.read_nested(spark, [str(tmp_path / "bad.json")], schema="task string, configurations array<struct<a:int>>").collect()


def test_nested_documents_share_files(spark, sf, tmp_path):
    docs = [{"task": t, "configurations": [{"a": i} for i in range(n)]} for t, n in (("gpqa", 2), ("chat", 1), ("none", 0))]
    (tmp_path / "docs.json").write_text("".join(json.dumps(x) + "\n" for x in docs))
    rows = R.read_nested(spark, [str(tmp_path / "docs.json")], lines=True).collect()
    assert sorted((r["task"], r["a"]) for r in rows) == [("chat", 0), ("gpqa", 0), ("gpqa", 1)]
    (tmp_path / "bad.json").write_text(json.dumps(docs[0]) + '\n{"task": "bad"}\n')
    with pytest.raises(Exception, match="no configurations list"):
        R.read_nested(spark, [str(tmp_path / "bad.json")], schema="task string, configurations array<struct<a:int>>", lines=True).collect()
    found = QUERIES["nested_scan"](spark, sf)
    suppliers = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert found.count() == suppliers > len(found.inputFiles())


def test_headers_join_their_manifest(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"run_{i}.json").write_text(json.dumps({"n": i, "steady": {"gpu_energy": {"0": i}}}, indent=2))
    docs = R.read_documents(spark, str(tmp_path / "run_*.json"), forbidden=["timeline"])
    for i in range(3):
        (tmp_path / f"sub_{i}").mkdir()
        (tmp_path / f"sub_{i}" / "metadata.json").write_text(json.dumps({"n": i}))
    docs = R.read_documents(spark, str(tmp_path / "sub_*" / "metadata.json"))
    manifest = spark.createDataFrame([("a", "sub_1/metadata.json"), ("b", "./sub_2/metadata.json"), ("c", "sub_0/metadata.json")], "key string, file string")
    got = R.documents_of(manifest, docs, "file", str(tmp_path)).select("key", F.get_json_object("text", "$.n").alias("n")).collect()
    assert sorted((r["key"], r["n"]) for r in got) == [("a", "1"), ("b", "2"), ("c", "0")]
    with pytest.raises(Exception, match="no document for sub_9"):
        R.documents_of(spark.createDataFrame([("a", "sub_9/metadata.json")], "key string, file string"), docs, "file", str(tmp_path)).collect()
    (tmp_path / "run_3.json").write_text('{"timeline": []}')
    with pytest.raises(Exception, match="forbidden key timeline"):
        R.read_documents(spark, str(tmp_path / "run_*.json"), forbidden=["timeline"]).collect()


def test_tables_agree_in_both_formats(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    counts = W.write_table(orders, str(tmp_path / "orders"))
    assert counts["parquet"] == counts["csv"] == orders.count()
    back = R.read_manifest(spark, str(tmp_path / "orders.csv"), orders.schema)
    assert back.exceptAll(orders).count() == 0


def test_filter_reaches_the_scan(spark, sf):
    plan = R.read_runs(spark, f"{sf}/lineitem.parquet", "l_returnflag", ["A"]).select("l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_returnflag" in plan.split("PushedFilters: [")[1] and "l_comment" not in plan


def test_staged_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    W.write_atomic(spark.range(3), path)
    with pytest.raises(Exception, match="boom"):
        W.write_atomic(spark.range(5).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    W.write_atomic(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_first_existing_source(spark, tmp_path):
    W.write_atomic(spark.range(1), str(tmp_path / "b"))
    assert R.resolve_source(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        R.resolve_source(spark, [str(tmp_path / "a")])


def test_receipt(spark, tmp_path):
    path = str(tmp_path / "receipt")
    W.write_receipt(check_population(spark.range(2), 2), path)
    row = W.read_receipt(spark, path).first()
    assert (row["name"], row["status"], row["observed"]) == ("row_count", "pass", "2")


def test_views_and_snapshot(spark):
    V.literal_view(spark, "t_view", [{"a": 1, "b": "it's", "c": None}, {"a": 2, "b": "x\\y", "c": 2.5}])
    assert [tuple(r) for r in spark.sql("select * from t_view order by a").collect()] == [(1, "it's", None), (2, "x\\y", 2.5)]
    rows = V.snapshot({"one": spark.range(1), "two": spark.range(2)}).collect()
    assert sorted((r["dataset"], r["row_json"]) for r in rows) == [("one", '{"id":0}'), ("two", '{"id":0}'), ("two", '{"id":1}')]


def test_dimension_and_inventory(spark, tmp_path):
    d = {r["gpu"]: (r["peak"], r["name"]) for r in R.dim(spark, {"H": {"peak": 1, "name": "h"}, "B": {"peak": 2.5}}, "gpu").collect()}
    assert d == {"H": (1.0, "h"), "B": (2.5, None)}
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "model.bin").write_text("x")
    got = {r["path"].split("/")[-1]: (r["bytes"], r["allowed"]) for r in R.file_inventory(spark, str(tmp_path), deny_suffix=[".bin"], allow_basename=["config.json"]).collect()}
    assert got == {"config.json": (2, True), "model.bin": (1, False)}


def test_inventory_of_files_larger_than_a_value(spark, tmp_path, monkeypatch):
    """Spark's binary reader refuses files above a size (2 GB; 4 KB here); they are hashed from parts, byte for byte."""
    import hashlib
    import random
    monkeypatch.setattr(R, "WHOLE_BYTES", 4000, raising=False)
    monkeypatch.setattr(R, "PIECE_BYTES", 700, raising=False)
    some = random.Random(3).randbytes(60_000)
    (tmp_path / "sub").mkdir()
    contents = {"noise.bin": some, "noise_end.bin": some + b"\n", "mark.csv": b"\xef\xbb\xbf" + b"a,b\r\n" * 2000, "mark_open.csv": b"\xef\xbb\xbf" + b"a,b\r\n" * 2000 + b"x", "blank.txt": b"\n" * 9000, "one_line.txt": b"y" * 9000,
                "marks.txt": b"\xef\xbb\xbf\n" * 3000, "zero.bin": bytes(8000), "sub/a b%20\u00fc#+.bin": some[::-1], "small.txt": b"x\n", "small.gz": b"no gzip"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    limits = {"spark.sql.sources.binaryFile.maxLength": "4096", "spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        got = {r["path"].split(tmp_path.name + "/")[1]: (r["bytes"], r["sha256"], r["allowed"]) for r in R.file_inventory(spark, str(tmp_path), deny_suffix=[".csv"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest(), not k.endswith(".csv")) for k, v in contents.items()}


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "v double, s string")
    assert R.normalise_nan(df).where("v is null").count() == 1


def test_matrix_resumes(spark, tmp_path):
    path, calls = str(tmp_path / "matrix"), []
    plan = M.with_fingerprint(spark.createDataFrame([("e1",), ("e2",), ("e3",)], "experiment_id string"), {"data": "1"})

    def runner(row):
        calls.append(row["experiment_id"])
        if row["experiment_id"] == "e3":
            raise RuntimeError("no fit")
        return spark.range(4).withColumnRenamed("id", "run_key")
    first = {s["experiment_id"]: s["status"] for s in M.run_matrix(plan, runner, path)}
    assert first == {"e1": "complete", "e2": "complete", "e3": "failed"}
    M.run_matrix(plan, runner, path)
    assert calls == ["e1", "e2", "e3", "e3"]
    stored = spark.read.parquet(path)
    assert {r["experiment_id"]: r["status"] for r in M.matrix_progress(plan, stored, expected_rows=4).collect()} == {"e1": "complete", "e2": "complete", "e3": "missing"}
    fp = plan.where("experiment_id = 'e1'").first()["fingerprint"]
    one = stored.where("experiment_id = 'e1'")
    assert M.valid_checkpoint(one, spark.range(4).withColumnRenamed("id", "run_key"), ["run_key"], fp).first()["valid"]
    assert not M.valid_checkpoint(one, spark.range(5).withColumnRenamed("id", "run_key"), ["run_key"], fp).first()["valid"]
    assert not M.valid_checkpoint(one, spark.range(4).withColumnRenamed("id", "run_key"), ["run_key"], "other").first()["valid"]


def test_intermediate_tables_are_dropped(spark):
    from plumbline.session import cut_lineage, drop_tables
    drop_tables(spark)
    kept = cut_lineage(spark.range(5))
    assert kept.count() == 5 and drop_tables(spark) == 1 and drop_tables(spark) == 0
