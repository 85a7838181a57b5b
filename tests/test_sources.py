"""File sources and sinks: round trips and error paths."""

import json
import os

import numpy as np
import pytest

from ragspark.sources import catalog as cat
from ragspark.sources import fbin
from pyspark.sql import functions as F

from ragspark.sources import scratch
from ragspark.sources import tables as tb


def test_fbin_round_trip_and_limit(spark):
    x = np.arange(40, dtype=np.float32).reshape(10, 4)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(10)], "vec_id bigint, embedding array<float>")
    path = scratch.local_path(scratch.new_dir(spark, "t-fbin"))
    fbin.write_vectors(df, path, "embedding", "vec_id", rows_per_file=4)
    assert sorted(os.listdir(path))[:3] == ["base0.fbin", "base1.fbin", "base2.fbin"]
    back = spark.read.format("fbin").option("rowsPerPartition", 3).load(path).orderBy("vec_id").collect()
    assert [list(r.embedding) for r in back] == x.tolist()
    assert [r.vec_id for r in back] == list(range(10))
    head = spark.read.format("fbin").option("limit", 6).load(path).count()
    assert head == 6
    with pytest.raises(Exception):
        spark.read.format("fbin").option("limit", 11).load(path).count()


def test_ibin_width_detection(spark, tmp_path):
    for dtype in (np.int32, np.int64):
        p = tmp_path / f"ids_{np.dtype(dtype).itemsize}.ibin"
        with open(p, "wb") as f:
            np.array([3, 2], dtype=np.int32).tofile(f)
            np.array([[1, 2], [3, 4], [5, 6]], dtype=dtype).tofile(f)
        fbin.register(spark)
        rows = spark.read.format("ibin").load(str(p)).orderBy("row_id").collect()
        assert [list(r.ids) for r in rows] == [[1, 2], [3, 4], [5, 6]]


def test_dimension_mismatch_fails(spark, tmp_path):
    for i, d in enumerate((2, 3)):
        with open(tmp_path / f"base{i}.fbin", "wb") as f:
            np.array([1, d], dtype=np.int32).tofile(f)
            np.zeros(d, dtype=np.float32).tofile(f)
    fbin.register(spark)
    with pytest.raises(Exception):
        spark.read.format("fbin").load(str(tmp_path / "*.fbin")).count()


def test_catalog_json_loader(spark, tmp_path):
    """The JSON layout of the model catalog flattens to the built-in table."""
    models = {}
    for m, kind, dev, i, o, g, v in cat.MODEL_PERF:
        mod = models.setdefault(m, {"tput_ceiling": {}, "slo": {}})
        key = "tput_ceiling" if kind == "tput" else "slo"
        ents = mod[key].setdefault(dev, [])
        ent = next((e for e in ents if e["input"] == i and e["output"] == o), None)
        if ent is None:
            ent = {"input": i, "output": o, "values": {}}
            ents.append(ent)
        ent["values"][f"ngpu={g}"] = v
    for m, name, mem, tp in cat.MODELS:
        models[m].update({"name": name, "memory_gb": mem, "tp_size": tp})
        (tmp_path / f"{m}.json").write_text(json.dumps(models[m], indent=2))
    mods, perf = cat.load_json(spark, str(tmp_path / "*.json"))
    assert sorted(tuple(r) for r in perf.collect()) == sorted(cat.MODEL_PERF)
    assert sorted(tuple(r) for r in mods.select("model", "name", "memory_gb", "tp_size").collect()) == sorted(cat.MODELS)
    idx = {k: {"ntotal": r[1], "nlist": r[2], "d": r[3], "M": r[4], "msub": r[5], "ksub": r[6], "slo": r[7]}
           for k, *_ in cat.INDEXES for r in cat.INDEXES if r[0] == k}
    (tmp_path / "index.json").write_text(json.dumps(idx))
    got = cat.load_index_json(spark, str(tmp_path / "index.json"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(cat.INDEXES)


def test_fbin_overwrite_replaces_all_files_and_gaps_are_errors(spark):
    import os
    import pytest
    from ragspark.sources import fbin, scratch
    path = scratch.local_path(scratch.new_dir(spark, "t-fbin"))
    vecs = lambda n: spark.range(n).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding")
    fbin.write_vectors(vecs(40), path, "embedding", "vec_id", rows_per_file=8)
    fbin.write_vectors(vecs(10), path, "embedding", "vec_id", rows_per_file=8)
    got = spark.read.format("fbin").load(path).orderBy("vec_id").collect()
    assert [(r.vec_id, r.embedding[0]) for r in got] == [(i, float(i)) for i in range(10)]
    assert sorted(os.listdir(path)) == ["base0.fbin", "base1.fbin"]
    fbin.write_vectors(vecs(20), path, "embedding", "vec_id", rows_per_file=8, skip_existing=True)
    assert sorted(os.listdir(path)) == ["base0.fbin", "base1.fbin", "base2.fbin"]
    for bad in (vecs(10).where("vec_id not in (3, 4)"), vecs(5).union(vecs(1))):
        with pytest.raises(ValueError):
            fbin.write_vectors(bad, path, "embedding", "vec_id")


def test_a_failed_fbin_write_leaves_the_files_alone(spark):
    import os
    from ragspark.sources.fbin import FbinWriter, _Written
    from ragspark.sources import scratch
    path = scratch.local_path(scratch.new_dir(spark, "t-fbin-abort"))
    schema = spark.createDataFrame([], "file_no bigint, embedding array<float>").schema
    w = FbinWriter({"path": path}, schema, False, True)
    os.makedirs(os.path.join(path, "_staging", "x"))
    open(os.path.join(path, "base0.fbin"), "wb").close()
    open(os.path.join(path, "_staging", "x", "base0.fbin"), "wb").close()
    w.abort([_Written(os.path.join(path, "_staging", "x"), ["base0.fbin"])])
    assert os.listdir(path) == ["base0.fbin"]


def test_summary_files_have_the_rows_of_their_mode_and_read_back_whole(spark):
    metrics = [m for m, _ in tb.CSV_NAMES]
    runs = [("a", 1, "vlite", 100), ("b", 1, "cpu", 0), ("c", 2, "all-gpu", 150), ("d", 2, None, 150)]
    extra = spark.createDataFrame([(m, r, s, o, 2.5, 10.0 + r, 0.25) for m, r, s, o in runs],
                                  "mode string, rate int, search_mode string, search_slo int, avg_batch_size double, total_time double, rps double")
    summ = spark.createDataFrame([(m, r, x, i + 0.5, i + 0.1, i + 0.2, i + 1e-7) for m, r, _, _ in runs for i, x in enumerate(metrics)],
                                 "mode string, rate int, metric string, avg double, p50 double, p90 double, p95 double")
    path = scratch.new_dir(spark, "t-summary")
    tb.write_summary(summ, extra, path, ["mode", "rate"])
    text = [r.value for r in spark.read.text(path + "/mode=a/rate=1").collect()]
    assert text[:4] == ["# mode=a", "# rate=1", "#", "Metric,Avg,P50,P90,P95"]
    assert [t.split(",")[0] for t in text[4:]] == [
        "Idle", "Batching", "Pending", "Queuing", "Search", "ANNS E2E", "Quantize", "LUT Computed", "LUT Scan", "Hit Rate",
        "Batch Size", "LLM Queuing", "Prefill", "TPOT", "End2End", "Total Time", "Avg RPS"]
    got = {}
    for r in tb.read_summary(spark, path).collect():
        got.setdefault(r["mode"], {})[r["metric"]] = (r["avg"], r["p50"], r["p90"], r["p95"])
    assert {m: len(v) for m, v in got.items()} == {"a": 17, "b": 16, "c": 14, "d": 6}
    assert "hit_rate" not in got["b"] and "quantize" not in got["c"] and "avg_batch_size" not in got["d"]
    for m, r, *_ in runs:
        assert got[m]["total_time"] == (10.0 + r, None, None, None) and got[m]["rps"] == (0.25, None, None, None)
        i = metrics.index("tpot")
        assert got[m]["tpot"] == (i + 0.5, i + 0.1, i + 0.2, float(i))
    head = {r["k"]: r["v_str"] for r in tb.read_summary_header(spark, path).where("mode = 'a'").collect()}
    assert set(head) == {"mode", "rate"}


def test_device_and_model_files(spark):
    from ragspark.plans.source_plans import write_catalog_json
    path = scratch.new_dir(spark, "t-catalog")
    write_catalog_json(spark, path)
    assert sorted(map(tuple, cat.load_device_json(spark, path + "/devices").collect())) == sorted(cat.GPUS)
    mods, perf = cat.load_json(spark, path + "/models")
    assert sorted(r.model for r in mods.collect()) == sorted(m[0] for m in cat.MODELS) and perf.count() == len(cat.MODEL_PERF)


def test_a_run_is_written_in_files_of_its_size(spark, monkeypatch):
    import glob
    monkeypatch.setattr(tb, "FILE_ROWS", 100)
    req = spark.range(1500).select("id", F.when(F.col("id") < 1200, "big").otherwise("small").alias("mode"), F.lit(1).alias("rate"))
    path = scratch.new_dir(spark, "t-requests")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tb.write_requests(req, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = {m: len(glob.glob(f"{scratch.local_path(path)}/mode={m}/rate=1/*.parquet")) for m in ("big", "small")}
    assert spark.read.parquet(path).count() == 1500 and files["small"] <= 3 < files["big"] <= 12
