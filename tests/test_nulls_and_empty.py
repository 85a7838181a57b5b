"""NULL groups, empty inputs and large batch sizes."""

import pytest
from pyspark.sql import functions as F

from ragspark.functions.stats import exact_percentiles, join_null_safe
from ragspark.operators import latency as lt
from ragspark.operators import sampling as smp
from ragspark.sources import scratch, tables


def test_percentiles_keep_null_groups(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0), (1, None)], "g int, v double")
    got = {r.g: r.p for r in exact_percentiles(d, ["g"], "v", [0.5], ["p"]).collect()}
    assert got == {None: 2.0, 1: 5.0}


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), (2, 3)], "k int, x int")
    b = spark.createDataFrame([(None, 7), (2, 9)], "k int, y int")
    assert sorted(map(tuple, join_null_safe(a, b, ["k"]).collect()), key=repr) == [(2, 3, 9), (None, 1, 7)]


def _lat(spark, sizes):
    cols = ("ann_search", "quantize", "lut_compute", "lut_scan", "hit_rate")
    return spark.createDataFrame([(n, *[0.01 * n + i for i in range(5)]) for n in sizes],
                                 "batch_size int, " + ", ".join(f"{c} double" for c in cols))


def test_batch_sizes_beyond_any_fixed_bound_are_fitted(spark):
    lat = _lat(spark, [1, 5, 33, 64, 65, 66, 170, 175])
    fit = lt.range_fit(lat, 8).where("component = 'search'")
    assert fit.agg(F.max("end")).first()[0] == 175.0 and fit.where("start > 65").count() >= 1
    brks = lt.breaks(lat)
    assert brks[0] == 1.0 and brks[-1] == 175.0
    got = {r.batch_size: r.pred for r in lt.predict(lat, lt.piecewise(lat, brks)).where("component = 'search'").collect()}
    assert set(got) == {1, 5, 33, 64, 65, 66, 170, 175}
    assert got[175] == pytest.approx(1.75, abs=1e-6)


def test_empty_latency_input(spark):
    lat = _lat(spark, [1]).limit(0)
    assert lt.breaks(lat) == [] and lt.piecewise(lat, []).count() == 0 and lt.range_fit(lat, 8).count() == 0


def test_split_and_cap_take_shares(spark):
    d = spark.range(40).select(F.col("id").alias("i"))
    s = smp.split(d, "i", 0.25)
    assert s.where("split = 'train'").count() == 10 and smp.cap(d, "i", 0.3).count() == 12


def test_query_files_number_by_position(spark):
    path = scratch.new_dir(spark, "t-tsv")
    spark.createDataFrame([("q9", "a"), ("q2", "b"), ("x", "c")], "qid string, text string").coalesce(1).write.option(
        "sep", "\t").option("header", True).csv(path)
    got = sorted((r.qid, r.src_qid, r.text) for r in tables.read_query_tsv(spark, path).collect())
    assert got == [(0, "q9", "a"), (1, "q2", "b"), (2, "x", "c")]


def test_no_machine_local_checkpoints_on_a_cluster():
    from ragspark import session

    class Conf(dict):
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
