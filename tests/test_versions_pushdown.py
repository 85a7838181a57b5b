"""Commit log with two writers and a failed one; row ranges pushed into vector files."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from ragspark.sources import scratch
from ragspark.sources.versions import VersionedTable

SCHEMA = "k string, n int, v bigint"


def _table(spark, path=None):
    return VersionedTable(spark, path or scratch.new_dir(spark, "versions"), ["k", "n"],
                          spark.createDataFrame([], SCHEMA).schema)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_versions_and_pinned_readers(spark):
    t = _table(spark)
    assert t.latest() == 0 and t.read().count() == 0
    first = spark.createDataFrame([("a", 1, 10), ("b", 1, 20), (None, 1, 30)], SCHEMA)
    assert t.upsert(first) == 1
    old = t.read()
    assert t.upsert(spark.createDataFrame([("b", 1, 21), ("c", 1, 40), (None, 1, 31)], SCHEMA)) == 2
    want = [("a", 1, 10), ("b", 1, 21), ("c", 1, 40), (None, 1, 31)]
    assert _rows(t.read()) == sorted(want, key=repr) and _rows(t.read(1)) == _rows(first) == _rows(old)
    assert t.compact() == 3 and len(t.folders(3)) == 1 and _rows(t.read()) == sorted(want, key=repr)
    assert _rows(_table(spark, t.path).read(2)) == sorted(want, key=repr)      # another reader, an old version


def test_two_writers_lose_no_key(spark):
    """Both prepare on the same version; the second finds its number taken and goes on behind."""
    t = _table(spark)
    t.upsert(spark.createDataFrame([("base", 0, 0)], SCHEMA))
    meet, errors = threading.Barrier(4), []

    def work(w):
        try:
            mine = _table(spark, t.path)
            for i in range(3):
                d = spark.createDataFrame([(f"w{w}", i, i), ("shared", 0, w)], SCHEMA)
                meet.wait(timeout=60)
                mine.upsert(d)
        except Exception as e:      # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=work, args=(w,)) for w in range(4)]
    [x.start() for x in threads]
    [x.join(timeout=120) for x in threads]
    assert not errors and t.latest() == 13
    got = {(r.k, r.n) for r in t.read().collect()}
    assert got == {("base", 0), ("shared", 0)} | {(f"w{w}", i) for w in range(4) for i in range(3)}
    for v in range(1, 14):
        assert len(t.folders(v)) == v
    assert t._publish(13, []) is False                        # a version is created once


def test_a_failed_writer_leaves_nothing(spark):
    t = _table(spark)
    t.upsert(spark.createDataFrame([("a", 1, 1)], SCHEMA))
    bad = spark.range(10).select(F.lit("x").alias("k"), F.lit(1).alias("n"),
                                 F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("bigint")).alias("v"))
    with pytest.raises(Exception):
        t.upsert(bad)
    t._write(spark.createDataFrame([("lost", 1, 1)], SCHEMA))        # died between writing and publishing
    assert t.latest() == 1 and _rows(t.read()) == [("a", 1, 1)]
    assert not [f for f in os.listdir(scratch.local_path(t.path) + "/log") if f.startswith(".draft")]
    # an upsert that comes while a compaction runs stays
    other = _table(spark, t.path)
    read, done = t.read, []

    def late(version=None):
        if not done:
            done.append(other.upsert(spark.createDataFrame([("b", 1, 2)], SCHEMA)))
        return read(version)
    t.read = late
    t.compact()
    assert _rows(read()) == [("a", 1, 1), ("b", 1, 2)] and len(t.folders(t.latest())) == 2


def test_row_ranges_are_pushed_into_the_files(spark):
    from ragspark.sources import fbin
    fbin.register(spark)
    path = scratch.new_dir(spark, "fbin-push")
    rows = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
                                    F.floor(F.col("id") / 400).cast("int").alias("file_no"))
    rows.repartition(3, "file_no").sortWithinPartitions("vec_id").write.format("fbin").mode("append").save(path)

    def load():
        return spark.read.format("fbin").option("rowsPerPartition", "50").load(path)
    c = F.col("vec_id")
    for cond, parts, want in [(c == 777, 1, [777]), ((c >= 390) & (c < 410), 2, range(390, 410)), (c > 990, 1, range(991, 1000)),
                              (c <= 10, 1, range(11)), (c.isin(3, 120, 160), 4, [3, 120, 160]), ((c > 500) & (c < 400), 1, []),
                              (F.col("embedding")[0] == 5, 20, [5]), (c.isNotNull(), 20, range(1000)), (c == -5, 1, [])]:
        got = load().where(cond)
        assert sorted(r.vec_id for r in got.collect()) == list(want)
        assert all(r.embedding[0] == r.vec_id for r in got.collect())
        assert got.rdd.getNumPartitions() == parts, cond
