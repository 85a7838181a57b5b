"""Streaming replays equal their batch counterparts."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ragspark.operators import telemetry as tel
from ragspark.sources import scratch
from ragspark.streaming import jobs


@pytest.fixture(scope="module")
def reqs(spark):
    rows = [(i, float((i * 37) % 100) / 400.0, i * 60.0) for i in range(3500)]
    df = spark.createDataFrame(rows, "rid bigint, ann_search double, t double")
    return df.withColumn("arrival_ts", F.timestamp_seconds(F.col("t") + F.lit(1704067200.0))).drop("t")


def _stream(spark, df, name):
    path = scratch.new_dir(spark, f"t-{name}")
    jobs.stage_files(df, path, "rid", files=5)
    return jobs.file_stream(spark, path, df.schema)


def test_slo_monitor_equals_batch(spark, reqs):
    out = jobs.slo_monitor_stream(_stream(spark, reqs, "slo"), "ann_search", 0.15, scratch.new_dir(spark, "t-slo-out"), spark)
    got = sorted((r.block, r.n, round(r.share, 9), r.alert) for r in out.where("kind = 'block' and complete").collect())
    want = sorted((r.block, r.n, round(r.share, 9), r.alert)
                  for r in tel.slo_blocks(reqs, "ann_search", 0.15).collect())
    assert got == want and len(got) == 3          # 3 full blocks, the partial one is not emitted


def test_slo_monitor_with_lost_repeated_and_late_rows_and_a_restart(spark, reqs):
    """Lost rows: reported incomplete after the wait.  Repeated rows count once.  Rows after
    the report and rows older than the watermark are counted, and a restart goes on."""
    src, out, ckpt = (scratch.new_dir(spark, f"t-slo-{x}") for x in ("in", "out", "ckpt"))
    jobs.stage_files(reqs.where("rid <> 500 and rid < 1500").unionByName(reqs.where("rid between 1000 and 1100")), src, "rid", 3)

    def run():
        return jobs.slo_monitor_stream(jobs.file_stream(spark, src, reqs.schema), "ann_search", 0.15, out, spark,
                                       delay="4 hours", wait_ms=6 * 3600 * 1000, checkpoint=ckpt)
    first = {(r.kind, r.block): (r.n, r.complete) for r in run().collect()}
    assert ("block", 1) not in first                       # 500 rows of block 1 so far, a hundred of them twice
    jobs.stage_files(reqs.where("rid >= 1500"), src, "rid", 3)
    run()
    # a row of block 1 after its report, inside the watermark, and ten rows of block 0 long after it
    newest = reqs.agg(F.max("arrival_ts")).first()[0]
    again = reqs.where("rid = 1999").withColumn("arrival_ts", F.lit(newest))
    jobs.stage_files(again, src, "rid", 1)
    run()
    jobs.stage_files(reqs.where("rid < 10"), src, "rid", 1)
    rows = run().collect()
    blocks = {r.block: (r.n, r.complete) for r in rows if r.kind == "block"}
    assert blocks[0] == (999, False) and blocks[1] == (1000, True) and blocks[2] == (1000, True)
    assert len([r for r in rows if r.kind == "block"]) == len(blocks)          # no block twice
    ok = {r.block: r.n for r in reqs.where("rid <> 500").groupBy(F.floor(F.col("rid") / 1000).alias("block")).agg(
        F.sum((F.col("ann_search") <= 0.15).cast("int")).alias("n")).collect()}
    for r in rows:
        if r.kind == "block":
            assert abs(r.share - ok[r.block] / blocks[r.block][0]) < 1e-12 and r.alert == (r.share < 0.9)
    assert sum(r.n for r in rows if r.kind == "dropped") == 10


def test_slo_monitor_counts_rows_after_the_report(spark, reqs):
    """Within the watermark: block 0 is reported, then three of its rows come again."""
    src = scratch.new_dir(spark, "t-slo-late")
    jobs.stage_files(reqs.where("rid < 1000"), src, "rid", 2)
    jobs.stage_files(reqs.where("rid in (1, 2, 3)"), src, "rid", 1)
    out = jobs.slo_monitor_stream(jobs.file_stream(spark, src, reqs.schema), "ann_search", 0.15,
                                  scratch.new_dir(spark, "t-slo-late-out"), spark, delay="2 days")
    got = sorted((r.kind, r.block, r.n) for r in out.collect())
    assert got == [("block", 0, 1000), ("late", 0, 3)]


def test_running_access_counters_change_nothing_when_an_epoch_is_replayed(spark, reqs):
    probes = reqs.select("rid", (F.col("rid") % 7).alias("list_id"), "arrival_ts")
    src, out, ckpt = (scratch.new_dir(spark, f"t-upd-{x}") for x in ("in", "out", "ckpt"))
    jobs.stage_files(probes.where("rid < 2000"), src, "rid", 2)
    jobs.stage_files(probes.where("rid between 2000 and 2003"), src, "rid", 1)
    want = lambda d: {r.list_id: r["count"] for r in d.groupBy("list_id").count().collect()}
    read = lambda t: {r.list_id: r.accesses for r in t.collect()}                             # noqa: E731
    table = jobs.access_stream(jobs.file_stream(spark, src, probes.schema), out, spark, checkpoint=ckpt)
    assert read(table) == want(probes.where("rid <= 2003"))
    # the last micro-batch wrote only the four counters that it changed
    last = spark.read.parquet(out).where(F.col("epoch") == spark.read.parquet(out).agg(F.max("epoch")).first()[0])
    assert last.count() == 4
    # the same epoch again, as after a crash before the commit
    rows, epoch = last.select("list_id", "accesses").checkpoint(), last.first()["epoch"]
    jobs.write_changes(out)(rows, epoch)
    assert read(jobs.access_totals(spark, out)) == want(probes.where("rid <= 2003"))
    # a restart goes on from the checkpoint
    jobs.stage_files(probes.where("rid > 2003"), src, "rid", 2)
    table = jobs.access_stream(jobs.file_stream(spark, src, probes.schema), out, spark, checkpoint=ckpt)
    assert read(table) == want(probes)


def test_tumbling_access_counters(spark, reqs):
    probes = reqs.select("rid", "arrival_ts", (F.col("rid") % 5).alias("list_id"))
    out = jobs.access_stream(_stream(spark, probes, "acc"), scratch.new_dir(spark, "t-acc-out"), spark, window="1 day")
    got = {(r.window.start, r.list_id): r.accesses for r in out.collect()}
    want = {(r.w.start, r.list_id): r.c for r in probes.groupBy(F.window("arrival_ts", "1 day").alias("w"), "list_id")
            .agg(F.count(F.lit(1)).alias("c")).collect()}
    # windows close once the watermark passes them; every emitted window is exact
    assert got and all(want[k] == v for k, v in got.items())


def test_log_join_stream(spark, reqs):
    s = reqs.select("rid", "arrival_ts", F.col("ann_search").alias("start"))
    g = reqs.select("rid", (F.col("arrival_ts") + F.expr("INTERVAL 30 SECONDS")).alias("done_ts"),
                    F.col("ann_search").alias("callback"), F.col("ann_search").alias("done"))
    out = scratch.new_dir(spark, "t-join")
    jobs.join_logs_stream(_stream(spark, s, "s"), _stream(spark, g, "g"), out, spark)
    assert spark.read.parquet(out).count() == reqs.count()


def test_log_join_counts_timed_out(spark, reqs):
    """Generation records missing for some requests: the outer join emits
    them with NULLs once the watermark has passed, so they can be counted."""
    s = reqs.select("rid", "arrival_ts", F.col("ann_search").alias("start"))
    g = (reqs.where(F.col("rid") % 10 != 3)
         .select("rid", (F.col("arrival_ts") + F.expr("INTERVAL 30 SECONDS")).alias("done_ts"),
                 F.col("ann_search").alias("callback"), F.col("ann_search").alias("done")))
    out = scratch.new_dir(spark, "t-join-outer")
    jobs.join_logs_stream(_stream(spark, s, "so"), _stream(spark, g, "go"), out, spark, delay="1 hour",
                          bound="1 hour", keep_unmatched=True)
    back = spark.read.parquet(out)
    missing = back.where(F.col("done").isNull()).select("rid")
    # rows near the end of the stream are still inside the watermark delay when
    # the replay stops; every emitted unmatched row is a truly missing one
    assert missing.where(F.col("rid") % 10 != 3).count() == 0
    assert missing.count() > 0
    assert back.where(F.col("done").isNotNull()).count() == g.count()


def test_staged_slices_fill_micro_batches_in_order_without_empty_files(spark, monkeypatch):
    """3500 rows, files of 100, five files in a micro-batch: seven slices of five files."""
    monkeypatch.setattr(jobs, "SLICE_ROWS", 100)
    df = spark.range(3500).select(F.pmod(F.col("id") * 1237, F.lit(3500)).alias("rid"))
    path = scratch.new_dir(spark, "t-slices")
    each = jobs.stage_files(df, path, "rid", batch_files=5)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.max("_metadata.file_modification_time").alias("t"))
    got = sorted(files.collect(), key=lambda r: r.t)
    on_disk = [f for f in os.listdir(scratch.local_path(path)) if f.endswith(".parquet")]
    assert each == 5 and len(got) == len(on_disk) == 35 and sum(r.n for r in got) == 3500
    for k in range(7):
        part = got[5 * k:5 * k + 5]
        assert min(r.lo for r in part) == 500 * k and max(r.hi for r in part) == 500 * k + 499


def test_staging_few_or_no_rows(spark):
    for n, files in ((0, None), (2, None), (2, 5), (3, 1)):
        path = scratch.new_dir(spark, "t-few")
        jobs.stage_files(spark.range(n).toDF("rid"), path, "rid", files)
        assert sorted(r.rid for r in spark.read.schema("rid bigint").parquet(path).collect()) == list(range(n))


def _unsteady(name: str):
    """Another value at each computation."""
    return F.udf(lambda _: uuid.uuid4().hex, "string").asNondeterministic()(name)


def test_chunk_store_is_computed_once_for_all_micro_batches(spark):
    chunks = spark.range(5).select(F.col("id").alias("chunk_id"), _unsteady("id").alias("text"))
    hits = spark.range(400).select(F.col("id").alias("rid"), (F.col("id") % 5).alias("vec_id"))
    path, out = scratch.new_dir(spark, "t-hits"), scratch.new_dir(spark, "t-docs")
    jobs.stage_files(hits, path, "rid", files=4)
    jobs.docs_stream(jobs.file_stream(spark, path, hits.schema), chunks, out, 4, spark)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 400 and len({(r.vec_id, r.text) for r in rows}) == 5


def test_early_emit_deals_both_tiers_by_one_set(spark):
    """A set of cold queries that differs when it is computed again still gives every request once."""
    cold = spark.range(200).select(F.col("id").alias("qid")).where(_unsteady("qid") < "8")
    reqs = spark.range(400).select(F.col("id").alias("rid"), (F.col("id") % 200).alias("qid"))
    path, out = scratch.new_dir(spark, "t-early"), scratch.new_dir(spark, "t-early-out")
    jobs.stage_files(reqs, path, "rid", files=2)
    jobs.early_emit_stream(jobs.file_stream(spark, path, reqs.schema), cold, out, spark)
    rids = [r.rid for t in ("hot", "cold") for r in spark.read.parquet(f"{out}/{t}").collect()]
    assert sorted(rids) == list(range(400))


def test_documents_of_a_request_are_stored_as_one_row(spark):
    """Results written by the search sink, a chunk that the store lacks, a query without any; a row
    per request in its worker's folder, so the contexts need no shuffle."""
    req = spark.createDataFrame([(r, r % 7) for r in range(90)], "rid bigint, qid bigint").repartition(5, "rid")
    hits = [(q, k, 10 * q + k, float(k)) for q in range(6) for k in range(3)] + [(6, 0, 999, 0.0)]
    res = spark.createDataFrame(hits, "qid bigint, rank bigint, vec_id bigint, dist double").repartition(6, "rank")
    src = scratch.new_dir(spark, "t-docs-in")
    rows = jobs.per_request(req, res)
    jobs.search_stream(_stream(spark, req, "docs"), lambda b: jobs.per_request(b, res), src, spark)
    assert sorted(map(tuple, rows.select("rid", "rank", "vec_id").collect())) == sorted(
        (r, k, v) for r in range(90) for q, k, v, _ in hits if q == r % 7)
    files = spark.read.parquet(src).groupBy("rid").agg(F.countDistinct(F.col("_metadata.file_path")).alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1
    store = spark.createDataFrame([(v, f"text {v}") for _, _, v, _ in hits if v not in (11, 999)], "chunk_id bigint, text string")
    out = scratch.new_dir(spark, "t-docs-out")
    schema = spark.read.parquet(src).schema
    jobs.docs_stream(jobs.file_stream(spark, src, schema, 3).select("rid", "qid", "rank", "vec_id"), store, out, 4, spark)
    back = spark.read.schema(jobs.DOCS_OUT).parquet(out)
    got = {r.rid: (r.worker, [(d["rank"], d.text) for d in r.docs]) for r in back.collect()}
    assert back.count() == len(got)
    assert got == {r: (r % 4, [(k, f"text {v}") for q, k, v, _ in hits if q == r % 7 and v not in (11, 999)])
                   for r in range(90) if r % 7 < 6}
