"""Structured Streaming jobs (STR1-6).

The reference passes requests between threads through in-memory queues with
no event time; here requests are a file stream, results go to file sinks
with checkpoints in the shared ``spark.checkpoint.dir`` (restartable), and
every job is run with ``trigger(availableNow=True)`` so a replay processes
exactly the files present.  Event time is the request's arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ragspark.functions.ranks import global_rank, snapshot
from ragspark.sources import scratch


SLICE_ROWS = 250_000         # rows of a file


def stage_files(df: DataFrame, path: str, order: str, files: int | None = None, batch_files: int = 1) -> int:
    """Write a derived table as ``files`` (slices; by default at least 4) equal ranges of
    ``order``, one after the other, so file modification times follow event order
    the way an arriving stream's files do (the file source reads oldest first).

    A slice is one micro-batch: up to ``batch_files`` files of about ``SLICE_ROWS``
    rows, so larger input fills the micro-batches before it makes more of them.
    Rows are cut into a folder per slice in one pass and each slice reads its own
    folder only.  Returns the files of a slice (one if ``files`` is given)."""
    spark = df.sparkSession
    df = snapshot(df, "stage")               # computed once, then counted and ranked
    n = df.count()
    slices, each = files, 1
    if slices is None:
        slices = max(4, -(-n // (SLICE_ROWS * batch_files)))
        each = max(1, -(-n // (SLICE_ROWS * slices)))
    if n == 0:
        df.coalesce(1).write.mode("append").parquet(path)
        return each
    cut = scratch.new_dir(spark, "slices")
    (global_rank(df, [order], out="_at").withColumn("_slice", F.expr(f"_at * {slices} div {n}")).drop("_at")
     .write.partitionBy("_slice").parquet(cut))
    for k in range(slices) if n >= slices else sorted({at * slices // n for at in range(n)}):
        (spark.read.schema(df.schema).parquet(f"{cut}/_slice={k}").repartition(each).sortWithinPartitions(order)
         .write.mode("append").parquet(path))
    return each


def file_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_to_end(writer, name: str, spark: SparkSession, checkpoint: str | None = None) -> int:
    """Run until the present files are read; ``checkpoint`` continues an earlier
    run.  Returns the rows that stateful operators dropped as older than the watermark."""
    ckpt = checkpoint or scratch.new_dir(spark, f"stream-ckpt-{name}")
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sum(int(o.numRowsDroppedByWatermark) for p in q.recentProgress for o in p.stateOperators)


# ------------------------------------------------------------------- STR1
def search_stream(requests: DataFrame, search_batch: Callable[[DataFrame], DataFrame], out_path: str,
                  spark: SparkSession) -> None:
    """STR1: every micro-batch is one search batch; ``search_batch`` maps the
    batch's (rid, qid) rows to results.  Output goes to ``epoch=<id>`` folders
    with overwrite, so a retried epoch replaces, never duplicates."""
    def handle(bdf: DataFrame, epoch: int) -> None:
        res = search_batch(bdf)
        res.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(f"{out_path}/epoch={epoch}")
    run_to_end(requests.writeStream.foreachBatch(handle), "search", spark)


def per_request(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The result rows of every request's query.  A query's rows travel as one and are
    taken apart after the join, so a request's rows lie in one file."""
    rest = [c for c in results.columns if c != "qid"]
    lists = results.groupBy("qid").agg(F.collect_list(F.struct(*rest)).alias("_r"))
    return requests.join(lists, "qid").select(*requests.columns, F.inline("_r"))


# ------------------------------------------------------------------- STR2
DOCS_OUT = "rid bigint, docs array<struct<rank: bigint, text: string>>, worker int"


def docs_stream(results: DataFrame, chunks: DataFrame, out_path: str, workers: int, spark: SparkSession) -> None:
    """STR2: stream-static join of results with the chunk store; rows land in
    per-worker folders (worker = rid mod workers).  The store is written once, not
    computed again by every micro-batch.

    Results (rid, rank, vec_id) give a row per result.  With their query ``qid`` they give
    a row per request (``DOCS_OUT``): a request's results lie in one file (``per_request``),
    so in one micro-batch, whose texts meet per query, not per request; a query's
    requests are written side by side, where their equal texts compress.  An
    epoch then has its own folder, written with overwrite, so a retried epoch replaces,
    never duplicates."""
    store = snapshot(chunks.select(F.col("chunk_id").alias("vec_id"), "text"), "store")
    worker = F.pmod("rid", F.lit(workers)).cast("int")
    if "qid" not in results.columns:
        j = results.join(store, "vec_id").withColumn("worker", worker)
        run_to_end(j.writeStream.format("parquet").option("path", out_path).partitionBy("worker").outputMode("append"),
                   "docs", spark)
        return
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def handle(bdf: DataFrame, epoch: int) -> None:
        top = bdf.select("qid", "rank", "vec_id").distinct()
        docs = top.join(store, "vec_id").repartition(parts, "qid").groupBy("qid").agg(
            F.array_sort(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), "text"))).alias("docs"))
        asked = bdf.select("rid", "qid").distinct().repartition(parts, "qid")
        (asked.join(docs, "qid").withColumn("worker", worker)
         .sortWithinPartitions("worker", "qid", "rid").select("rid", "docs", "worker")
         .write.mode("overwrite").option("compression", "zstd").partitionBy("worker").parquet(f"{out_path}/epoch={epoch}"))
    run_to_end(results.writeStream.foreachBatch(handle), "docs", spark)


# ------------------------------------------------------------------- STR3
def join_logs_stream(search: DataFrame, gen: DataFrame, out_path: str, spark: SparkSession,
                     delay: str = "2 hours", bound: str = "2 hours", keep_unmatched: bool = False) -> None:
    """STR3: stream-stream join on rid; both sides carry watermarks and the
    join is bounded in event time (a generation record must complete within
    ``bound`` of the arrival), so join state is dropped - the reference waits
    forever instead.  With ``keep_unmatched`` it is a left outer join: a
    search record whose generation record never arrives is emitted with NULLs
    once the watermark passes its bound, so timed-out requests are counted,
    not lost."""
    s = search.withWatermark("arrival_ts", delay).alias("s")
    g = gen.withWatermark("done_ts", delay).alias("g")
    cond = ((F.col("s.rid") == F.col("g.rid")) & (F.col("g.done_ts") >= F.col("s.arrival_ts"))
            & (F.col("g.done_ts") <= F.col("s.arrival_ts") + F.expr(f"INTERVAL {bound}")))
    how = "left_outer" if keep_unmatched else "inner"
    j = s.join(g, cond, how).select("s.rid", "s.start", "g.callback", "g.done")
    run_to_end(j.writeStream.format("parquet").option("path", out_path).outputMode("append"), "joinlogs", spark)


# ------------------------------------------------------------------- STR4
def access_stream(probes: DataFrame, out_path: str, spark: SparkSession, window: str | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """STR4: live list-access counters; ``window`` resets them per event-time
    window (tumbling) instead of keeping running totals.

    Windows are appended to a Parquet table.  Running totals are written in update
    mode: a micro-batch writes only the counters that it changed, into its own
    ``epoch=<id>`` folder with overwrite, so a batch that is run again replaces
    its rows and changes nothing.  Returns the table (``access_totals`` for totals)."""
    if window:
        agg = (probes.withWatermark("arrival_ts", window)
               .groupBy(F.window("arrival_ts", window), "list_id").agg(F.count(F.lit(1)).alias("accesses")))
        run_to_end(agg.writeStream.outputMode("append").format("parquet").option("path", out_path), "access", spark, checkpoint)
        return spark.read.schema(agg.schema).parquet(out_path)
    agg = probes.groupBy("list_id").agg(F.count(F.lit(1)).alias("accesses"))
    run_to_end(agg.writeStream.outputMode("update").foreachBatch(write_changes(out_path)), "access", spark, checkpoint)
    return access_totals(spark, out_path)


def write_changes(out_path: str) -> Callable[[DataFrame, int], None]:
    """Writes the changed counters of a micro-batch as its epoch's folder."""
    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
    return write


def access_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """The counters as of the last epoch that changed each."""
    rows = spark.read.schema("list_id bigint, accesses bigint, epoch bigint").parquet(out_path)
    return rows.groupBy("list_id").agg(F.max_by("accesses", "epoch").alias("accesses"))


# ------------------------------------------------------------------- STR5
SLO_OUT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("share", T.DoubleType()), T.StructField("alert", T.BooleanType()),
                        T.StructField("complete", T.BooleanType())])
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SloBlocks(StatefulProcessor):
    """One block of consecutive requests: which of them came (a bit each), how
    many met the objective, whether the block was reported, when it is given up."""

    def __init__(self, block_size: int, wait_ms: int):
        self.size, self.wait = block_size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", "seen binary, hits bigint, reported boolean, due bigint")

    @staticmethod
    def _row(kind: str, key, n: int, hits: int = 0, complete: bool | None = None) -> pd.DataFrame:
        share = hits / n if n and kind == "block" else None
        alert = bool(share < 0.9) if share is not None else None
        return pd.DataFrame({"kind": [kind], "block": [int(key[0])], "n": [n], "share": [share], "alert": [alert],
                             "complete": [complete]}).astype({"share": "float64", "alert": "object", "complete": "object"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else (bytes(-(-self.size // 8)), 0, False, 0)
        seen, hits, reported, due = np.unpackbits(np.frombuffer(old[0], np.uint8)), int(old[1]), bool(old[2]), int(old[3])
        newest, late, again = 0, 0, 0
        for pdf in rows:
            newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
            if reported:
                late += len(pdf)
                continue
            pdf = pdf.sort_values("ok", ascending=False, kind="stable").drop_duplicates("pos") if pdf["pos"].duplicated().any() else pdf
            new = seen[pdf["pos"].to_numpy()] == 0
            again += int((~new).sum())
            seen[pdf["pos"].to_numpy()[new]] = 1
            hits += int(pdf["ok"].to_numpy()[new].sum())
        n = int(seen.sum())
        if not reported and n >= self.size:
            reported = True
            yield self._row("block", key, n, hits, True)
        if late:
            yield self._row("late", key, late)
        if newest + self.wait > due:
            if due:
                self.handle.deleteTimer(due)
            due = max(newest, int(timerValues.getCurrentWatermarkInMs()) + 1) + self.wait
            self.handle.registerTimer(due)
        self.state.update((np.packbits(seen).tobytes(), hits, reported, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            seen, hits, reported, _ = self.state.get()
            self.state.clear()
            if not reported:
                yield self._row("block", key, int(np.unpackbits(np.frombuffer(seen, np.uint8)).sum()), int(hits), False)

    def close(self) -> None:
        pass


def slo_monitor_stream(requests: DataFrame, latency: str, slo: float, out_path: str, spark: SparkSession,
                       block_size: int = 1000, delay: str = "1 hour", wait_ms: int = 24 * 3600 * 1000,
                       checkpoint: str | None = None) -> DataFrame:
    """STR5: per block of ``block_size`` consecutive requests a typed state: a bit
    per request, so repeated rows count once, and the number within the
    objective.  A complete block is reported (alert below 0.9) and only remembered
    as reported until its timer, ``wait_ms`` of event time after its newest row; a
    block still incomplete then is reported as it is (``complete`` false).  So a
    lost request neither keeps its state for ever nor hides an alert, and a row
    that comes after the report opens no second one.

    Such late rows are counted per block in rows of kind ``late``; rows older than
    the watermark, which the engine drops before any state, in a row of kind
    ``dropped`` (block NULL) per run.  Keyed by block, the result does not depend
    on arrival order.  Returns the table (kind, block, n, share, alert, complete)."""
    rid = F.col("rid")
    rows = requests.withWatermark("arrival_ts", delay).select(
        F.floor(rid / block_size).cast("bigint").alias("block"), F.pmod(rid, F.lit(block_size)).cast("int").alias("pos"),
        F.col("arrival_ts").alias("ts"), F.coalesce(F.col(latency) <= F.lit(slo), F.lit(False)).alias("ok"))
    conf, key = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, _ROCKS)                    # typed state needs this store
    try:
        out = rows.groupBy("block").transformWithStateInPandas(SloBlocks(block_size, wait_ms), SLO_OUT, "append", "eventTime")
        lost = run_to_end(out.writeStream.format("parquet").option("path", f"{out_path}/rows").outputMode("append"), "slo", spark,
                          checkpoint)
    finally:
        conf.set(key, before) if before else conf.unset(key)
    if lost:
        spark.createDataFrame([("dropped", None, lost, None, None, None)], SLO_OUT).write.mode("append").parquet(f"{out_path}/dropped")
    got = spark.read.schema(SLO_OUT).parquet(f"{out_path}/rows")
    more = spark.createDataFrame([], SLO_OUT) if not lost else spark.read.schema(SLO_OUT).parquet(f"{out_path}/dropped")
    return got.unionByName(more)


# ------------------------------------------------------------------- STR6
def early_emit_stream(requests: DataFrame, cold_qids: DataFrame, out_path: str, spark: SparkSession) -> None:
    """STR6: two append queries into one sink - requests whose query has no
    cold probe are emitted by the first (answerable from the device tier),
    the others by the second; every rid lands exactly once, both queries being
    dealt by the same stored set."""
    cold_qids = snapshot(cold_qids, "cold")
    hot = requests.join(cold_qids, "qid", "left_anti").withColumn("tier", F.lit("hot"))
    cold = requests.join(cold_qids, "qid", "left_semi").withColumn("tier", F.lit("cold"))
    for name, df in (("hot", hot), ("cold", cold)):
        run_to_end(df.select("rid", "qid", "tier").writeStream.format("parquet")
                   .option("path", f"{out_path}/{name}").outputMode("append"), f"early-{name}", spark)
