"""Role bindings: how the driver tables play the reference's inputs.

Every binding reads whole tables; the same formulas appear in the oracle SQL
(``ragspark.plans.sqlparts``).  Nothing here samples or caps rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.ranks import global_rank

# Fixed parameters of the bindings (FIXTURES.md section 3).
NPROBE = 4
TOPK = 10
SHARDS = 3
EPOCH0_US = 1704067200 * 1_000_000   # 2024-01-01 00:00:00 UTC
BATCH_SECONDS = 3600
TTFT_SLO = 1800.0
OUTPUT_LEN = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_order(col: str | Column) -> Column:
    """32-bit md5 prefix as BIGINT; DuckDB: ('0x'||substr(md5(x),1,8))::BIGINT."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is also a query (qid = vec_id): the whole table is searched."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")


def auto_nlist(vecs: DataFrame) -> DataFrame:
    """VEC4: one-row frame with nlist = floor(sqrt(n))."""
    return vecs.agg(F.floor(F.sqrt(F.count(F.lit(1)))).cast("bigint").alias("nlist"))


def hash_ranked(vecs: DataFrame) -> DataFrame:
    """(vec_id, hrank): every vector's position in seeded hash order."""
    return global_rank(vecs.select("vec_id").withColumn("_h", hash_order("vec_id")), ["_h", "vec_id"],
                       out="hrank").drop("_h")


def fixed_centroids(vecs: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Deterministic init: the floor(sqrt(n)) vectors first in hash order,
    numbered 0.. in that order -> (list_id, centroid)."""
    nlist = auto_nlist(vecs).first()["nlist"]
    # rank ids only (the snapshot stays narrow), then fetch the nlist vectors
    ranked = ranked if ranked is not None else hash_ranked(vecs)
    chosen = ranked.where(F.col("hrank") < nlist).select("vec_id", F.col("hrank").alias("list_id"))
    return chosen.join(vecs, "vec_id").select("list_id", F.col("embedding").alias("centroid"))


# ---------------------------------------------------------------- request log
def _arrival(ts: str = "ts") -> Column:
    """Seconds since 2024-01-01 of a zone-less timestamp; independent of the
    session time zone (a difference of two TIMESTAMP_NTZ values)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})") / F.lit(1e6)


def request_base(spark: SparkSession, sf_dir: str, batch_seconds: int = BATCH_SECONDS) -> DataFrame:
    """events -> one row per request with the fixture's derived timestamps.

    rid is the dense rank by (ts, event_id), computed distributed.  Batch
    columns are aggregates over batch_id (a shuffle by batch_id, not a
    global window).
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = global_rank(ev, ["ts", "event_id"], out="rid")
    ev = (ev.withColumn("arrival", _arrival())
          .withColumn("batch_id", F.floor(F.col("arrival") / F.lit(float(batch_seconds))).cast("bigint")))
    per_batch = ev.groupBy("batch_id").agg(F.count(F.lit(1)).cast("int").alias("batch_size"),
                                           F.max("arrival").alias("last_arrival"))
    ev = ev.join(per_batch, "batch_id")
    start = F.col("last_arrival") + (F.col("batch_id") % 7) / F.lit(100.0)
    callback = start + F.lit(0.05) + F.col("value") / F.lit(1000.0)
    submit = callback + (F.col("event_id") % 13) / F.lit(1000.0)
    first = submit + F.lit(0.1) + (F.col("user_id") % 10) / F.lit(100.0)
    done = first + F.lit(1.0) + (F.col("event_id") % 29) / F.lit(10.0)
    return (ev.withColumn("start", start).withColumn("callback", callback).withColumn("submit", submit)
            .withColumn("first_token", first).withColumn("done", done)
            .withColumn("hit_rate", (F.col("event_id") % 5) / F.lit(4.0))
            .withColumn("mode", F.col("event_type"))
            .withColumn("rate", ((F.col("user_id") % 5) * 8 + 8).cast("int"))
            .withColumn("ngpu", (F.lit(8) - (F.col("user_id") % 3) * 2).cast("int"))
            .withColumn("dispatcher", (F.col("event_id") % 2) == 0)
            .withColumn("input_len", F.when(F.col("user_id") % 4 == 0, 512)
                        .when(F.col("user_id") % 4 == 3, 2048).otherwise(1024).cast("int"))
            .withColumn("output_len", F.when(F.col("event_id") % 3 == 0, 128)
                        .when(F.col("event_id") % 3 == 1, 256).otherwise(512).cast("int"))
            .withColumn("slo_ms", (F.lit(100) + (F.col("event_id") % 4) * 50).cast("int"))
            .withColumn("run_day", F.floor(F.col("arrival") / F.lit(86400.0)).cast("bigint")))


RUN_COLS = ["mode", "rate", "ngpu", "dispatcher", "input_len", "output_len", "slo_ms", "run_day"]


def requests(spark: SparkSession, sf_dir: str, batch_seconds: int = BATCH_SECONDS,
             completed_only: bool = False, keep_unmatched: bool = False) -> DataFrame:
    """Wide per-request table (TEL5-7 + TEL14 idle) from the two logs.

    ``completed_only`` keeps the generation log to requests finished by the
    last arrival (a run's horizon), leaving the rest without a gen row;
    ``keep_unmatched`` keeps those search rows with NULL generation metrics.
    """
    from ragspark.operators import telemetry as tel
    base = request_base(spark, sf_dir, batch_seconds)
    gen = gen_log(base)
    if completed_only:
        horizon = base.agg(F.max("arrival").alias("_h"))
        gen = gen.crossJoin(F.broadcast(horizon)).where(F.col("done") <= F.col("_h")).drop("_h")
    search = search_log(base).join(base.select("rid", *[c for c in RUN_COLS if c not in ("mode", "rate")]), "rid")
    joined = search.join(gen, "rid", "left") if keep_unmatched else tel.join_logs(search, gen)
    req = tel.stages(joined, "output_len")
    idle = tel.batch_idle(base).select("batch_id", F.col("idle").alias("ann_idle"))
    return req.join(idle, "batch_id", "left")


def search_log(base: DataFrame) -> DataFrame:
    """Search-side log (9 fields of the reference's batch record)."""
    bd = F.array(*[(F.lit(float(i + 1)) * F.col("value") / F.lit(100000.0)) for i in range(6)])
    return base.select("rid", "batch_id", "batch_size", "arrival", "last_arrival", "start",
                       bd.alias("breakdown"), "hit_rate", "mode", "rate")


def gen_log(base: DataFrame) -> DataFrame:
    return base.select("rid", "callback", "submit", "first_token", "done")

