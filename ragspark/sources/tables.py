"""Table-shaped sources and sinks (SRC6-12, SRC14-21): TSV query files,
per-request results partitioned by run with a separate run table, summary
CSV files with '# k=v' headers, upserts, done-manifests, token files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.ranks import global_rank
from ragspark.functions.stats import join_null_safe
from ragspark.operators.placement import maybe_broadcast
from ragspark.operators.text import WS, parse_kv

# Metric labels used in summary files, in the reference's order.
CSV_NAMES = [
    ("ann_idle", "Idle"), ("ann_queue", "Queuing"), ("ann_batch", "Batching"), ("ann_pending", "Pending"),
    ("ann_search", "Search"), ("ann_e2e", "ANNS E2E"), ("quantize", "Quantize"), ("lut_compute", "LUT Computed"),
    ("lut_scan", "LUT Scan"), ("hit_rate", "Hit Rate"), ("llm_queue", "LLM Queuing"), ("prefill", "Prefill"),
    ("tpot", "TPOT"), ("ttft", "TTFT"), ("e2e", "End2End"),
]
SHORT_ROWS = [("avg_batch_size", "Batch Size"), ("total_time", "Total Time"), ("rps", "Avg RPS")]
# Which rows a summary has, in order; the modes with a host tier.
_SEARCH_ROWS = ["ann_idle", "ann_batch", "ann_pending", "ann_queue", "ann_search", "ann_e2e"]
_HOST_ROWS, HOST_MODES = ["quantize", "lut_compute", "lut_scan"], ("cpu", "vlite")
_LAST_ROWS = ["llm_queue", "prefill", "tpot", "e2e"]


# ------------------------------------------------------------------ TSV
def write_tsv(df: DataFrame, path: str) -> None:
    """Query file: header line, tab separated, sorted by the first column."""
    first = df.columns[0]
    df.orderBy(first).write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def read_query_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: TSV with a header; key = running index in file order (file name,
    then position in the file), value = second column, ids of any form."""
    raw = (spark.read.option("sep", "\t").option("header", True).option("multiLine", True)
           .schema("src_qid string, text string").csv(path))
    placed = raw.select("src_qid", "text", F.col("_metadata.file_name").alias("_file"),
                        F.monotonically_increasing_id().alias("_at"))
    return global_rank(placed, ["_file", "_at"], out="qid").select("qid", "src_qid", "text")


# ------------------------------------------------------------- requests
FILE_ROWS = 1_000_000        # rows of a run that one task writes


def write_requests(req: DataFrame, path: str, runs_path: str | None = None,
                   run_cols: Sequence[str] = (), keys: Sequence[str] = ("mode", "rate")) -> None:
    """SRC9: per-request rows partitioned by run key; run configuration goes
    to a separate small ``runs`` table keyed by ``run_id``."""
    keys = list(keys)
    if runs_path and run_cols:
        runs = req.select(*keys, *run_cols).distinct()
        runs = global_rank(runs, [*keys, *run_cols], out="run_id")
        runs.write.mode("overwrite").parquet(runs_path)
        n_runs = runs.count()
        req = join_null_safe(req, maybe_broadcast(runs, n_runs, 64), [*keys, *run_cols]).drop(*run_cols)
    # a run's rows meet in as many files as its size asks for: a row of counts per run, sent along
    sizes = req.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("_files"))
    req = join_null_safe(req, maybe_broadcast(sizes, sizes.count(), 64), keys)
    req = req.repartition(*keys, F.pmod(F.xxhash64(*req.columns[:1]), F.col("_files"))).drop("_files")
    req.write.partitionBy(*keys).mode("overwrite").parquet(path)


def read_requests(spark: SparkSession, path: str, runs_path: str) -> DataFrame:
    """SRC10: read the results back and re-attach the run configuration."""
    runs = spark.read.parquet(runs_path)
    n_runs = runs.count()
    return spark.read.parquet(path).join(maybe_broadcast(runs.drop("mode", "rate"), n_runs, 64), "run_id")


# -------------------------------------------------------------- summary
def write_summary(summary: DataFrame, extra: DataFrame, path: str, keys: Sequence[str]) -> None:
    """SRC11: one text file per run: '# k=v' lines in name order and a bare '#',
    the metric header, then the rows that the run's mode has.  ``extra`` holds,
    per run, ``search_mode`` (NULL: no search), ``search_slo`` and the values of the
    short rows.  With a search come its stages and the batch size, the host
    stages in modes with a host tier, the hit rate where there is an objective;
    generation stages, total time and mean rate always.  A run is a few dozen
    lines written by one task in order; numbers have six decimals."""
    keys = list(keys)
    search = F.col("search_mode").isNotNull()
    host, slo = search & F.col("search_mode").isin(*HOST_MODES), search & (F.col("search_slo") > 0)
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))          # noqa: E731
    head = extra.select(*keys, F.explode(F.concat(
        F.array(*[F.struct(F.lit(i).alias("ord"), F.concat(F.lit(f"# {k}="), F.col(k).cast("string")).alias("value"))
                  for i, k in enumerate(sorted(keys))]),
        F.array(F.struct(F.lit(99).alias("ord"), F.lit("#").alias("value")),
                F.struct(F.lit(100).alias("ord"), F.lit("Metric,Avg,P50,P90,P95").alias("value"))))).alias("_s"))
    rows = [(m, search) for m in _SEARCH_ROWS] + [(m, host) for m in _HOST_ROWS] + [("hit_rate", slo), ("avg_batch_size", search)]
    rows += [(m, F.lit(True)) for m in [*_LAST_ROWS, "total_time", "rps"]]
    short, label = dict(SHORT_ROWS), dict([*CSV_NAMES, *SHORT_ROWS])
    wanted = extra.select(*keys, *short, F.explode(F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(200 + i).alias("ord"), F.lit(m).alias("metric"), F.lit(label[m]).alias("label")))
        for i, (m, cond) in enumerate(rows)]))).alias("_w")).select(*keys, *short, "_w.*")
    body = join_null_safe(wanted, summary, [*keys, "metric"], "left")
    own = F.coalesce(*[F.when(F.col("metric") == m, number(m)) for m in short])
    full = F.concat_ws(",", *[number(c) for c in ("avg", "p50", "p90", "p95")])
    body = body.select(*keys, F.struct("ord", F.concat_ws(",", "label", F.when(F.col("metric").isin(*short), own).otherwise(full))
                                       .alias("value")).alias("_s"))
    lines = head.unionByName(body).select(*keys, "_s.ord", "_s.value")
    (lines.repartition(*keys).sortWithinPartitions(*keys, "ord").drop("ord")
     .write.partitionBy(*keys).mode("overwrite").text(path))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: every row of the body: metric rows with their four numbers, short
    rows with the one they have (the others NULL).  Comments and the header line
    are left out; a label that is not known stays as it is."""
    lines = spark.read.text(path)
    names = spark.createDataFrame([*CSV_NAMES, *SHORT_ROWS], "metric string, label string")
    body = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("Metric,") & (F.trim("value") != ""))
    parts = body.withColumn("_p", F.split("value", ","))
    rows = parts.select(
        *[c for c in lines.columns if c != "value"], F.col("_p")[0].alias("label"),
        *[F.get("_p", F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(("avg", "p50", "p90", "p95"))])
    return rows.join(F.broadcast(names), "label", "left").withColumn("metric", F.coalesce("metric", "label")).drop("label")


def read_summary_header(spark: SparkSession, path: str) -> DataFrame:
    """The '# k=v' lines of every summary file as typed values."""
    lines = spark.read.text(path).where(F.col("value").startswith("#"))
    lines = lines.withColumn("line", F.trim(F.expr("substring(value, 2)"))).where(F.col("line").contains("="))
    return parse_kv(lines, "line")


# --------------------------------------------------- upsert, manifests
def upsert(base: DataFrame, upd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRC17: rows of ``upd`` replace rows of ``base`` with the same key, the
    rest append (a merge without a table format: anti join + union)."""
    return base.join(upd.select(*keys).distinct(), list(keys), "left_anti").unionByName(upd)


def todo(all_keys: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRC20: work whose output does not exist yet."""
    return all_keys.join(done.select(*keys).distinct(), list(keys), "left_anti")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """SRC21: a text file read as one whitespace-separated token list."""
    lines = spark.read.text(path)
    return lines.select(F.explode(F.split("value", WS)).alias("token")).where(F.col("token") != "")
