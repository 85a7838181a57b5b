"""Registered source / sink queries (SRC*) with their oracle SQL.

Every sink writes into a fresh folder under ``spark.checkpoint.dir`` and
returns what Spark reads back, so the round trip is what gets checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.rounding import round_to

from ragspark.operators import latency as lt
from ragspark.operators import placement as pl
from ragspark.operators import telemetry as tel
from ragspark.operators import text as tx
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp
from ragspark.plans.index_plans import State
from ragspark.plans.model_plans import RANGE_W, _LAT_COLS, _LAT_SQL, _fit_sql
from ragspark.plans.text_plans import SENT
from ragspark.sources import catalog as cat
from ragspark.sources.versions import VersionedTable
from ragspark.sources import fbin
from ragspark.sources import scratch
from ragspark.sources import tables as tb

Q: dict = {}
SQL: dict = {}


def _reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def rnd(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, round_to(c, digits))
    return df


def _emb_summary(df: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return df.select(F.col(id_col).alias("vec_id"), F.size("embedding").alias("dim"),
                     round_to(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")),
                             4).alias("emb_sum"))


_EMB_SQL = """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS emb_sum FROM embeddings"""


def _write_emb(spark, sf, rows_per_file):
    path = scratch.new_dir(spark, "fbin")
    fbin.write_vectors(fx.vectors(spark, sf), path, "embedding", "vec_id", rows_per_file=rows_per_file)
    return path


@_reg("src_fbin", _EMB_SQL)
def src_fbin(spark, sf):
    """Embeddings written as one .fbin file, read back by row ranges."""
    path = _write_emb(spark, sf, 1 << 24)
    fbin.register(spark)
    df = spark.read.format("fbin").option("rowsPerPartition", 128).load(scratch.local_path(path) + "/*.fbin")
    return _emb_summary(df)


@_reg("src_fbin_multi", _EMB_SQL)
def src_fbin_multi(spark, sf):
    """Embeddings written as three numbered files and read as one table with a
    running row number across files."""
    n = fx.vectors(spark, sf).count()
    path = _write_emb(spark, sf, max(1, -(-n // 3)))
    fbin.register(spark)
    return _emb_summary(spark.read.format("fbin").load(scratch.local_path(path)))


@_reg("src_head_n", f"""{_EMB_SQL} WHERE vec_id < (SELECT count(*) // 2 FROM embeddings)""")
def src_head_n(spark, sf):
    """The first n rows of a vector file (n = half the file; fewer rows fail)."""
    n = fx.vectors(spark, sf).count()
    path = _write_emb(spark, sf, 1 << 24)
    fbin.register(spark)
    df = spark.read.format("fbin").option("limit", n // 2).load(scratch.local_path(path))
    return _emb_summary(df)


@_reg("sink_fbin", """SELECT CAST(floor(vec_id / 128) AS BIGINT) AS file_no, count(*) AS n_rows, min(vec_id) AS first_id,
  max(vec_id) AS last_id FROM embeddings GROUP BY 1""")
def sink_fbin(spark, sf):
    """Vector writer: files of 128 consecutive ids; per file, the rows read back."""
    path = _write_emb(spark, sf, 128)
    fbin.register(spark)
    df = spark.read.format("fbin").load(scratch.local_path(path))
    return (df.groupBy(F.floor(F.col("vec_id") / 128).cast("bigint").alias("file_no"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id")))


@_reg("src_ibin", f"{sp.index_ctes('cent', 'probes')} SELECT qid AS row_id, probe_rank AS pos, list_id AS id FROM probes")
def src_ibin(spark, sf):
    """Probe matrix [nq, nprobe] written as an .ibin id file and read back."""
    st = State(spark, sf)
    mat = (st.probes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("probe_rank", "list_id"))).alias("_s"))
           .select("qid", F.col("_s.list_id").alias("ids")))
    path = scratch.new_dir(spark, "ibin")
    fbin.write_vectors(mat, path, "ids", "qid", ids=True)
    df = spark.read.format("ibin").load(scratch.local_path(path))
    return df.select("row_id", F.posexplode("ids").alias("pos", "id")).select(
        "row_id", F.col("pos").cast("bigint").alias("pos"), "id")


@_reg("src_query_tsv", """SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS qid, CAST(item_id AS VARCHAR) AS src_qid, text FROM benchmark""")
def src_query_tsv(spark, sf):
    """Query TSV (qid<TAB>text with a header line) -> running index + text."""
    path = scratch.new_dir(spark, "tsv")
    tb.write_tsv(fx.table(spark, sf, "benchmark").select("item_id", "text"), path)
    return tb.read_query_tsv(spark, path)


@_reg("src_text_scan", f"WITH {SENT} SELECT chunk_id, text FROM chunks")
def src_text_scan(spark, sf):
    """Chunk store written as Parquet and scanned back in key order."""
    path = scratch.new_dir(spark, "chunks")
    tx.chunk(fx.table(spark, sf, "documents")).select("chunk_id", "text").write.parquet(path)
    return spark.read.parquet(path).orderBy("chunk_id")


_ST = sp.stages_cte()


@_reg("sink_requests", f"WITH {_ST} SELECT rid, mode, rate, round(ttft, 6) AS ttft, round(e2e, 6) AS e2e FROM st")
def sink_requests(spark, sf):
    """Per-request results written partitioned by run (mode, rate)."""
    path = scratch.new_dir(spark, "requests")
    tb.write_requests(fx.requests(spark, sf), path)
    back = spark.read.parquet(path)
    return rnd(back.select("rid", "mode", "rate", "ttft", "e2e"), 6, "ttft", "e2e")


@_reg("src_requests", f"""WITH {_ST} SELECT rid, mode, rate, ngpu, input_len, output_len, round(ttft, 6) AS ttft FROM st""")
def src_requests(spark, sf):
    """Results read back and re-attached to the run table (broadcast join)."""
    path = scratch.new_dir(spark, "requests")
    runs_path = scratch.new_dir(spark, "runs")
    req = fx.requests(spark, sf)
    tb.write_requests(req.select("rid", "mode", "rate", "ttft", "ngpu", "input_len", "output_len"), path,
                      runs_path=runs_path, run_cols=["ngpu", "input_len", "output_len"])
    out = tb.read_requests(spark, path, runs_path)
    return rnd(out.select("rid", "mode", "rate", "ngpu", "input_len", "output_len", "ttft"), 6, "ttft")


# search mode of each event type (README): hybrid, host, device-only, no search
_MODES = {"view": "vlite", "click": "cpu", "purchase": "all-gpu", "error": "ded-gpu"}
_HAS = {"ann": "mode <> 'signup'", "host": "mode IN ('view', 'click')", "slo": "mode <> 'signup'"}


def _summary_sql():
    rows = {m: _HAS["ann"] for m in tb._SEARCH_ROWS} | {m: _HAS["host"] for m in tb._HOST_ROWS} | {"hit_rate": _HAS["slo"]}
    rows |= {m: "true" for m in tb._LAST_ROWS}
    unp = " UNION ALL ".join(
        f"SELECT mode, rate, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM st WHERE {cond}" for m, cond in rows.items())
    return f"""WITH {_ST}, lg AS ({unp}),
g AS (SELECT mode, rate, count(*) AS n, max_by(done, rid) - min_by(arrival, rid) AS total_time FROM st GROUP BY mode, rate),
bs AS (SELECT mode, rate, avg(batch_size) AS b FROM (SELECT DISTINCT mode, rate, batch_id, batch_size FROM st) d GROUP BY mode, rate)
SELECT mode, rate, metric, round(coalesce(avg(value), 0), 6) AS avg, round(coalesce(quantile_cont(value, 0.5), 0), 6) AS p50,
  round(coalesce(quantile_cont(value, 0.9), 0), 6) AS p90, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95
FROM lg GROUP BY mode, rate, metric
UNION ALL SELECT mode, rate, 'avg_batch_size', round(b, 6), NULL, NULL, NULL FROM bs WHERE {_HAS['ann']}
UNION ALL SELECT mode, rate, 'total_time', round(total_time, 6), NULL, NULL, NULL FROM g
UNION ALL SELECT mode, rate, 'rps', round(CASE WHEN total_time > 0 THEN n / total_time ELSE 0.0 END, 6), NULL, NULL, NULL FROM g"""


def _write_summary(spark, sf):
    req = fx.requests(spark, sf)
    summ = rnd(tel.summarize(req, ["mode", "rate"]), 6, "avg", "p50", "p90", "p95")
    extra = tel.avg_batch(req, ["mode", "rate"]).join(tel.throughput(req, ["mode", "rate"]), ["mode", "rate"])
    slo = req.groupBy("mode", "rate").agg(F.min("slo_ms").alias("search_slo"))
    mode = F.create_map(*[F.lit(x) for kv in _MODES.items() for x in kv])[F.col("mode")]
    extra = rnd(extra.join(slo, ["mode", "rate"]).withColumn("search_mode", mode), 6, "avg_batch_size", "total_time", "rps")
    path = scratch.new_dir(spark, "summary")
    tb.write_summary(summ, extra, path, ["mode", "rate"])
    return path


@_reg("sink_summary", f"""WITH {_ST}, runs AS (SELECT DISTINCT mode, rate FROM st)
SELECT mode, rate, CAST(3 AS BIGINT) AS header_lines,
  CAST(CASE WHEN {_HAS['host']} THEN 14 WHEN {_HAS['ann']} THEN 11 ELSE 4 END AS BIGINT) AS metric_rows,
  CAST(CASE WHEN {_HAS['ann']} THEN 3 ELSE 2 END AS BIGINT) AS short_rows FROM runs""")
def sink_summary(spark, sf):
    """Summary CSV per run: '# k=v' header lines, the metric rows that the run's mode
    has, the short rows (batch size, total time, mean rps); counted back by kind."""
    path = _write_summary(spark, sf)
    lines = spark.read.text(path)
    kind = (F.when(F.col("value").startswith("#"), "header")
            .when(F.col("value").startswith("Metric,"), "columns")
            .when(F.size(F.split("value", ",")) == 5, "metric").otherwise("short"))
    g = lines.withColumn("kind", kind).groupBy("mode", "rate").agg(
        F.count(F.when(F.col("kind") == "header", 1)).alias("header_lines"),
        F.count(F.when(F.col("kind") == "metric", 1)).alias("metric_rows"),
        F.count(F.when(F.col("kind") == "short", 1)).alias("short_rows"))
    return g


@_reg("src_summary", _summary_sql())
def src_summary(spark, sf):
    """Summary CSV parsed back: comments split from the body, every metric and short row typed."""
    path = _write_summary(spark, sf)
    return tb.read_summary(spark, path).select("mode", "rate", "metric", "avg", "p50", "p90", "p95")


@_reg("sink_list_meta", f"""{sp.index_ctes('cent', 'asg', 'sizes')}
SELECT count(*) AS nlist, CAST(sum(n) AS BIGINT) AS ntotal, round(avg(n), 6) AS avg_size, max(n) AS max_size, min(n) AS min_size FROM sizes""")
def sink_list_meta(spark, sf):
    """List sizes and their one-row statistics written and read back."""
    st = State(spark, sf)
    path = scratch.new_dir(spark, "list_meta")
    st.sizes.write.parquet(path + "/list_sizes")
    pl.size_stats(spark.read.parquet(path + "/list_sizes")).write.parquet(path + "/stats")
    out = spark.read.parquet(path + "/stats")
    return rnd(out.withColumn("ntotal", F.col("ntotal").cast("bigint")), 6, "avg_size")


@_reg("sink_placement", f"{sp.index_ctes(*sp.INDEX_ALL[:8])} SELECT list_id, shard, local_id FROM place")
def sink_placement(spark, sf):
    """Placement map written as a table and read back."""
    st = State(spark, sf)
    path = scratch.new_dir(spark, "placement")
    st.placement().select("list_id", "shard", "local_id").write.parquet(path)
    return spark.read.parquet(path)


@_reg("sink_hot_stats", f"""{sp.index_ctes('cent', 'probes', 'freq', 'cdf', 'half')}
SELECT c.hot_rank, c.list_id, c.freq, round(c.cdf, 9) AS cdf, h.list_id IS NOT NULL AS hot FROM cdf c LEFT JOIN half h ON h.list_id = c.list_id""")
def sink_hot_stats(spark, sf):
    """Hot order + CDF and the hot set written as tables and read back."""
    st = State(spark, sf)
    path = scratch.new_dir(spark, "hot")
    st.cdf.select("hot_rank", "list_id", "freq", "cdf").write.parquet(path + "/hot_cdf")
    st.hot.select("list_id").write.parquet(path + "/hot_set")
    c = spark.read.parquet(path + "/hot_cdf")
    h = spark.read.parquet(path + "/hot_set").withColumn("hot", F.lit(True))
    out = c.join(h, "list_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    return rnd(out.select("hot_rank", "list_id", "freq", "cdf", "hot"), 9, "cdf")


@_reg("upsert_mem_req", f"""WITH {_ST},
base AS (SELECT mode AS database, slo_ms AS slo, count(*) AS mem_req FROM st WHERE run_day < 15 GROUP BY mode, slo_ms),
upd AS (SELECT mode AS database, slo_ms AS slo, count(*) AS mem_req FROM st WHERE run_day >= 10 AND mode <> 'signup' GROUP BY mode, slo_ms)
SELECT database, slo, mem_req FROM base WHERE NOT EXISTS (SELECT 1 FROM upd WHERE upd.database = base.database AND upd.slo = base.slo)
UNION ALL SELECT database, slo, mem_req FROM upd""")
def upsert_mem_req(spark, sf):
    """Upsert by (database, slo) into a table with a commit log: the later table (days >= 10, without one
    mode) replaces matching keys of the earlier one (days < 15), new keys append."""
    req = fx.requests(spark, sf)
    base = req.where(F.col("run_day") < 15).groupBy(F.col("mode").alias("database"), F.col("slo_ms").alias("slo")) \
        .agg(F.count(F.lit(1)).alias("mem_req"))
    upd = req.where((F.col("run_day") >= 10) & (F.col("mode") != "signup")) \
        .groupBy(F.col("mode").alias("database"), F.col("slo_ms").alias("slo")).agg(F.count(F.lit(1)).alias("mem_req"))
    table = VersionedTable(spark, scratch.new_dir(spark, "mem-req"), ["database", "slo"], base.schema)
    table.upsert(base)
    table.upsert(upd)
    return table.read()


@_reg("sink_latency_model", f"""WITH {_ST}, {_LAT_SQL}, {_fit_sql('latg', 'gseg')}
SELECT component, seg, start, "end", round(slope, 9) AS slope, round(intercept, 9) AS intercept FROM gseg""")
def sink_latency_model(spark, sf):
    """Latency segments written as a table and read back."""
    req = fx.requests(spark, sf)
    latg = lt.by_batch(req.where(F.col("hit_rate") == 1.0), _LAT_COLS[:-1])
    path = scratch.new_dir(spark, "latency")
    lt.range_fit(latg, RANGE_W).withColumn("tier", F.lit("gpu")).write.partitionBy("tier").parquet(path)
    back = spark.read.parquet(path).where(F.col("tier") == "gpu").drop("tier")
    return rnd(back, 9, "slope", "intercept")


@_reg("run_layout", f"WITH {_ST} SELECT rid, round(ttft, 6) AS ttft FROM st WHERE mode = 'view' AND ngpu = 8")
def run_layout(spark, sf):
    """Results laid out as mode=/ngpu= folders; the read filters on the layout
    keys, which Catalyst turns into partition pruning."""
    path = scratch.new_dir(spark, "layout")
    fx.requests(spark, sf).select("rid", "ttft", "mode", "ngpu").write.partitionBy("mode", "ngpu").parquet(path)
    back = spark.read.parquet(path).where((F.col("mode") == "view") & (F.col("ngpu") == 8))
    return rnd(back.select("rid", "ttft"), 6, "ttft")


@_reg("skip_done", f"""WITH {_ST}, runs AS (SELECT DISTINCT mode, rate, ngpu FROM st),
done AS (SELECT DISTINCT mode, rate, ngpu FROM st WHERE ngpu = 8)
SELECT mode, rate, ngpu FROM runs r WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.mode = r.mode AND d.rate = r.rate AND d.ngpu = r.ngpu)""")
def skip_done(spark, sf):
    """Runs still to do: all runs minus the manifest of runs already written
    (the 8-GPU sweep)."""
    req = fx.requests(spark, sf)
    runs = req.select("mode", "rate", "ngpu").distinct()
    done = VersionedTable(spark, scratch.new_dir(spark, "manifest"), ["mode", "rate", "ngpu"], runs.schema)
    done.upsert(runs.where(F.col("ngpu") == 8))
    return tb.todo(runs, done.read(), ["mode", "rate", "ngpu"])


@_reg("src_tokens_txt", r"""SELECT tok AS token, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS tok FROM benchmark) t WHERE tok <> '' GROUP BY tok""")
def src_tokens_txt(spark, sf):
    """A whitespace token file (here the benchmark texts) read as one token list."""
    path = scratch.new_dir(spark, "tokens")
    fx.table(spark, sf, "benchmark").select("text").write.text(path)
    toks = tb.read_tokens(spark, path)
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def write_catalog_json(spark, path: str) -> None:
    """Catalog files in the reference's JSON layout: one per model, one for the devices."""
    import json
    models = {}
    for m, kind, dev, i, o, g, v in cat.MODEL_PERF:
        mod = models.setdefault(m, {"tput_ceiling": {}, "slo": {}})
        ents = mod["tput_ceiling" if kind == "tput" else "slo"].setdefault(dev, [])
        ent = next((e for e in ents if e["input"] == i and e["output"] == o), None)
        if ent is None:
            ent = {"input": i, "output": o, "values": {}}
            ents.append(ent)
        ent["values"][f"ngpu={g}"] = v
    for m, name, mem, tp in cat.MODELS:
        models[m].update({"name": name, "memory_gb": mem, "tp_size": tp})
    rows = [(m, json.dumps(v, indent=2)) for m, v in models.items()]
    spark.createDataFrame(rows, "model string, value string").repartition("model").write.partitionBy("model").text(f"{path}/models")
    spark.createDataFrame([(json.dumps(dict(cat.GPUS), indent=4),)], "value string").coalesce(1).write.text(f"{path}/devices")


_CAT_PERF = cat.values_sql(cat.MODEL_PERF, "model, kind, device, input, output, ngpu, value")


@_reg("src_catalog", f"""WITH {_ST}, runs AS (SELECT DISTINCT ngpu, input_len, output_len FROM st)
SELECT p.model, p.kind, p.device, r.ngpu, r.input_len, r.output_len, p.value, round(r.ngpu * d.mem_gb, 6) AS total_mem_gb FROM runs r
JOIN {_CAT_PERF.replace(" AS t(", " AS p(")} ON p.input = r.input_len AND p.output = r.output_len AND p.ngpu = r.ngpu
JOIN {cat.values_sql(cat.GPUS, "device, mem_gb").replace(" AS t(", " AS d(")} ON d.device = p.device""")
def src_catalog(spark, sf):
    """Catalog JSON files (models: device -> [{input, output, values: {ngpu=N: x}}];
    devices: name -> GB) read and flattened with explode + regexp, then looked up
    for every run configuration seen in the request log."""
    path = scratch.new_dir(spark, "catalog")
    write_catalog_json(spark, path)
    _, perf = cat.load_json(spark, f"{path}/models")
    devices = cat.load_device_json(spark, f"{path}/devices")
    runs = fx.requests(spark, sf).select("ngpu", "input_len", "output_len").distinct()
    j = runs.join(F.broadcast(perf), (runs.input_len == perf.input) & (runs.output_len == perf.output)
                  & (runs.ngpu == perf.ngpu)).join(F.broadcast(devices), "device")
    return rnd(j.select("model", "kind", "device", runs.ngpu, "input_len", "output_len", "value",
                        (runs.ngpu * F.col("mem_gb")).alias("total_mem_gb")), 6, "total_mem_gb")
