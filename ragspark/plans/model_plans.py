"""Registered tail-hit-rate (HIT8-10, HIT12) and latency-model (LAT1-9)
queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.rounding import round_to

from ragspark.operators import hitrate as hr
from ragspark.operators import latency as lt
from ragspark.operators import tail as tl
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp
from ragspark.plans.index_plans import HQ, State

Q: dict = {}
SQL: dict = {}

TAIL_MEANS = [0.0] + [round(0.05 * i, 2) for i in range(1, 20)] + [1.0]
TAIL_NS = [1, 2, 4, 8, 16, 32]
REQ_TARGETS = [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0]
REQ_GRID = 1000          # HIT10 mean grid step 1 / 1000 (the reference's tolerance)
CURVE_NS = list(range(1, 33))
RANGE_W = 8              # LAT6 range width (cpus of the accelerated tier)


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


# ----------------------------------------------------------- tail hit rate
def _var_frame(spark, sf):
    st = State(spark, sf)
    hits = hr.per_query(st.probes, st.hot, fx.NPROBE)
    return hits, hr.moments(hits)


def _c_col():
    est = F.lit(4.0) * F.col("var") * F.col("m") * (F.lit(1.0) - F.col("m"))
    return F.col("m") * (F.lit(1.0) - F.col("m")) / est - F.lit(1.0)


def _tail_sql(means_sql: str, ns, pfx: str = "") -> str:
    """CTEs computing ``{pfx}tails(m, n, tail)`` for the means of ``means_sql``
    (column m) with the variance fitted on ``hq``."""
    sums = ", ".join(f"sum(pow(1.0::DOUBLE - Fv, {float(n)}::DOUBLE) * g) AS n{n}" for n in ns)
    unp = " UNION ALL ".join(f"SELECT m, {n} AS n, n{n} AS tail FROM {pfx}wide" for n in ns)
    edge = " UNION ALL ".join(
        f"SELECT m, {n} AS n, CASE WHEN m >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tail FROM {pfx}mg WHERE m <= 0 OR m >= 1"
        for n in ns)
    return f"""{pfx}v AS (SELECT var_pop(hit_rate) AS var FROM hq),
{pfx}mg AS (SELECT DISTINCT g.m, g.m * (1.0::DOUBLE - g.m) / (4.0::DOUBLE * v.var * g.m * (1.0::DOUBLE - g.m)) - 1.0::DOUBLE AS c
       FROM {means_sql}, {pfx}v v),
{pfx}nd AS (SELECT m, c, j, -30.0::DOUBLE + CAST(j AS DOUBLE) * 0.05::DOUBLE AS t FROM {pfx}mg, range(0, 1201) r(j) WHERE m > 0 AND m < 1),
{pfx}nx AS (SELECT m, c, j, 1.0::DOUBLE / (1.0::DOUBLE + exp(-t)) AS x, -ln(1.0::DOUBLE + exp(-t)) AS lnx,
              -ln(1.0::DOUBLE + exp(t)) AS ln1mx, m * c AS a, (1.0::DOUBLE - m) * c AS b FROM {pfx}nd),
{pfx}nw AS (SELECT m, j, x, exp(a * lnx + b * ln1mx) * 0.05::DOUBLE AS w, exp(-30.0::DOUBLE * a) / a AS L,
              exp(-30.0::DOUBLE * b) / b AS R FROM {pfx}nx),
{pfx}nf AS (SELECT m, j, x, w, (L + sum(w) OVER (PARTITION BY m ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w / 2.0::DOUBLE)
              / (L + sum(w) OVER (PARTITION BY m) + R) AS Fv, x * (1.0::DOUBLE - x) * 0.05::DOUBLE AS g FROM {pfx}nw),
{pfx}wide AS (SELECT m, {sums} FROM {pfx}nf GROUP BY m),
{pfx}tails AS ({unp} UNION ALL {edge})"""


def _means_sql(ms) -> str:
    return "(VALUES " + ", ".join(f"({m}::DOUBLE)" for m in ms) + ") AS g(m)"


_HIT_BASE = sp.index_ctes("cent", "probes", "freq", "cdf", "half") + ", " + HQ


@_reg("hit_tail", f"""{_HIT_BASE}, {_tail_sql(_means_sql(TAIL_MEANS), TAIL_NS)}
SELECT m, CAST(n AS INTEGER) AS n, round(tail, 6) AS tail FROM tails""")
def hit_tail(spark, sf):
    """Expected minimum hit rate of a batch of n for a grid of means, with
    the variance model fitted to the observed per-query hit rates."""
    _, mom = _var_frame(spark, sf)
    grid = spark.createDataFrame([(m,) for m in TAIL_MEANS], "m double")
    means = grid.crossJoin(F.broadcast(mom.select("var"))).withColumn("c", _c_col()).drop("var")
    return rnd(tl.tail(means, TAIL_NS).withColumn("n", F.col("n").cast("int")), 6, "tail")


@_reg("hit_tail_empirical", f"""{_HIT_BASE}, r AS (
  SELECT hit_rate, CAST(row_number() OVER (ORDER BY hit_rate) AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS N FROM hq)
{' UNION ALL '.join(f"SELECT {n} AS n, round(sum(hit_rate * (pow((N - i + 1.0::DOUBLE) / N, {float(n)}::DOUBLE) - pow((N - i) / N, {float(n)}::DOUBLE))), 6) AS tail FROM r" for n in TAIL_NS)}""")
def hit_tail_empirical(spark, sf):
    """Order-statistic estimate of the same expected minimum from the observed
    per-query hit rates (cross-check of hit_tail)."""
    hits, _ = _var_frame(spark, sf)
    return rnd(tl.tail_empirical(hits, TAIL_NS).withColumn("n", F.col("n").cast("int")), 6, "tail")


_REQ_MEANS = [k / REQ_GRID for k in range(1, REQ_GRID)]
_REQ_MEANS_SQL = f"(SELECT CAST(k AS DOUBLE) / {float(REQ_GRID)}::DOUBLE AS m FROM range(1, {REQ_GRID}) t(k)) g"
_REQ_NS = [1, 4, 16, 32]


@_reg("hit_required_mean", f"""{_HIT_BASE}, {_tail_sql(_REQ_MEANS_SQL, _REQ_NS)},
tg AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in REQ_TARGETS)}) t(target)),
ns AS (SELECT DISTINCT n FROM tails)
SELECT CAST(ns.n AS INTEGER) AS n, tg.target,
  CASE WHEN tg.target <= 0 OR tg.target >= 1 THEN tg.target
       ELSE (SELECT min(m) FROM tails t WHERE t.n = ns.n AND t.tail >= tg.target) END AS mean
FROM ns, tg""")
def hit_required_mean(spark, sf):
    """Smallest mean (grid step 1e-3) whose expected batch minimum reaches each
    target; the reference bisects to the same tolerance."""
    _, mom = _var_frame(spark, sf)
    grid = spark.range(1, REQ_GRID).select((F.col("id").cast("double") / F.lit(float(REQ_GRID))).alias("m"))
    means = grid.crossJoin(F.broadcast(mom.select("var"))).withColumn("c", _c_col()).drop("var")
    out = tl.required_mean(tl.tail(means, _REQ_NS), REQ_TARGETS)
    return out.withColumn("n", F.col("n").cast("int"))


@_reg("hit_tail_curve", f"""{_HIT_BASE}, {_tail_sql('(SELECT avg(hit_rate) AS m FROM hq) g', CURVE_NS)}
SELECT CAST(n AS INTEGER) AS n, round(tail, 6) AS tail FROM tails""")
def hit_tail_curve(spark, sf):
    """Tail hit rate for n = 1..32 at the observed mean hit rate."""
    _, mom = _var_frame(spark, sf)
    means = mom.select(F.col("mean").alias("m"), "var").withColumn("c", _c_col()).drop("var")
    return rnd(tl.tail(means, CURVE_NS).drop("m").withColumn("n", F.col("n").cast("int")), 6, "tail")


# ------------------------------------------------------------ latency model
ST = sp.stages_cte()
_LAT_COLS = ["ann_search", "quantize", "lut_compute", "lut_scan", "hit_rate"]
_LAT_SQL = """lat AS (SELECT batch_size, avg(ann_search) AS ann_search, avg(quantize) AS quantize, avg(lut_compute) AS lut_compute,
  avg(lut_scan) AS lut_scan, avg(hit_rate) AS hit_rate FROM st GROUP BY batch_size),
latg AS (SELECT batch_size, avg(ann_search) AS ann_search, avg(quantize) AS quantize, avg(lut_compute) AS lut_compute,
  avg(lut_scan) AS lut_scan FROM st WHERE hit_rate = 1.0 GROUP BY batch_size)"""


def _comp_sql(src: str) -> str:
    return (f"SELECT CAST(batch_size AS DOUBLE) AS x, 'search' AS component, ann_search AS y FROM {src} UNION ALL "
            f"SELECT CAST(batch_size AS DOUBLE), 'quantize', quantize FROM {src} UNION ALL "
            f"SELECT CAST(batch_size AS DOUBLE), 'lut', lut_compute + lut_scan FROM {src}")


def _fit_sql(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT component, seg, CAST(seg * {RANGE_W} + 1 AS DOUBLE) AS start, least(CAST(seg * {RANGE_W} + {RANGE_W} AS DOUBLE), (SELECT max(CAST(batch_size AS DOUBLE)) FROM {src})) AS "end",
         slope, intercept FROM (
    SELECT component, CAST(floor((x - 1) / {RANGE_W}) AS INTEGER) AS seg, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
    FROM ({_comp_sql(src)}) c WHERE x >= 1 GROUP BY component, CAST(floor((x - 1) / {RANGE_W}) AS INTEGER)) f)"""


def _lat_frames(spark, sf):
    req = fx.requests(spark, sf)
    lat = lt.by_batch(req, _LAT_COLS)
    latg = lt.by_batch(req.where(F.col("hit_rate") == 1.0), _LAT_COLS[:-1])
    return req, lat, latg


@_reg("lat_by_batch", f"""WITH {ST}, {_LAT_SQL}
SELECT batch_size, round(ann_search, 6) AS ann_search, round(quantize, 9) AS quantize, round(lut_compute, 9) AS lut_compute,
  round(lut_scan, 9) AS lut_scan, round(hit_rate, 6) AS hit_rate FROM lat""")
def lat_by_batch(spark, sf):
    """Mean search / quantize / LUT times and hit rate per batch size."""
    _, lat, _ = _lat_frames(spark, sf)
    return rnd(rnd(lat, 6, "ann_search", "hit_rate"), 9, "quantize", "lut_compute", "lut_scan")


@_reg("lat_batch_rollup", f"""WITH {ST}
SELECT mode, batch_id, round(avg(batch_size), 6) AS mean_size, round(max(ann_search), 6) AS max_search,
  round(min(hit_rate), 6) AS min_hit FROM st GROUP BY mode, batch_id""")
def lat_batch_rollup(spark, sf):
    """Per (mode, batch): mean size, max search time, min hit rate."""
    req = fx.requests(spark, sf)
    out = req.groupBy("mode", "batch_id").agg(F.avg("batch_size").alias("mean_size"),
                                              F.max("ann_search").alias("max_search"),
                                              F.min("hit_rate").alias("min_hit"))
    return rnd(out, 6, "mean_size", "max_search", "min_hit")


@_reg("lat_min_support", f"""WITH {ST}, b AS (SELECT batch_id, max(batch_size) AS batch_size, max(ann_search) AS max_search,
  min(hit_rate) AS min_hit FROM st GROUP BY batch_id)
SELECT batch_size, count(*) AS n_batches, round(avg(max_search), 6) AS mean_max_search, round(avg(min_hit), 6) AS mean_min_hit
FROM b GROUP BY batch_size HAVING count(*) >= 20""")
def lat_min_support(spark, sf):
    """Batch sizes seen in at least 20 batches, with per-batch means."""
    req = fx.requests(spark, sf)
    b = req.groupBy("batch_id").agg(F.max("batch_size").alias("batch_size"), F.max("ann_search").alias("max_search"),
                                    F.min("hit_rate").alias("min_hit"))
    out = (b.groupBy("batch_size").agg(F.count(F.lit(1)).alias("n_batches"), F.avg("max_search").alias("mean_max_search"),
                                       F.avg("min_hit").alias("mean_min_hit")).where(F.col("n_batches") >= 20))
    return rnd(out, 6, "mean_max_search", "mean_min_hit")


@_reg("lat_breaks", f"""WITH {ST}, {_LAT_SQL}, q AS (
  SELECT unnest(list_sort(list_distinct(list_concat(quantile_cont(CAST(batch_size AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]),
    [1.0::DOUBLE, 2.0::DOUBLE])))) AS brk FROM lat WHERE batch_size >= 1)
SELECT CAST(row_number() OVER (ORDER BY brk) - 1 AS INTEGER) AS idx, brk FROM q""")
def lat_breaks(spark, sf):
    """Quantile break points of the batch sizes plus {1, 2}."""
    _, lat, _ = _lat_frames(spark, sf)
    brks = lt.breaks(lat.where(F.col("batch_size") >= 1))
    return spark.createDataFrame(list(enumerate(brks)), "idx int, brk double")


# The continuous piecewise-linear fit in the basis of its values at the breaks:
# tridiagonal normal equations per component, solved by elimination.
_PIECEWISE_SQL = f"""WITH RECURSIVE {ST}, {_LAT_SQL}, q AS (
  SELECT unnest(list_sort(list_distinct(list_concat(quantile_cont(CAST(batch_size AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]),
    [1.0::DOUBLE, 2.0::DOUBLE])))) AS brk FROM lat WHERE batch_size >= 1),
brk AS (SELECT CAST(row_number() OVER (ORDER BY brk) - 1 AS INTEGER) AS j, brk FROM q),
cut AS (SELECT a.j, a.brk AS lo, b.brk AS hi, b.j = (SELECT max(j) FROM brk) AS final FROM brk a JOIN brk b ON b.j = a.j + 1),
j0 AS (SELECT min(j) AS j FROM brk WHERE brk >= (SELECT min(batch_size) FROM lat WHERE batch_size >= 1)),
pt AS (SELECT c.component, t.j, (t.hi - c.x) / (t.hi - t.lo) AS wl, (c.x - t.lo) / (t.hi - t.lo) AS wr, c.y
  FROM ({_comp_sql('lat')}) c JOIN cut t ON t.j >= (SELECT j FROM j0) AND c.x >= t.lo AND (c.x < t.hi OR (t.final AND c.x = t.hi))),
dg AS (SELECT component, j, sum(d) AS d, sum(b) AS b FROM (SELECT component, j, wl * wl AS d, wl * y AS b FROM pt
  UNION ALL SELECT component, j + 1, wr * wr, wr * y FROM pt) z GROUP BY component, j),
eq AS (SELECT dg.*, coalesce(o.e, 0.0::DOUBLE) AS e FROM dg LEFT JOIN
  (SELECT component, j, sum(wl * wr) AS e FROM pt GROUP BY component, j) o ON o.component = dg.component AND o.j = dg.j),
fw AS (SELECT component, j, e, e / d AS cp, b / d AS dp FROM eq WHERE j = (SELECT j FROM j0)
  UNION ALL SELECT n.component, n.j, n.e, n.e / (n.d - f.e * f.cp), (n.b - f.e * f.dp) / (n.d - f.e * f.cp)
  FROM fw f JOIN eq n ON n.component = f.component AND n.j = f.j + 1),
bw AS (SELECT component, j, dp AS v FROM fw WHERE j = (SELECT max(j) FROM brk)
  UNION ALL SELECT f.component, f.j, f.dp - f.cp * b.v FROM bw b JOIN fw f ON f.component = b.component AND f.j = b.j - 1)
SELECT l.component, t.j AS seg, t.lo AS start, t.hi AS "end", round((r.v - l.v) / (f.hi - f.lo), 6) + 0.0::DOUBLE AS slope,
  round(l.v - (r.v - l.v) / (f.hi - f.lo) * f.lo, 6) + 0.0::DOUBLE AS intercept
FROM cut t JOIN cut f ON f.j = greatest(t.j, (SELECT j FROM j0)) JOIN bw l ON l.j = f.j
JOIN bw r ON r.component = l.component AND r.j = f.j + 1"""


@_reg("lat_piecewise", _PIECEWISE_SQL)
def lat_piecewise(spark, sf):
    """Continuous piecewise-linear fit of search / quantize / lut at the
    quantile breaks (all segments kept)."""
    _, lat, _ = _lat_frames(spark, sf)
    d = lat.where(F.col("batch_size") >= 1)
    out = rnd(lt.piecewise(d, lt.breaks(d)), 6, "slope", "intercept")
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("slope", "intercept")})     # no negative zero


@_reg("lat_range_fit", f"""WITH {ST}, {_LAT_SQL}, {_fit_sql('latg', 'gseg')}
SELECT component, seg, start, "end", round(slope, 9) AS slope, round(intercept, 9) AS intercept FROM gseg""")
def lat_range_fit(spark, sf):
    """Independent lines per batch-size range of width 8 for the accelerated
    tier (requests served fully from hot lists: hit rate 1)."""
    _, _, latg = _lat_frames(spark, sf)
    return rnd(lt.range_fit(latg, RANGE_W), 9, "slope", "intercept")


def _pred_sql(seg: str, closed: bool) -> str:
    cmp = "p.x <= s.\"end\"" if closed else "p.x < s.\"end\""
    order = "s.start DESC" if closed else "s.start ASC"
    return f"""(SELECT batch_size, component, pred FROM (
    SELECT p.batch_size, s.component, s.slope * p.x + s.intercept AS pred,
           row_number() OVER (PARTITION BY p.batch_size, s.component ORDER BY {order}) AS rn
    FROM (SELECT DISTINCT batch_size, CAST(batch_size AS DOUBLE) AS x FROM st) p JOIN {seg} s ON p.x >= s.start AND {cmp}) z WHERE rn = 1)"""


@_reg("lat_predict", f"""WITH {ST}, {_LAT_SQL}, {_fit_sql('lat', 'cseg')}, {_fit_sql('latg', 'gseg')},
pc AS {_pred_sql('cseg', True)}, pg AS {_pred_sql('gseg', False)}
SELECT coalesce(pc.batch_size, pg.batch_size) AS batch_size, coalesce(pc.component, pg.component) AS component,
  round(pc.pred, 9) AS pred_cpu, round(pg.pred, 9) AS pred_gpu
FROM pc FULL OUTER JOIN pg ON pc.batch_size = pg.batch_size AND pc.component = pg.component""")
def lat_predict(spark, sf):
    """Segment lookup for every observed batch size: host tier (closed
    ranges, later wins) and accelerated tier (half-open, first wins)."""
    req, lat, latg = _lat_frames(spark, sf)
    pts = req.select("batch_size")
    pc = lt.predict(pts, lt.range_fit(lat, RANGE_W), "closed_last").withColumnRenamed("pred", "pred_cpu")
    pg = lt.predict(pts, lt.range_fit(latg, RANGE_W), "halfopen_first").withColumnRenamed("pred", "pred_gpu")
    out = pc.join(pg, ["batch_size", "component"], "full")
    return rnd(out, 9, "pred_cpu", "pred_gpu")


_MISS_SQL = f"""{ST}, {_LAT_SQL}, {_fit_sql('lat', 'cseg')}, {_fit_sql('latg', 'gseg')},
pc AS {_pred_sql('cseg', True)}, pg AS {_pred_sql("(SELECT * FROM gseg WHERE component = 'search')", False)},
w AS (SELECT batch_size, max(CASE WHEN component = 'search' THEN pred END) AS s_line,
        max(CASE WHEN component = 'quantize' THEN pred END) AS q_line, max(CASE WHEN component = 'lut' THEN pred END) AS l_line
      FROM pc GROUP BY batch_size)"""


def _miss_select(points: str) -> str:
    return f"""SELECT pt.*, w.l_line * (1.0::DOUBLE - pt.hit_rate) AS lut_latency, w.q_line AS cq_latency, w.s_line AS search_0,
  CASE WHEN 1.0::DOUBLE - pt.hit_rate = 0 THEN coalesce(pg.pred, w.l_line * (1.0::DOUBLE - pt.hit_rate) + w.q_line)
       ELSE w.l_line * (1.0::DOUBLE - pt.hit_rate) + w.q_line END AS search_1
FROM {points} pt LEFT JOIN w ON w.batch_size = pt.batch_size LEFT JOIN pg ON pg.batch_size = pt.batch_size"""


@_reg("lat_miss_scaled", f"""WITH {_MISS_SQL}, m AS ({_miss_select('(SELECT batch_id, max(batch_size) AS batch_size, min(hit_rate) AS hit_rate FROM st GROUP BY batch_id)')})
SELECT batch_id, batch_size, hit_rate, round(lut_latency, 9) AS lut_latency, round(cq_latency, 9) AS cq_latency,
  round(search_0, 9) AS search_0, round(search_1, 9) AS search_1 FROM m""")
def lat_miss_scaled(spark, sf):
    """Per batch: predicted search time with the LUT share scaled by the
    batch's worst hit rate; fully hot batches use the accelerated line."""
    req, lat, latg = _lat_frames(spark, sf)
    pts = req.groupBy("batch_id").agg(F.max("batch_size").alias("batch_size"), F.min("hit_rate").alias("hit_rate"))
    out = lt.miss_scaled(pts, lt.range_fit(lat, RANGE_W), lt.range_fit(latg, RANGE_W))
    return rnd(out, 9, "lut_latency", "cq_latency", "search_0", "search_1")


@_reg("lat_pred_vs_meas", f"""WITH {_MISS_SQL}, m AS ({_miss_select('(SELECT batch_size, avg(hit_rate) AS hit_rate, avg(ann_search) AS measured FROM st GROUP BY batch_size)')})
SELECT batch_size, round(measured, 6) AS measured, round(search_1, 9) AS predicted, round(hit_rate, 6) AS hit_rate FROM m""")
def lat_pred_vs_meas(spark, sf):
    """Predicted vs measured search time per batch size at its mean hit rate."""
    req, lat, latg = _lat_frames(spark, sf)
    pts = req.groupBy("batch_size").agg(F.avg("hit_rate").alias("hit_rate"), F.avg("ann_search").alias("measured"))
    out = lt.miss_scaled(pts, lt.range_fit(lat, RANGE_W), lt.range_fit(latg, RANGE_W))
    out = out.select("batch_size", "measured", F.col("search_1").alias("predicted"), "hit_rate")
    return rnd(rnd(out, 6, "measured", "hit_rate"), 9, "predicted")
