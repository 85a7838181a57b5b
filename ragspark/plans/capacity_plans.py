"""Registered capacity queries (CAP1-14) and their oracle SQL.

Scenario set: the model/device/GPU-count/index rows of the catalog named
below.  Data dependence: hot order and list sizes of the fixture index,
latency lines fitted on the request log, hit-rate variance from the probes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.rounding import round_to

from ragspark.operators import capacity as cp
from ragspark.operators import hitrate as hr
from ragspark.operators import latency as lt
from ragspark.operators import tail as tl
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp
from ragspark.plans.index_plans import HQ, State
from ragspark.plans.model_plans import RANGE_W, _LAT_COLS, _LAT_SQL, _fit_sql, _tail_sql
from ragspark.sources import catalog as cat

Q: dict = {}
SQL: dict = {}

P_STEPS = 100        # shared-scheme grid of prefix fractions
P_STEPS_FINE = 1000  # device-budget grid (the reference's 1e-3 tolerance)
MAX_N = 32           # batch sizes evaluated by the walks
TAIL_STEPS = 1000    # mean grid of the required-mean lookup
RUN_SECONDS = 120    # default run length (requests = int(120 * rate))
MODEL, DEVICE = "llama8b", "L40S"
# Fixture binding: event types play the search modes.
SEARCH_MODES = [("view", "hybrid"), ("click", "cpu"), ("purchase", "all-gpu"), ("error", "ded-gpu"), ("signup", "none")]


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


def _scenarios(ngpus=(8, 6, 4), index="wikiall"):
    """(ngpu, ceiling, gpu_mem, model_mem, tp, index params, slo_ms) rows."""
    gpu_mem = dict(cat.GPUS)[DEVICE]
    mod = {m[0]: m for m in cat.MODELS}[MODEL]
    ceil = {(r[5]): r[6] for r in cat.MODEL_PERF if r[0] == MODEL and r[1] == "tput" and r[2] == DEVICE
            and r[3] == 1024 and r[4] == 256}
    ix = {r[0]: r for r in cat.INDEXES}[index]
    return [(g, ceil[g], gpu_mem, mod[2], mod[3], ix[0], ix[2], ix[1], ix[3], ix[4], ix[5], ix[6], ix[7], g)
            for g in ngpus if g in ceil]


_SCEN_COLS = "ngpu, ceiling, gpu_mem, model_mem, tp, index, nlist_cat, ntotal_cat, d, m_sub, msub, ksub, slo_ms, n_ded"
_SCEN_SCHEMA = ("ngpu int, ceiling double, gpu_mem double, model_mem double, tp int, index string, nlist_cat int, "
                "ntotal_cat bigint, d int, m_sub int, msub int, ksub int, slo_ms int, n_ded int")


def _mem_scen_rows():
    gpu_mem = dict(cat.GPUS)[DEVICE]
    mod = {m[0]: m for m in cat.MODELS}[MODEL]
    return [(8, 41.23, gpu_mem, mod[2], mod[3], r[0], r[2], r[1], r[3], r[4], r[5], r[6], r[7], 8) for r in cat.INDEXES]


def _values(rows, cols):
    return cat.values_sql(rows, cols)


class Cap:
    """Spark-side inputs shared by the capacity keys (lazy frames)."""

    def __init__(self, spark, sf):
        self.spark = spark
        self.st = State(spark, sf)
        self.nlist = self.st.nlist
        self.ntotal = self.st.vecs.count()
        self.pv = cp.prefix_vectors(self.st.cdf, self.st.sizes)

    def mem_points(self, rows, steps, upto=1.0):
        """Grid of prefix fractions x scenario rows (config literals exploded
        per grid point, no join), with the hot-prefix vector share."""
        pts = cp.grid(self.spark, steps, "p", upto)
        pts = cp.with_share(pts, self.pv, self.nlist, self.ntotal)
        names = [c.strip() for c in _SCEN_COLS.split(",")]
        structs = [F.struct(*[F.lit(v).alias(c) for v, c in zip(r, names)]) for r in rows]
        return (pts.select("*", F.explode(F.array(*structs)).alias("_s")).select("p", "share", "_s.*")
                .withColumn("ngpu", F.col("ngpu").cast("int")).withColumn("ntotal_cat", F.col("ntotal_cat").cast("bigint")))


# ------------------------------------------------------------------- SQL
_IDX = sp.index_ctes("cent", "asg", "probes", "sizes", "freq", "cdf")
_PV = """pv AS (SELECT c.hot_rank + 1 AS prefix_len, sum(s.n) OVER (ORDER BY c.hot_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_vectors
  FROM cdf c JOIN sizes s ON s.list_id = c.list_id)"""


def _pts_sql(rows, steps, upto=1.0):
    last = int(round(steps * upto))
    return f"""pg AS (SELECT CAST(k AS DOUBLE) / {float(steps)}::DOUBLE AS p FROM range(0, {last + 1}) t(k)),
ps AS (SELECT pg.p, CAST(coalesce(pv.n_vectors, 0) AS DOUBLE) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS share
  FROM pg LEFT JOIN pv ON pv.prefix_len = CAST(floor(pg.p * CAST((SELECT count(*) FROM cent) AS DOUBLE)) AS BIGINT)),
scen AS (SELECT * FROM {_values(rows, _SCEN_COLS)}),
pts AS (SELECT ps.p, ps.share, scen.* FROM ps, scen),
mem AS (SELECT *, cen + pq + inv + ids + 2.0::DOUBLE AS mem_whole,
          pq + 2.0::DOUBLE + (cen + inv + ids) / ngpu AS mem_split,
          pq + 2.0::DOUBLE + cen + (inv + ids) / n_ded AS mem_dedicated FROM (
  SELECT *, CAST(d * CAST(floor(p * nlist_cat) AS BIGINT) * 4 AS DOUBLE) / 1073741824.0::DOUBLE AS cen,
         CAST(ntotal_cat AS DOUBLE) * share * CAST(m_sub AS DOUBLE) * 0.5::DOUBLE / 1073741824.0::DOUBLE AS inv,
         CAST(ntotal_cat AS DOUBLE) * share * 4.0::DOUBLE / 1073741824.0::DOUBLE AS ids,
         CAST(m_sub * msub * ksub * 4 AS DOUBLE) / 1073741824.0::DOUBLE AS pq FROM pts) x)"""


def _r(expr, d=6):
    return f"round({expr}, {d})"


@_reg("cap_prefix_vectors", f"{_IDX}, {_PV} SELECT prefix_len, CAST(n_vectors AS BIGINT) AS n_vectors FROM pv")
def cap_prefix_vectors(spark, sf):
    """Vectors in the first L lists, lists taken in hot order."""
    return Cap(spark, sf).pv


@_reg("cap_memory", f"""{_IDX}, {_PV}, {_pts_sql(_mem_scen_rows(), P_STEPS)}
SELECT index, p, {_r('mem_whole')} AS mem_whole, {_r('mem_split')} AS mem_split, {_r('mem_dedicated')} AS mem_dedicated FROM mem""")
def cap_memory(spark, sf):
    """Index memory of each catalog index when the hot prefix p of its lists is
    kept, with vectors per prefix scaled from the fixture index's hot order."""
    c = Cap(spark, sf)
    m = cp.memory(c.mem_points(_mem_scen_rows(), P_STEPS))
    return rnd(m.select("index", "p", "mem_whole", "mem_split", "mem_dedicated"), 6, "mem_whole", "mem_split", "mem_dedicated")


_SC = _scenarios()


@_reg("cap_tput_scaled", f"""{_IDX}, {_PV}, {_pts_sql(_SC, P_STEPS)}
SELECT ngpu, p, {_r('rate')} AS rate FROM (
  SELECT ngpu, p, ceiling * ((gpu_mem - model_mem - mem_split) / (gpu_mem - model_mem)) AS rate,
         gpu_mem - model_mem - mem_split AS kv FROM mem) z WHERE kv > 0""")
def cap_tput_scaled(spark, sf):
    """Rate ceiling scaled by the KV memory left after the split index, per GPU count and prefix."""
    c = Cap(spark, sf)
    t = cp.tput_scaled(cp.memory(c.mem_points(_SC, P_STEPS)))
    return rnd(t.select("ngpu", "p", "rate"), 6, "rate")


# ---- latency lines and tail table (shared by CAP4-7, CAP9)
_NS_SQL = f"ns AS (SELECT n, CAST(n AS DOUBLE) AS x FROM range(1, {MAX_N + 1}) t(n))"
_LINES_SQL = f"""{_NS_SQL},
pl AS (SELECT n, component, pred FROM (
  SELECT ns.n, s.component, s.slope * ns.x + s.intercept AS pred,
         row_number() OVER (PARTITION BY ns.n, s.component ORDER BY s.start DESC) AS rn
  FROM ns JOIN cseg s ON ns.x >= s.start AND ns.x <= s."end" WHERE s.component IN ('lut', 'quantize')) z WHERE rn = 1),
lines AS (SELECT ns.n, coalesce(max(CASE WHEN pl.component = 'lut' THEN pl.pred END), 0.0::DOUBLE) AS lut_t,
  coalesce(max(CASE WHEN pl.component = 'quantize' THEN pl.pred END), 0.0::DOUBLE) AS cq_t
  FROM ns LEFT JOIN pl ON pl.n = ns.n GROUP BY ns.n),
lines2 AS (SELECT n, lut_t, cq_t, lut_t * 1.0::DOUBLE + cq_t AS search_t FROM lines)"""


def _need_sql(num, den):
    return (f"CASE WHEN {den} > 0 THEN greatest(least(({num}) / {den}, 1.0::DOUBLE), 0.0::DOUBLE) "
            f"WHEN ({num}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


_REQ_SQL = f"""pr AS (SELECT ngpu, p, ceiling, slo_ms, slo_ms / 1000.0::DOUBLE / 2.0::DOUBLE AS T,
    ceiling * ((gpu_mem - model_mem - mem_split) / (gpu_mem - model_mem)) AS rate FROM mem WHERE gpu_mem - model_mem - mem_split > 0),
need AS (SELECT pr.*, l.n, l.lut_t, l.cq_t, l.search_t,
    {_need_sql('l.search_t - pr.T', 'l.lut_t')} AS need_ceil,
    {_need_sql('l.search_t - l.n / pr.rate', 'l.lut_t')} AS need_floor FROM pr, lines2 l)"""


def _cap_common_sql(rows, steps, upto=1.0):
    """Every CTE the shared-scheme keys need."""
    half = "half AS (SELECT list_id, freq, hot_rank, cdf FROM cdf WHERE hot_rank < (SELECT min(hot_rank) FROM cdf WHERE cdf >= 0.5))"
    req_means = f"(SELECT CAST(k AS DOUBLE) / {float(TAIL_STEPS)}::DOUBLE AS m FROM range(1, {TAIL_STEPS}) t(k)) g"
    return (f"{_IDX}, {half}, {HQ}, {_PV}, {_pts_sql(rows, steps, upto)}, {sp.stages_cte()}, {_LAT_SQL}, "
            f"{_fit_sql('lat', 'cseg')}, {_fit_sql('latg', 'gseg')}, {_LINES_SQL}, {_REQ_SQL}, "
            f"{_tail_sql(req_means, list(range(1, MAX_N + 1)))}")


class SharedBase:
    """Inputs every shared-scheme evaluation reuses: index state, latency
    lines, hit-rate variance and the tail table (all small; the config-sized
    ones are checkpointed so later steps read files, not lineage)."""

    def __init__(self, spark, sf):
        self.c = Cap(spark, sf)
        req = fx.requests(spark, sf)
        lat = lt.by_batch(req, _LAT_COLS)
        latg = lt.by_batch(req.where(F.col("hit_rate") == 1.0), _LAT_COLS[:-1])
        self.cseg = lt.range_fit(lat, RANGE_W).checkpoint(eager=True)
        self.gseg = lt.range_fit(latg, RANGE_W).checkpoint(eager=True)
        ns = spark.range(1, MAX_N + 1).select(F.col("id").cast("int").alias("n"))
        self.lines = cp.latency_lines(self.cseg, ns).checkpoint(eager=True)
        hits = hr.per_query(self.c.st.probes, self.c.st.hot, fx.NPROBE)
        self.var = hr.moments(hits).select("var").checkpoint(eager=True)
        grid = spark.range(1, TAIL_STEPS).select((F.col("id").cast("double") / F.lit(float(TAIL_STEPS))).alias("m"))
        est = F.lit(4.0) * F.col("var") * F.col("m") * (F.lit(1.0) - F.col("m"))
        means = grid.crossJoin(F.broadcast(self.var)).withColumn(
            "c", F.col("m") * (F.lit(1.0) - F.col("m")) / est - F.lit(1.0)).drop("var")
        self.tail = tl.tail(means, list(range(1, MAX_N + 1))).checkpoint(eager=True)


class Shared:
    """Spark side of CAP4-7 for one scenario set and prefix grid."""

    def __init__(self, spark, sf, rows=_SC, steps=P_STEPS, upto=1.0, base: SharedBase | None = None):
        self.base = base or SharedBase(spark, sf)
        self.c, self.cseg, self.gseg = self.base.c, self.base.cseg, self.base.gseg
        self.lines, self.var, self.tail = self.base.lines, self.base.var, self.base.tail
        mem = cp.tput_scaled(cp.memory(self.c.mem_points(rows, steps, upto)))
        self.points = mem.select("ngpu", "p", "ceiling", "slo_ms",
                                 (F.col("slo_ms") / F.lit(1000.0) / F.lit(2.0)).alias("T"), "rate") \
            .checkpoint(eager=True)
        self.need = cp.required_hit(self.points, self.lines, MAX_N)
        self._best = None

    def walks(self):
        """Both walks per point, each row = one step (n, need, mean)."""
        n_star = F.col("rate") * F.col("T")
        fl = (self.points.withColumn("_n0", F.floor(n_star).cast("int")).where(F.col("_n0") >= 1)
              .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n0") - 1)))
              .withColumn("n", F.col("_n0") - F.col("k")).withColumn("walk", F.lit("floor")))
        ce = (self.points.withColumn("_n0", F.ceil(n_star).cast("int")).where(F.col("_n0") <= MAX_N)
              .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(MAX_N) - F.col("_n0"))))
              .withColumn("n", F.col("_n0") + F.col("k")).withColumn("walk", F.lit("ceil")))
        steps = fl.unionByName(ce).select("ngpu", "p", "walk", "k", F.col("n").cast("int").alias("n"))
        nd = self.need.select("ngpu", "p", "n", "need_ceil", "need_floor")
        steps = steps.join(nd, ["ngpu", "p", "n"]).withColumn(
            "need", F.when(F.col("walk") == "floor", F.col("need_floor")).otherwise(F.col("need_ceil")))
        return cp.lookup_mean(steps, self.tail, "need", "mean", ["ngpu", "p", "walk", "k"]).checkpoint(eager=True)

    def best(self):
        if self._best is not None:
            return self._best
        b = cp.walk_best(self.walks(), ["ngpu", "p", "walk"], "k", "mean", "n", "need")
        n_star = F.col("rate") * F.col("T")
        dflt = (self.points.select("ngpu", "p", n_star.alias("_ns"))
                .select("ngpu", "p", F.explode(F.array(
                    F.struct(F.lit("floor").alias("walk"), F.when(F.floor("_ns") < 1, F.lit(1)).otherwise(
                        F.floor("_ns")).cast("int").alias("d_n")),
                    F.struct(F.lit("ceil").alias("walk"), F.ceil("_ns").cast("int").alias("d_n")))).alias("_w"))
                .select("ngpu", "p", "_w.walk", "_w.d_n"))
        out = dflt.join(b, ["ngpu", "p", "walk"], "left")
        self._best = out.select("ngpu", "p", "walk", F.coalesce("best_n", "d_n").alias("best_n"),
                                F.coalesce("best_mean", F.lit(1.0)).alias("best_mean"),
                                F.coalesce("best_need", F.lit(1.0)).alias("best_need")).checkpoint(eager=True)
        return self._best


_WALKS_SQL = f"""steps AS (
  SELECT pr.ngpu, pr.p, 'floor' AS walk, t.k, CAST(floor(pr.rate * pr.T) AS INTEGER) - t.k AS n FROM pr,
    range(0, CAST(floor(pr.rate * pr.T) AS BIGINT)) t(k) WHERE floor(pr.rate * pr.T) >= 1
  UNION ALL
  SELECT pr.ngpu, pr.p, 'ceil' AS walk, t.k, CAST(ceil(pr.rate * pr.T) AS INTEGER) + t.k AS n FROM pr,
    range(0, {MAX_N} - CAST(ceil(pr.rate * pr.T) AS BIGINT) + 1) t(k) WHERE ceil(pr.rate * pr.T) <= {MAX_N}),
sn AS (SELECT s.*, CASE WHEN s.walk = 'floor' THEN nd.need_floor ELSE nd.need_ceil END AS need
  FROM steps s JOIN need nd ON nd.ngpu = s.ngpu AND nd.p = s.p AND nd.n = s.n),
sm AS (SELECT sn.*, CASE WHEN need <= 0 OR need >= 1 THEN need
    ELSE coalesce((SELECT min(t.m) FROM tails t WHERE t.n = sn.n AND t.tail >= sn.need), 1.0::DOUBLE) END AS mean FROM sn),
fl AS (SELECT *, mean >= coalesce(lag(mean) OVER (PARTITION BY ngpu, p, walk ORDER BY k), 1.0::DOUBLE) AS stop FROM sm),
cut AS (SELECT ngpu, p, walk, coalesce(min(CASE WHEN stop THEN k END), max(k) + 1) AS kk FROM fl GROUP BY ngpu, p, walk),
picked AS (SELECT fl.ngpu, fl.p, fl.walk, fl.n AS best_n, fl.mean AS best_mean, fl.need AS best_need
  FROM fl JOIN cut ON cut.ngpu = fl.ngpu AND cut.p = fl.p AND cut.walk = fl.walk AND fl.k = cut.kk - 1),
dflt AS (SELECT ngpu, p, 'floor' AS walk, CAST(CASE WHEN floor(rate * T) < 1 THEN 1 ELSE floor(rate * T) END AS INTEGER) AS d_n FROM pr
  UNION ALL SELECT ngpu, p, 'ceil', CAST(ceil(rate * T) AS INTEGER) FROM pr),
best AS (SELECT d.ngpu, d.p, d.walk, coalesce(pk.best_n, d.d_n) AS best_n, coalesce(pk.best_mean, 1.0::DOUBLE) AS best_mean,
  coalesce(pk.best_need, 1.0::DOUBLE) AS best_need FROM dflt d LEFT JOIN picked pk ON pk.ngpu = d.ngpu AND pk.p = d.p AND pk.walk = d.walk)"""


@_reg("cap_required_hit", f"""{_cap_common_sql(_SC, P_STEPS)}
SELECT ngpu, p, CAST(n AS INTEGER) AS n, {_r('need_ceil')} AS need_ceil, {_r('need_floor')} AS need_floor FROM need""")
def cap_required_hit(spark, sf):
    """Needed batch-minimum hit rate per (GPU count, prefix, batch size)."""
    s = Shared(spark, sf)
    return rnd(s.need.select("ngpu", "p", F.col("n").cast("int").alias("n"), "need_ceil", "need_floor"),
               6, "need_ceil", "need_floor")


@_reg("cap_best_batch", f"""{_cap_common_sql(_SC, P_STEPS)}, {_WALKS_SQL}
SELECT ngpu, p, walk, CAST(best_n AS INTEGER) AS best_n, {_r('best_mean')} AS best_mean, {_r('best_need')} AS best_need FROM best""")
def cap_best_batch(spark, sf):
    """Floor and ceiling walks over batch sizes, stopping at the first step
    whose required mean hit rate does not improve."""
    b = Shared(spark, sf).best()
    return rnd(b.withColumn("best_n", F.col("best_n").cast("int")), 6, "best_mean", "best_need")


_CAND_SQL = f"""{_WALKS_SQL},
bw AS (SELECT b.ngpu, b.p, max(CASE WHEN walk = 'floor' THEN best_n END) AS n_f, max(CASE WHEN walk = 'floor' THEN best_mean END) AS m_f,
   max(CASE WHEN walk = 'ceil' THEN best_n END) AS n_c, max(CASE WHEN walk = 'ceil' THEN best_mean END) AS m_c FROM best b GROUP BY b.ngpu, b.p),
cand AS (SELECT bw.*, pr.rate, pr.ceiling,
   CASE WHEN m_f <= m_c THEN n_f ELSE n_c END AS batch,
   CASE WHEN m_f <= m_c THEN (CASE WHEN pr.ceiling < 25 THEN (m_f * 3.0::DOUBLE + m_c) / 4.0::DOUBLE ELSE m_f END)
        ELSE (CASE WHEN pr.ceiling < 25 THEN (m_c * 3.0::DOUBLE + m_f) / 4.0::DOUBLE ELSE m_c END) END AS mean
   FROM bw JOIN pr ON pr.ngpu = bw.ngpu AND pr.p = bw.p),
cand2 AS (SELECT cand.*, CASE WHEN mean >= 1 THEN 1.0::DOUBLE WHEN mean <= 0 THEN 0.0::DOUBLE
   ELSE CAST((SELECT min(hot_rank) FROM cdf WHERE cdf >= cand.mean) + 1 AS DOUBLE) / CAST((SELECT count(*) FROM cent) AS DOUBLE) END AS needed_p
   FROM cand)"""


def _candidates(s: Shared) -> DataFrame:
    b = s.best()
    w = b.groupBy("ngpu", "p").agg(
        F.max(F.when(F.col("walk") == "floor", F.col("best_n"))).alias("n_f"),
        F.max(F.when(F.col("walk") == "floor", F.col("best_mean"))).alias("m_f"),
        F.max(F.when(F.col("walk") == "ceil", F.col("best_n"))).alias("n_c"),
        F.max(F.when(F.col("walk") == "ceil", F.col("best_mean"))).alias("m_c"))
    j = w.join(s.points.select("ngpu", "p", "rate", "ceiling"), ["ngpu", "p"])
    low = F.col("ceiling") < 25
    floor_first = F.col("m_f") <= F.col("m_c")
    mean = F.when(floor_first, F.when(low, (F.col("m_f") * F.lit(3.0) + F.col("m_c")) / F.lit(4.0)).otherwise(F.col("m_f"))) \
        .otherwise(F.when(low, (F.col("m_c") * F.lit(3.0) + F.col("m_f")) / F.lit(4.0)).otherwise(F.col("m_c")))
    j = j.withColumn("batch", F.when(floor_first, F.col("n_f")).otherwise(F.col("n_c"))).withColumn("mean", mean)
    # smallest hot prefix reaching the mean: one conditional-min per candidate
    # against the nlist-row CDF (config-sized), via a range join on cdf >= mean
    cdf = s.c.st.cdf.select("hot_rank", F.col("cdf").alias("_cdf"))
    k = j.join(cdf, F.col("_cdf") >= F.col("mean"), "left").groupBy("ngpu", "p").agg(
        F.min("hot_rank").alias("_first"))
    j = j.join(k, ["ngpu", "p"], "left")
    need_p = F.when(F.col("mean") >= 1, F.lit(1.0)).when(F.col("mean") <= 0, F.lit(0.0)) \
        .otherwise((F.col("_first") + 1).cast("double") / F.lit(float(s.c.nlist)))
    return j.withColumn("needed_p", need_p).drop("_first")


@_reg("cap_candidate_eval", f"""{_cap_common_sql(_SC, P_STEPS)}, {_CAND_SQL}
SELECT ngpu, p, CAST(batch AS INTEGER) AS batch, {_r('mean')} AS mean, {_r('needed_p')} AS needed_p FROM cand2""")
def cap_candidate_eval(spark, sf):
    """Per GPU count and prefix: branch with the lower required mean (blended
    3:1 when the ceiling is below 25 req/s) and the hot prefix it needs."""
    c = _candidates(Shared(spark, sf))
    return rnd(c.select("ngpu", "p", F.col("batch").cast("int").alias("batch"), "mean", "needed_p"), 6, "mean", "needed_p")


@_reg("cap_choose_prefix", f"""{_cap_common_sql(_SC, P_STEPS, 0.99)}, {_CAND_SQL}
SELECT ngpu, p, CAST(batch AS INTEGER) AS batch, {_r('mean')} AS mean, {_r('rate')} AS rate FROM (
  SELECT *, row_number() OVER (PARTITION BY ngpu ORDER BY p) AS rn FROM cand2 WHERE needed_p <= p) z WHERE rn = 1""")
def cap_choose_prefix(spark, sf):
    """Smallest self-consistent prefix on the grid 0..0.99: the prefix the
    required mean calls for fits inside it."""
    c = _candidates(Shared(spark, sf, upto=0.99)).where(F.col("needed_p") <= F.col("p"))
    first = c.groupBy("ngpu").agg(F.min("p").alias("p"))
    out = c.join(first, ["ngpu", "p"])
    return rnd(out.select("ngpu", "p", F.col("batch").cast("int").alias("batch"), "mean", "rate"), 6, "mean", "rate")


# ------------------------------------------------------------- CAP8 budget
_BUD_ROWS = [(n, 41.23, dict(cat.GPUS)[DEVICE], 19.85, 1, r[0], r[2], r[1], r[3], r[4], r[5], r[6], r[7], n)
             for r in cat.INDEXES for n in (1, 2)]
_BUDGET_SQL = f"""fits AS (SELECT index, ngpu, min(CASE WHEN mem_whole >= ngpu * gpu_mem THEN p END) AS p_hi,
    max(CASE WHEN p = 1.0 THEN mem_whole END) AS whole FROM mem GROUP BY index, ngpu),
bud AS (SELECT index, ngpu, CASE WHEN whole <= ngpu * {dict(cat.GPUS)[DEVICE]}::DOUBLE THEN 1.0::DOUBLE ELSE p_hi END AS ppt FROM fits),
bud2 AS (SELECT bud.*, CAST(floor(ppt * CAST((SELECT count(*) FROM cent) AS DOUBLE)) AS BIGINT) AS p_cid FROM bud),
bud3 AS (SELECT b.index, b.ngpu, b.ppt, CASE WHEN b.ppt >= 1.0 THEN 1.0::DOUBLE WHEN b.p_cid > 0 THEN c.cdf ELSE 0.0::DOUBLE END AS mhr
  FROM bud2 b LEFT JOIN cdf c ON c.hot_rank = b.p_cid - 1)"""


def _budget(c: Cap) -> DataFrame:
    m = cp.memory(c.mem_points(_BUD_ROWS, P_STEPS_FINE))
    g = m.groupBy("index", "ngpu", "gpu_mem").agg(
        F.min(F.when(F.col("mem_whole") >= F.col("ngpu") * F.col("gpu_mem"), F.col("p"))).alias("p_hi"),
        F.max(F.when(F.col("p") == 1.0, F.col("mem_whole"))).alias("whole"))
    g = g.withColumn("ppt", F.when(F.col("whole") <= F.col("ngpu") * F.col("gpu_mem"), F.lit(1.0)).otherwise(F.col("p_hi")))
    g = g.withColumn("p_cid", F.floor(F.col("ppt") * F.lit(float(c.nlist))).cast("bigint"))
    cdf = c.st.cdf.select(F.col("hot_rank"), F.col("cdf"))
    j = g.join(cdf, F.col("hot_rank") == F.col("p_cid") - 1, "left")
    mhr = F.when(F.col("ppt") >= 1.0, F.lit(1.0)).when(F.col("p_cid") > 0, F.col("cdf")).otherwise(F.lit(0.0))
    return j.select("index", "ngpu", "ppt", mhr.alias("mhr"))


@_reg("cap_budget_prefix", f"""{_IDX}, {_PV}, {_pts_sql(_BUD_ROWS, P_STEPS_FINE)}, {_BUDGET_SQL}
SELECT index, ngpu, {_r('ppt')} AS ppt, {_r('mhr')} AS mhr FROM bud3""")
def cap_budget_prefix(spark, sf):
    """Prefix fraction at which each catalog index outgrows n devices (1.0 when
    it fits whole) and the hit rate that prefix gives."""
    return rnd(_budget(Cap(spark, sf)), 6, "ppt", "mhr")


# ---------------------------------------------------------- CAP9 dedicated
_DED_SQL = f"""ded0 AS (
  SELECT index, ngpu AS n, (SELECT max(mem_whole) FROM mem m2 WHERE m2.index = b.index AND m2.p = 1.0) AS whole,
         ppt, mhr FROM bud3 b),
ded1 AS (SELECT d.*, ix.slo_ms, 41.23::DOUBLE * (8 - d.n) / 8.0::DOUBLE AS rate0, ix.slo_ms / 2000.0::DOUBLE AS T2,
    CAST(CASE WHEN {dict(cat.GPUS)[DEVICE]}::DOUBLE < d.whole THEN ceil(d.whole / ({dict(cat.GPUS)[DEVICE]}::DOUBLE * 1)) ELSE 1 END AS BIGINT) AS n2
  FROM ded0 d JOIN {cat.values_sql(cat.INDEXES, 'index, ntotal, nlist, d, m, msub, ksub, slo_ms').replace(' AS t(', ' AS ix(')} ON ix.index = d.index),
ded2 AS (SELECT *, CAST(floor(rate0 * T2) AS BIGINT) + 1 AS b0 FROM ded1 WHERE n >= 1 AND n <= least(n2, 7)),
dsteps AS (SELECT ded2.*, t.b FROM ded2, range(1, {MAX_N} + 1) t(b) WHERE t.b <= ded2.b0),
dmin AS (SELECT s.*, coalesce(dt.tail, CASE WHEN s.mhr >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS min_hr
  FROM dsteps s LEFT JOIN dtails dt ON dt.m = s.mhr AND dt.n = s.b),
dlat AS (SELECT dm.*, l.lut_t * (1.0::DOUBLE - dm.min_hr) + l.cq_t AS s1 FROM dmin dm LEFT JOIN lines2 l ON l.n = dm.b),
gpl AS (SELECT n, pred FROM (SELECT ns.n, s.slope * ns.x + s.intercept AS pred,
    row_number() OVER (PARTITION BY ns.n ORDER BY s.start) AS rn FROM ns JOIN gseg s ON ns.x >= s.start AND ns.x < s."end"
    WHERE s.component = 'search') z WHERE rn = 1),
dlat2 AS (SELECT d.*, coalesce(CASE WHEN 1.0::DOUBLE - d.min_hr = 0 THEN coalesce(g.pred, d.s1) ELSE d.s1 END, 0.0::DOUBLE) AS search_time
  FROM dlat d LEFT JOIN gpl g ON g.n = d.b),
dok AS (SELECT index, n, max(b) AS batch FROM dlat2 WHERE search_time <= T2 GROUP BY index, n),
ded AS (SELECT d.index, d.n, CASE WHEN k.batch = d.b0 THEN d.rate0 ELSE k.batch / d.T2 END AS rate, k.batch,
    d2.search_time FROM ded2 d JOIN dok k ON k.index = d.index AND k.n = d.n
    JOIN dlat2 d2 ON d2.index = d.index AND d2.n = d.n AND d2.b = k.batch)"""


def _ded_common_sql():
    dmeans = "(SELECT DISTINCT mhr AS m FROM bud3) g"
    return (_cap_common_sql(_BUD_ROWS, P_STEPS_FINE) + ", " + _BUDGET_SQL + ", "
            + _tail_sql(dmeans, list(range(1, MAX_N + 1)), pfx="d") + ", " + _DED_SQL)


def _dedicated(sh: "Shared", c: Cap) -> DataFrame:
    gpu_mem = dict(cat.GPUS)[DEVICE]
    spark = c.spark
    bud = _budget(c)
    whole = cp.memory(c.mem_points(_BUD_ROWS, P_STEPS_FINE)).where(F.col("p") == 1.0) \
        .groupBy("index").agg(F.max("mem_whole").alias("whole"))
    ix = spark.createDataFrame([(r[0], r[7]) for r in cat.INDEXES], "index string, slo_ms int")
    d = (bud.withColumnRenamed("ngpu", "n").join(whole, "index").join(F.broadcast(ix), "index")
         .withColumn("rate0", F.lit(41.23) * (F.lit(8) - F.col("n")) / F.lit(8.0))
         .withColumn("T2", F.col("slo_ms") / F.lit(2000.0))
         .withColumn("n2", F.when(F.lit(gpu_mem) < F.col("whole"), F.ceil(F.col("whole") / F.lit(gpu_mem * 1)))
                     .otherwise(F.lit(1)).cast("bigint"))
         .where((F.col("n") >= 1) & (F.col("n") <= F.least(F.col("n2"), F.lit(7))))
         .withColumn("b0", F.floor(F.col("rate0") * F.col("T2")).cast("bigint") + 1))
    steps = d.withColumn("b", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("b0"), F.lit(MAX_N).cast("bigint")))))
    var = sh.var
    means = d.select(F.col("mhr").alias("m")).distinct().crossJoin(F.broadcast(var)) \
        .withColumn("c", F.col("m") * (F.lit(1.0) - F.col("m")) / (F.lit(4.0) * F.col("var") * F.col("m") * (F.lit(1.0) - F.col("m"))) - F.lit(1.0)) \
        .drop("var")
    tails = tl.tail(means, list(range(1, MAX_N + 1))).select(F.col("m").alias("mhr"), F.col("n").cast("bigint").alias("b"), "tail")
    steps = steps.join(tails, ["mhr", "b"], "left").withColumn(
        "min_hr", F.coalesce("tail", F.when(F.col("mhr") >= 1, F.lit(1.0)).otherwise(F.lit(0.0))))
    lines = sh.lines.select(F.col("n").cast("bigint").alias("b"), "lut_t", "cq_t")
    steps = steps.join(F.broadcast(lines), "b", "left").withColumn(
        "s1", F.col("lut_t") * (F.lit(1.0) - F.col("min_hr")) + F.col("cq_t"))
    g = lt.predict(steps.select(F.col("b").cast("int").alias("n")), sh.gseg.where(F.col("component") == "search"),
                   "halfopen_first", "n").select(F.col("n").cast("bigint").alias("b"), F.col("pred").alias("_g"))
    steps = steps.join(g, "b", "left").withColumn(
        "search_time", F.coalesce(F.when(F.lit(1.0) - F.col("min_hr") == 0, F.coalesce("_g", "s1")).otherwise(F.col("s1")),
                                  F.lit(0.0)))
    ok = steps.where(F.col("search_time") <= F.col("T2")).groupBy("index", "n").agg(F.max("b").alias("batch"))
    out = d.join(ok, ["index", "n"]).join(steps.select("index", "n", F.col("b").alias("batch"), "search_time"),
                                         ["index", "n", "batch"])
    rate = F.when(F.col("batch") == F.col("b0"), F.col("rate0")).otherwise(F.col("batch") / F.col("T2"))
    return out.select("index", "n", rate.alias("rate"), "batch", "search_time")


@_reg("cap_dedicated", f"""{_ded_common_sql()}
SELECT index, CAST(n AS INTEGER) AS n, {_r('rate')} AS rate, CAST(batch AS BIGINT) AS batch, round(search_time, 9) AS search_time FROM ded""")
def cap_dedicated(spark, sf):
    """Dedicated-device options per catalog index: for each search-device count
    the largest batch (from int(rate * T) + 1 down) whose predicted search
    time, at the batch-minimum hit rate of the budget prefix, meets T = slo/2."""
    sh = Shared(spark, sf, rows=_BUD_ROWS, steps=P_STEPS_FINE)
    out = _dedicated(sh, sh.c)
    return rnd(rnd(out.withColumn("n", F.col("n").cast("int")).withColumn("batch", F.col("batch").cast("bigint")),
                   6, "rate"), 9, "search_time")


# ------------------------------------------------------- CAP11-14 (runs)
ST = sp.stages_cte()
_PERF_SQL = cat.values_sql(cat.MODEL_PERF, "model, kind, device, input, output, ngpu, value")
_LADDER_SQL = ", ".join(f"{f!r}::DOUBLE" for f in cp.LADDER)


@_reg("cap_rate_ladder", f"""WITH {ST}, rates AS (SELECT DISTINCT rate FROM st),
perf AS (SELECT model, device, input, output, ngpu, value AS ceiling FROM {_PERF_SQL} WHERE kind = 'tput'),
lad AS (SELECT perf.*, CASE WHEN ceiling >= 16 THEN list_transform([{_LADDER_SQL}], lambda f: round_even(ceiling * f, 0))
                            ELSE list_transform([{_LADDER_SQL}], lambda f: ceiling * f) END AS ladder FROM perf)
SELECT l.model, l.device, l.input, l.output, l.ngpu, r.rate AS rate_now,
  round(list_min(list_filter(l.ladder, lambda x: x > r.rate)), 6) AS next_rate,
  round(l.ladder[1], 6) AS first_rate, round(l.ladder[11], 6) AS last_rate
FROM lad l, rates r""")
def cap_rate_ladder(spark, sf):
    """Sweep ladder (11 fractions of each catalog ceiling, integral above 16
    req/s) and the next rate above each arrival rate seen in the log."""
    req = fx.requests(spark, sf)
    rates = req.select("rate").distinct()
    perf = cat.model_perf(spark).where(F.col("kind") == "tput").select(
        "model", "device", "input", "output", "ngpu", F.col("value").alias("ceiling"))
    lad = perf.withColumn("ladder", cp.ladder(F.col("ceiling")))
    # both sides are config-bounded (catalog rows x distinct run rates)
    j = F.broadcast(lad).crossJoin(rates)
    out = j.select("model", "device", "input", "output", "ngpu", F.col("rate").alias("rate_now"),
                   F.array_min(F.filter("ladder", lambda x: x > F.col("rate"))).alias("next_rate"),
                   F.col("ladder")[0].alias("first_rate"), F.col("ladder")[10].alias("last_rate"))
    return rnd(out, 6, "next_rate", "first_rate", "last_rate")


@_reg("cap_lookup", f"""WITH {ST}, runs AS (SELECT DISTINCT ngpu, input_len, output_len FROM st),
perf AS (SELECT * FROM {_PERF_SQL} WHERE model = '{MODEL}' AND device = '{DEVICE}')
SELECT r.ngpu, r.input_len, r.output_len, coalesce(t.value, -1.0::DOUBLE) AS ceiling, coalesce(s.value, -1.0::DOUBLE) AS prefill_slo
FROM runs r LEFT JOIN perf t ON t.kind = 'tput' AND t.input = r.input_len AND t.output = r.output_len AND t.ngpu = r.ngpu
LEFT JOIN perf s ON s.kind = 'slo' AND s.input = r.input_len AND s.output = r.output_len AND s.ngpu = r.ngpu""")
def cap_lookup(spark, sf):
    """Rate ceiling and prefill objective of each run's (GPUs, lengths); -1
    where the catalog has no entry."""
    req = fx.requests(spark, sf)
    runs = req.select("ngpu", "input_len", "output_len").distinct()
    perf = cat.model_perf(spark).where((F.col("model") == MODEL) & (F.col("device") == DEVICE))
    keys = [F.col("input").alias("input_len"), F.col("output").alias("output_len"), "ngpu"]
    t = perf.where(F.col("kind") == "tput").select(*keys, F.col("value").alias("ceiling"))
    s = perf.where(F.col("kind") == "slo").select(*keys, F.col("value").alias("prefill_slo"))
    out = runs.join(F.broadcast(t), ["input_len", "output_len", "ngpu"], "left") \
        .join(F.broadcast(s), ["input_len", "output_len", "ngpu"], "left")
    return out.fillna(-1.0, ["ceiling", "prefill_slo"]).select("ngpu", "input_len", "output_len", "ceiling", "prefill_slo")


_MODES_SQL = cat.values_sql(SEARCH_MODES, "mode, search_mode").replace(" AS t(", " AS m(")


@_reg("cap_mode_rules", f"""WITH {ST}, runs AS (SELECT DISTINCT mode, ngpu, rate FROM st),
mr1 AS (SELECT r.mode, m.search_mode, r.ngpu, r.rate,
  CASE WHEN m.search_mode = 'ded-gpu' THEN 1 ELSE 1 END AS ann_workers FROM runs r JOIN {_MODES_SQL} ON m.mode = r.mode),
mr2 AS (SELECT *, CAST(CASE WHEN search_mode = 'ded-gpu' THEN (ngpu - ann_workers) // 1 ELSE ngpu // 1 END AS INTEGER) AS llm_workers FROM mr1)
SELECT mode, search_mode, ngpu, rate, CAST(ann_workers AS INTEGER) AS ann_workers, llm_workers,
  search_mode = 'hybrid' AS dispatcher, CAST(CASE WHEN search_mode = 'hybrid' THEN 150 ELSE -1 END AS INTEGER) AS search_slo,
  CAST(floor({RUN_SECONDS} * CAST(rate AS DOUBLE)) AS BIGINT) AS total_requests, llm_workers AS warmup_requests FROM mr2""")
def cap_mode_rules(spark, sf):
    """Derived run settings per (mode, GPUs, rate) for llama8b (tp 1) on L40S
    with the wikiall index: workers, dispatcher, search objective, request
    counts int(120 s x rate) and warm-up requests."""
    req = fx.requests(spark, sf)
    runs = req.select("mode", "ngpu", "rate").distinct()
    modes = spark.createDataFrame(SEARCH_MODES, "mode string, search_mode string")
    tp = 1
    # ann workers: tp for dedicated search (4 only for orcas2k on L40S), else 1
    r = runs.join(F.broadcast(modes), "mode").withColumn("ann_workers", F.lit(tp).cast("int"))
    llm = F.when(F.col("search_mode") == "ded-gpu", F.floor((F.col("ngpu") - F.col("ann_workers")) / tp)) \
        .otherwise(F.floor(F.col("ngpu") / tp)).cast("int")
    hybrid = F.col("search_mode") == "hybrid"
    return (r.withColumn("llm_workers", llm)
            .withColumn("dispatcher", hybrid)
            .withColumn("search_slo", F.when(hybrid, F.lit(150)).otherwise(F.lit(-1)).cast("int"))
            .withColumn("total_requests", F.floor(F.lit(float(RUN_SECONDS)) * F.col("rate").cast("double")).cast("bigint"))
            .withColumn("warmup_requests", F.col("llm_workers"))
            .select("mode", "search_mode", "ngpu", "rate", "ann_workers", "llm_workers", "dispatcher", "search_slo",
                    "total_requests", "warmup_requests"))


_IDX_NAMES = [r[0] for r in cat.INDEXES]
_MODEL_NAMES = [m[0] for m in cat.MODELS]


@_reg("cap_run_matrix", f"""WITH {ST}, modes AS (SELECT DISTINCT m.search_mode FROM st JOIN {_MODES_SQL} ON m.mode = st.mode)
SELECT modes.search_mode, i.index, md.model FROM modes,
  (SELECT unnest([{', '.join(repr(n) for n in _IDX_NAMES)}]) AS index) i,
  (SELECT unnest([{', '.join(repr(n) for n in _MODEL_NAMES)}]) AS model) md
WHERE modes.search_mode <> 'none' AND md.model IN ('llama8b', 'qwen32b')""")
def cap_run_matrix(spark, sf):
    """Run matrix for the request 'mode=all, index=all, model=llama8b,qwen32b':
    every search mode seen in the log x every index x the chosen models."""
    req = fx.requests(spark, sf)
    modes = spark.createDataFrame(SEARCH_MODES, "mode string, search_mode string")
    m = req.select("mode").distinct().join(F.broadcast(modes), "mode").select("search_mode").distinct() \
        .where(F.col("search_mode") != "none")
    return (m.withColumn("index", F.explode(F.array(*[F.lit(n) for n in _IDX_NAMES])))
            .withColumn("model", F.explode(F.array(*[F.lit(n) for n in ("llama8b", "qwen32b")]))))


_SHARED8_SQL = (f"""{_cap_common_sql([r for r in _SC if r[0] == 8], P_STEPS, 0.99)}, {_CAND_SQL}
SELECT 'shared' AS scheme, 0 AS n, rate, batch FROM (
  SELECT *, row_number() OVER (ORDER BY p) AS rn FROM cand2 WHERE needed_p <= p) z WHERE rn = 1""")
_DED_WIKI_SQL = f"""{_ded_common_sql()}
SELECT 'dedicated' AS scheme, CAST(n AS INTEGER) AS n, rate, batch FROM ded WHERE index = 'wikiall'"""


@_reg("cap_best_scheme", f"""SELECT scheme, CAST(n AS INTEGER) AS n, round(rate, 6) AS rate, CAST(batch AS BIGINT) AS batch FROM (
  SELECT *, row_number() OVER (ORDER BY rate DESC, n DESC) AS rn FROM (
    SELECT * FROM ({_SHARED8_SQL}) s UNION ALL SELECT * FROM ({_DED_WIKI_SQL}) d) a) z WHERE rn = 1""")
def cap_best_scheme(spark, sf):
    """Shared (hot prefix on every device) vs dedicated search devices for
    llama8b on 8 L40S with wikiall: highest throughput wins, ties to the later
    candidate."""
    base = SharedBase(spark, sf)
    sh = Shared(spark, sf, rows=_BUD_ROWS, steps=P_STEPS_FINE, base=base)
    ded = _dedicated(sh, sh.c).where(F.col("index") == "wikiall").select(
        F.lit("dedicated").alias("scheme"), F.col("n").cast("int").alias("n"), "rate", F.col("batch").cast("bigint").alias("batch"))
    s8 = Shared(spark, sf, rows=[r for r in _SC if r[0] == 8], steps=P_STEPS, upto=0.99, base=base)
    c = _candidates(s8).where(F.col("needed_p") <= F.col("p"))
    first = c.groupBy("ngpu").agg(F.min("p").alias("p"))
    shared = c.join(first, ["ngpu", "p"]).select(F.lit("shared").alias("scheme"), F.lit(0).alias("n"), "rate",
                                                  F.col("batch").cast("bigint").alias("batch"))
    allc = shared.unionByName(ded)
    # at most 1 + (devices / tp) candidate rows: a config-bounded ordering
    best = allc.orderBy(F.col("rate").desc(), F.col("n").desc()).limit(1)
    return rnd(best, 6, "rate")
