"""Registered inverted-list, routing and access-skew queries (IVF*, RTE1-8,
HIT1-7, HIT11) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.rounding import round_to

from ragspark.operators import hitrate as hr
from ragspark.operators import placement as pl
from ragspark.operators import routing as rt
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp
from ragspark.plans.vector_plans import probing

Q: dict = {}
SQL: dict = {}

SHARD_IDS = list(range(fx.SHARDS)) + [-1]
TARGETS = [0.0, 0.1, 0.25, 0.3, 0.5, 0.6, 0.75, 0.9, 0.95, 0.99, 1.0]
BETA_MEANS = [round(0.05 * i, 2) for i in range(1, 20)]


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


class State:
    """The index tables every key below derives from (lazy frames)."""

    def __init__(self, spark, sf):
        self.vecs, self.cent, self.asg, self.qs, self.probes = probing(spark, sf)
        self.nlist = self.cent.count()
        self.nq = self.vecs.count()          # every vector is a query
        self.sizes = pl.list_sizes(self.cent, self.asg)
        self.freq = hr.frequency(self.probes, self.cent)
        self.cdf = hr.cdf(self.freq, fx.NPROBE * self.nq)
        self.hot = hr.half_set(self.cdf)

    def placement(self):
        return pl.place(self.hot, self.sizes, fx.SHARDS)

    def lut(self):
        return pl.full_lut(self.cent, self.placement(), self.nlist)

    def routed(self):
        return rt.route(self.probes, self.lut(), self.nlist)


W = sp.index_ctes


@_reg("ivf_list_sizes", f"{W('cent', 'asg', 'sizes')} SELECT list_id, n FROM sizes")
def ivf_list_sizes(spark, sf):
    """Vectors per list, empty lists kept with 0."""
    return State(spark, sf).sizes


@_reg("ivf_size_stats", f"""{W('cent', 'asg', 'sizes')}
SELECT count(*) AS nlist, CAST(sum(n) AS BIGINT) AS ntotal, round(avg(n), 6) AS avg_size, max(n) AS max_size, min(n) AS min_size FROM sizes""")
def ivf_size_stats(spark, sf):
    """nlist, ntotal, mean / max / min list size."""
    out = pl.size_stats(State(spark, sf).sizes)
    return rnd(out.withColumn("ntotal", F.col("ntotal").cast("bigint")), 6, "avg_size")


@_reg("ivf_place", f"""{W(*sp.INDEX_ALL[:8])}
SELECT shard, count(*) AS n_lists, CAST(sum(n) AS BIGINT) AS n_vectors FROM place GROUP BY shard""")
def ivf_place(spark, sf):
    """Hot lists dealt round-robin over 3 shards by ascending size."""
    out = pl.shard_summary(State(spark, sf).placement())
    return out.withColumn("n_vectors", F.col("n_vectors").cast("bigint"))


@_reg("ivf_local_id", f"{W(*sp.INDEX_ALL[:8])} SELECT list_id, shard, local_id FROM place")
def ivf_local_id(spark, sf):
    """Hot lists placed round-robin by ascending size: (list, shard, local id)."""
    return State(spark, sf).placement().select("list_id", "shard", "local_id")


@_reg("ivf_extract", f"""{W(*sp.INDEX_ALL[:8])}
SELECT a.vec_id, a.list_id, p.shard, p.local_id FROM asg a JOIN place p ON p.list_id = a.list_id""")
def ivf_extract(spark, sf):
    """Members of the placed lists with their shard and local list id."""
    st = State(spark, sf)
    return pl.extract(st.asg.select("vec_id", "list_id"), st.placement(), st.nlist) \
        .select("vec_id", "list_id", "shard", "local_id")


@_reg("ivf_extract_single", f"""{W(*sp.INDEX_ALL[:7])}
SELECT h.list_id, s.n, CAST(row_number() OVER (ORDER BY s.n, h.list_id) - 1 AS BIGINT) AS local_id
FROM half h JOIN sizes s ON s.list_id = h.list_id WHERE h.list_id <> -1""")
def ivf_extract_single(spark, sf):
    """One-shard variant: hot lists renumbered by ascending size."""
    st = State(spark, sf)
    return pl.extract_single(st.hot, st.sizes).select("list_id", "n", "local_id")


@_reg("ivf_full_lut", f"{W(*sp.INDEX_ALL[:9])} SELECT list_id, shard, local_id FROM lut")
def ivf_full_lut(spark, sf):
    """Every list mapped to (shard, local id); unplaced lists shard -1, own id; range-checked."""
    return State(spark, sf).lut()


@_reg("ivf_hot_share", f"""{W(*sp.INDEX_ALL[:7])}, g AS (
  SELECT CAST(sum(CASE WHEN h.list_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hot_lists, count(*) AS all_lists,
         CAST(sum(CASE WHEN h.list_id IS NOT NULL THEN s.n ELSE 0 END) AS BIGINT) AS hot_vectors,
         CAST(sum(s.n) AS BIGINT) AS all_vectors
  FROM sizes s LEFT JOIN half h ON h.list_id = s.list_id)
SELECT hot_lists, all_lists, hot_vectors, all_vectors, round(hot_lists * 100.0::DOUBLE / all_lists, 6) AS pct_lists,
       round(hot_vectors * 100.0::DOUBLE / all_vectors, 6) AS pct_vectors FROM g""")
def ivf_hot_share(spark, sf):
    """Hot lists and their vectors as counts and percent of the index."""
    st = State(spark, sf)
    return rnd(pl.hot_share(st.sizes, st.hot), 6, "pct_lists", "pct_vectors")


@_reg("ivf_all_hot", f"""{W(*sp.INDEX_ALL[:7])}
SELECT (SELECT count(*) FROM half) AS hot_lists, (SELECT count(*) FROM sizes) AS all_lists,
       (SELECT count(*) FROM half) = (SELECT count(*) FROM sizes) AS all_hot""")
def ivf_all_hot(spark, sf):
    """Whether every list is hot (then the index stays unsplit)."""
    st = State(spark, sf)
    return pl.all_hot(st.sizes, st.hot)


# ------------------------------------------------------------------ routing
@_reg("rte_map_probes", f"{W(*sp.INDEX_ALL)} SELECT qid, probe_rank, list_id, shard, local_id FROM routed")
def rte_map_probes(spark, sf):
    """Probes joined to the full list map: shard and local id per probe."""
    return State(spark, sf).routed().select("qid", "probe_rank", "list_id", "shard", "local_id")


@_reg("rte_group_rank", f"{W(*sp.INDEX_ALL)} SELECT qid, shard, pos, local_id FROM routed")
def rte_group_rank(spark, sf):
    """Position of each probe among the query probes on the same shard."""
    return State(spark, sf).routed().select("qid", "shard", "pos", "local_id")


@_reg("rte_shard_start", f"""{W(*sp.INDEX_ALL)}, g AS (SELECT shard, count(*) AS n FROM routed GROUP BY shard)
SELECT shard, n, CAST(coalesce(sum(n) OVER (ORDER BY CASE WHEN shard < 0 THEN 1073741824 ELSE shard END
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g""")
def rte_shard_start(spark, sf):
    """Routed rows per shard and exclusive prefix offsets (cold shard last)."""
    return rt.shard_starts(State(spark, sf).routed())


_SHARDS_SQL = "(VALUES " + ", ".join(f"({s})" for s in SHARD_IDS) + ") AS s(shard)"


@_reg("rte_width", f"""{W(*sp.INDEX_ALL)}, pq AS (SELECT shard, qid, count(*) AS c FROM routed GROUP BY shard, qid),
w AS (SELECT shard, max(c) AS width FROM pq GROUP BY shard)
SELECT CAST(s.shard AS BIGINT) AS shard, CAST(coalesce(w.width, 0) AS BIGINT) AS width FROM {_SHARDS_SQL} LEFT JOIN w ON w.shard = s.shard""")
def rte_width(spark, sf):
    """Per shard the largest number of probes any query sends there (0 if none)."""
    return rt.widths(State(spark, sf).routed(), SHARD_IDS)


@_reg("rte_pad", f"""{W(*sp.INDEX_ALL)}, pq AS (SELECT shard, qid, count(*) AS c FROM routed GROUP BY shard, qid),
w AS (SELECT CAST(s.shard AS BIGINT) AS shard, CAST(coalesce(max(pq.c), 0) AS BIGINT) AS width
      FROM {_SHARDS_SQL} LEFT JOIN pq ON pq.shard = s.shard GROUP BY s.shard),
l AS (SELECT qid, shard, list(local_id ORDER BY pos) AS ids FROM routed GROUP BY qid, shard),
grid AS (SELECT e.vec_id AS qid, w.shard, w.width FROM embeddings e, w)
SELECT g.qid, g.shard, g.width,
  array_to_string(list_concat(coalesce(l.ids, []::BIGINT[]), list_transform(range(g.width - len(coalesce(l.ids, []::BIGINT[]))), lambda x: -1)), ',') AS padded
FROM grid g LEFT JOIN l ON l.qid = g.qid AND l.shard = g.shard""")
def rte_pad(spark, sf):
    """Dense per-(query, shard) local-id arrays padded with -1 to the shard width."""
    st = State(spark, sf)
    out = rt.padded(st.routed(), st.qs, SHARD_IDS)
    return out.select("qid", "shard", "width", F.array_join("padded", ",").alias("padded"))


@_reg("rte_miss_count", f"""{W(*sp.INDEX_ALL)}
SELECT qid, CAST(count_if(shard = -1) AS BIGINT) AS misses, round(({sp.NPROBE} - count_if(shard = -1)) / {float(sp.NPROBE)}::DOUBLE, 6) AS hit_rate
FROM routed GROUP BY qid""")
def rte_miss_count(spark, sf):
    """Cold probes per query and the resulting hit rate."""
    return rnd(rt.misses(State(spark, sf).routed(), fx.NPROBE), 6, "hit_rate")


@_reg("rte_hot_only", f"""{W(*sp.INDEX_ALL)}
SELECT DISTINCT qid FROM routed WHERE qid NOT IN (SELECT qid FROM routed WHERE shard = -1)""")
def rte_hot_only(spark, sf):
    """Queries with no cold probe (answerable from the device tier)."""
    return rt.hot_only(State(spark, sf).routed())


@_reg("rte_access_counts", f"{W('cent', 'probes')} SELECT list_id, count(*) AS accesses FROM probes GROUP BY list_id")
def rte_access_counts(spark, sf):
    """Accesses per list over all probes."""
    *_, probes = probing(spark, sf)
    return rt.access_counts(probes)


# ------------------------------------------------------------- access skew
@_reg("hit_freq", f"{W('cent', 'probes', 'freq')} SELECT list_id, freq FROM freq")
def hit_freq(spark, sf):
    """Accesses per list over all queries, zeros kept."""
    return State(spark, sf).freq


@_reg("hit_order", f"{W('cent', 'probes', 'freq', 'cdf')} SELECT hot_rank, list_id, freq FROM cdf")
def hit_order(spark, sf):
    """Lists by access frequency (descending, ties by id) - distributed dense rank."""
    return State(spark, sf).cdf.select("hot_rank", "list_id", "freq")


@_reg("hit_cdf", f"{W('cent', 'probes', 'freq', 'cdf')} SELECT hot_rank, list_id, freq, round(cdf, 9) AS cdf FROM cdf")
def hit_cdf(spark, sf):
    """Running share of probes along the hot order (distributed prefix sum)."""
    return rnd(State(spark, sf).cdf.select("hot_rank", "list_id", "freq", "cdf"), 9, "cdf")


@_reg("hit_half_set", f"{W('cent', 'probes', 'freq', 'cdf', 'half')} SELECT hot_rank, list_id, freq FROM half")
def hit_half_set(spark, sf):
    """Lists before the access CDF first reaches 0.5."""
    return State(spark, sf).hot.select("hot_rank", "list_id", "freq")


HQ = f"""hq AS (SELECT p.qid, sum(CASE WHEN h.list_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / {float(sp.NPROBE)}::DOUBLE AS hit_rate
  FROM probes p LEFT JOIN half h ON h.list_id = p.list_id GROUP BY p.qid)"""


@_reg("hit_per_query", f"{W('cent', 'probes', 'freq', 'cdf', 'half')}, {HQ} SELECT qid, hit_rate FROM hq")
def hit_per_query(spark, sf):
    """Share of each query probes inside the hot set."""
    st = State(spark, sf)
    return hr.per_query(st.probes, st.hot, fx.NPROBE)


@_reg("hit_moments", f"{W('cent', 'probes', 'freq', 'cdf', 'half')}, {HQ} SELECT round(avg(hit_rate), 9) AS mean, round(var_pop(hit_rate), 9) AS var FROM hq")
def hit_moments(spark, sf):
    """Mean and population variance of the per-query hit rates."""
    st = State(spark, sf)
    return rnd(hr.moments(hr.per_query(st.probes, st.hot, fx.NPROBE)), 9, "mean", "var")


_MEANS_SQL = "(VALUES " + ", ".join(f"({m}::DOUBLE)" for m in BETA_MEANS) + ") AS g(m)"


@_reg("hit_beta", f"""{W('cent', 'probes', 'freq', 'cdf', 'half')}, {HQ}, v AS (SELECT var_pop(hit_rate) AS v FROM hq),
b AS (SELECT m, 4.0::DOUBLE * v.v * m * (1.0::DOUBLE - m) AS est_var FROM {_MEANS_SQL}, v),
c AS (SELECT m, est_var, m * (1.0::DOUBLE - m) / est_var - 1.0::DOUBLE AS c FROM b)
SELECT m, round(est_var, 6) AS est_var, round(c, 6) AS c, round(m * c, 6) AS alpha, round((1.0::DOUBLE - m) * c, 6) AS beta FROM c""")
def hit_beta(spark, sf):
    """Beta parameters over a grid of means from the observed variance."""
    st = State(spark, sf)
    var = hr.moments(hr.per_query(st.probes, st.hot, fx.NPROBE)).select("var")
    grid = spark.createDataFrame([(m,) for m in BETA_MEANS], "m double")
    out = hr.beta_params(grid.crossJoin(F.broadcast(var)), "var").drop("var")
    return rnd(out, 6, "est_var", "c", "alpha", "beta")


_TGT_SQL = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in TARGETS) + ") AS t(target)"


@_reg("hit_prefix_for_target", f"""{W('cent', 'probes', 'freq', 'cdf')}
SELECT t.target, CAST(CASE WHEN t.target <= 0 THEN 0 WHEN t.target >= 1 THEN (SELECT count(*) FROM cdf)
  ELSE (SELECT min(hot_rank) FROM cdf WHERE cdf >= t.target) + 1 END AS BIGINT) AS prefix_len FROM {_TGT_SQL}""")
def hit_prefix_for_target(spark, sf):
    """Smallest hot prefix whose CDF reaches each target (one conditional aggregate)."""
    return hr.prefix_for_targets(State(spark, sf).cdf, TARGETS)
