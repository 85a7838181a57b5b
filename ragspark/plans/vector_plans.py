"""Registered vector-search queries (VEC*) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.rounding import round_to

from ragspark.functions.ranks import snapshot
from ragspark.operators import index_table as IX
from ragspark.operators import probe as PR
from ragspark.operators import quantize as QZ
from ragspark.operators import search as S
from ragspark.operators import vector as V
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp

Q: dict = {}
SQL: dict = {}


def _reg(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def assignment(spark: SparkSession, sf: str, with_blocks: bool = False, ranked=None):
    """Fixed-init centroids and the nearest-list assignment of every vector;
    centroids under the broadcast cap are collected once for the probe step too.
    The fourth value is that matrix (None: beyond the cap)."""
    vecs = fx.vectors(spark, sf)
    cent = fx.fixed_centroids(vecs, ranked)
    blocks = V.ref_matrix(cent, "list_id", "centroid")
    asg = V.nearest(vecs, cent, 1, base_id="vec_id", base_vec="embedding", ref_id="list_id",
                    ref_vec="centroid", out_base="vec_id", out_ref="list_id", matrix=blocks).drop("rank")
    # the assignment is the index: written once, scanned by every later step
    asg = snapshot(asg, "assignment")
    return (vecs, cent, asg, blocks) if with_blocks else (vecs, cent, asg)


def probing(spark: SparkSession, sf: str, nprobe: int = fx.NPROBE, ranked=None, with_blocks: bool = False):
    vecs, cent, asg, blocks = assignment(spark, sf, with_blocks=True, ranked=ranked)
    qs = fx.queries(spark, sf)
    probes = V.nearest(qs, cent, nprobe, base_id="qid", base_vec="embedding", ref_id="list_id",
                       ref_vec="centroid", out_base="qid", out_ref="list_id",
                       out_rank="probe_rank", out_dist="cdist", matrix=blocks)
    out = (vecs, cent, asg, qs, snapshot(probes, "probes"))
    return out + (blocks,) if with_blocks else out


def _r4(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, round_to(c, 4))
    return df


@_reg("vec_l2", f"""SELECT a.vec_id AS vec_id, b.vec_id AS other_id, round({sp.l2('a.embedding', 'b.embedding')}, 4) AS dist
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_l2(spark, sf):
    """Squared L2 of each vector to its id successor (a 1:1 join, JVM-side math)."""
    e = fx.vectors(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"),
                   F.col("embedding").alias("other"))
    return _r4(V.pair_distance(e, nxt, "vec_id", "embedding", "other").select("vec_id", "other_id", "dist"), "dist")


@_reg("vec_exact_knn", sp.topk(f"(SELECT q.vec_id AS qid, v.vec_id, {sp.l2('q.embedding', 'v.embedding')} AS dist FROM embeddings q, embeddings v)"))
def vec_exact_knn(spark, sf):
    """Exact top-10 over all vectors for every query: query x vector block cells on the executors, final WindowGroupLimit."""
    res = V.exact_knn(fx.vectors(spark, sf), fx.queries(spark, sf), fx.TOPK)
    return _r4(res.select("qid", "rank", "vec_id", "dist"), "dist")


@_reg("vec_auto_nlist", "SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS nlist, count(*) AS ntotal FROM embeddings")
def vec_auto_nlist(spark, sf):
    """nlist = floor(sqrt(n)) from one aggregate."""
    e = fx.vectors(spark, sf)
    return e.agg(F.floor(F.sqrt(F.count(F.lit(1)))).cast("bigint").alias("nlist"), F.count(F.lit(1)).alias("ntotal"))


@_reg("vec_assign", f"WITH {sp.CENT}, {sp.ASG} SELECT vec_id, list_id, round(dist, 4) AS dist FROM asg")
def vec_assign(spark, sf):
    """Every vector to its nearest fixed-init list (broadcast centroid block, Arrow kernel, no shuffle)."""
    _, _, asg = assignment(spark, sf)
    return _r4(asg, "dist")


@_reg("vec_coarse_probe", f"WITH {sp.CENT}, {sp.PROBES} SELECT qid, probe_rank, list_id, round(cdist, 4) AS cdist FROM probes")
def vec_coarse_probe(spark, sf):
    """The 4 nearest lists of every query with their centroid distances."""
    *_, probes = probing(spark, sf)
    return _r4(probes, "cdist")


@_reg("vec_residual", f"""WITH {sp.CENT}, {sp.ASG}
SELECT a.vec_id, a.list_id,
  round(list_sum(list_transform(range(1, len(e.embedding)+1), lambda i: (e.embedding[i] - c.centroid[i])::DOUBLE)), 4) AS res_sum,
  round(list_sum(list_transform(range(1, len(e.embedding)+1), lambda i: ((e.embedding[i] - c.centroid[i])::DOUBLE) * ((e.embedding[i] - c.centroid[i])::DOUBLE))), 4) AS res_norm2
FROM asg a JOIN embeddings e ON e.vec_id = a.vec_id JOIN cent c ON c.list_id = a.list_id""")
def vec_residual(spark, sf):
    """VEC7: residual = vector - its list centroid (float arithmetic, as coded)."""
    vecs = fx.vectors(spark, sf)
    r = V.assign_carrying(vecs, fx.fixed_centroids(vecs))
    return _r4(r.select("vec_id", "list_id",
                        F.aggregate("res", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias("res_sum"),
                        F.aggregate("res", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")).alias("res_norm2")),
               "res_sum", "res_norm2")


@_reg("vec_centroid_fetch", f"""WITH {sp.CENT}, {sp.ASG}
SELECT a.vec_id, a.list_id, round(list_sum(list_transform(c.centroid, lambda x: x::DOUBLE)), 4) AS centroid_sum
FROM asg a JOIN cent c ON c.list_id = a.list_id""")
def vec_centroid_fetch(spark, sf):
    """VEC14: centroid of each vector's list, fetched by a join on list_id."""
    _, cent, asg = assignment(spark, sf)
    return _r4(asg.join(cent, "list_id").select(
        "vec_id", "list_id",
        F.aggregate("centroid", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias("centroid_sum")),
        "centroid_sum")


@_reg("vec_topk_merge", f"WITH {sp.CENT}, {sp.ASG}, {sp.PROBES}, {sp.FLAT_CAND} {sp.topk('cand')}")
def vec_topk_merge(spark, sf):
    """Probe -> per-list partial top-k over the index clustered by list -> final merge."""
    st = FlatState(spark, sf)
    return _r4(V.merge_topk(IX.scan(st.index, st.fixed_probes(), st.qs, fx.TOPK).drop("list_id"), fx.TOPK)
               .select("qid", "rank", "vec_id", "dist"), "dist")


class FlatState:
    """Vectors clustered by list, in one pass from the assignment."""

    def __init__(self, spark, sf):
        self.vecs, self.qs = fx.vectors(spark, sf), fx.queries(spark, sf)
        self.cent = fx.fixed_centroids(self.vecs)
        self.matrix = V.ref_matrix(self.cent, "list_id", "centroid")
        self.dim = V.vector_dim(self.cent, "centroid")
        self.index = IX.build(V.assign_carrying(self.vecs, self.cent, self.matrix), "embedding", self.dim)
        self.asg = self.index.members.select("vec_id", "list_id")

    def fixed_probes(self) -> DataFrame:
        return snapshot(V.nearest(self.qs, self.cent, fx.NPROBE, base_id="qid", base_vec="embedding", ref_id="list_id",
                                  ref_vec="centroid", out_base="qid", out_ref="list_id", out_rank="probe_rank",
                                  out_dist="cdist", matrix=self.matrix), "probes")

    def search(self, probes: DataFrame) -> DataFrame:
        return V.merge_topk(IX.scan(self.index, probes, self.qs, fx.TOPK).drop("list_id"), fx.TOPK)


# ------------------------------------------------------------ probe policy
RECALL_TARGET = 0.95


def _calibrates(col: str):
    """Half of the queries, by hash, set the reach; the others only use it."""
    return fx.hash_order(col) % 2 == 0


_POLICY = (f"WITH {sp.CENT}, {sp.ASG}, {sp.TRUE_KNN}, "
           f"{sp.policy(RECALL_TARGET, PR.GAP_CLASSES, sp.h('t.qid') + ' % 2 = 0')}")


def policy_probes(st: FlatState, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probes, near): every query's lists by the calibrated policy, and its class."""
    near = snapshot(PR.two_nearest(st.qs, st.cent, st.matrix), "near")
    reach = PR.calibrate(truth.where(_calibrates("qid")), st.asg, st.qs, st.cent, near, RECALL_TARGET)
    probes = PR.probe(st.qs, st.cent, near, reach, st.matrix).select("qid", "list_id")      # distances are not used again
    return snapshot(probes, "policy-probes"), near


@_reg("vec_probe_policy", f"""{_POLICY}, {sp.found('pprobes', 'fnd')},
np AS (SELECT qid, count(*) AS nprobe FROM pprobes GROUP BY qid),
rc AS (SELECT t.qid, count(f.vec_id) AS n_found, count(*) AS n_true FROM truth t LEFT JOIN fnd f
  ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid)
SELECT n.qid, n.gap_class, np.nprobe, {sp.h('n.qid')} % 2 = 0 AS calibrated, rc.n_found,
  round(rc.n_found / rc.n_true::DOUBLE, 4) AS recall
FROM near n JOIN np ON np.qid = n.qid JOIN rc ON rc.qid = n.qid""")
def vec_probe_policy(spark, sf):
    """Lists per query from the calibrated gap to the nearest centroid, and the
    query's recall@10 against the exact neighbours."""
    st = FlatState(spark, sf)
    truth = snapshot(V.exact_knn(st.vecs, st.qs, fx.TOPK).select("qid", "vec_id"), "truth")
    probes, near = policy_probes(st, truth)
    rec = PR.recall(st.search(probes), truth)
    n = probes.groupBy("qid").agg(F.count(F.lit(1)).alias("nprobe"))
    return _r4(near.join(n, "qid").join(rec, "qid").select(
        "qid", "gap_class", "nprobe", _calibrates("qid").alias("calibrated"), "n_found", "recall"), "recall")


# ------------------------------------------------------------ k-means / PQ
KMEANS_STEPS = 10
MSUB, KSUB = 2, 16
PQ_STEPS = sp.PQ_STEPS


@_reg("vec_kmeans", f"""WITH {sp.CENT}, {sp.lloyd(KMEANS_STEPS)}
SELECT c.list_id, count(a.vec_id) AS n_members, round(list_sum(c.centroid), 4) AS centroid_sum,
  round(list_sum(list_transform(c.centroid, lambda v: v * v)), 4) AS centroid_norm2
FROM c{KMEANS_STEPS} c LEFT JOIN a{KMEANS_STEPS} a ON a.list_id = c.list_id GROUP BY c.list_id, c.centroid""")
def vec_kmeans(spark, sf):
    """Ten Lloyd steps from the fixed init."""
    vecs = fx.vectors(spark, sf)
    _, cent = QZ.kmeans(vecs, fx.fixed_centroids(vecs), iters=KMEANS_STEPS)
    return _r4(cent.select(
        "list_id", F.col("n_members").cast("bigint").alias("n_members"),
        F.aggregate("centroid", F.lit(0.0).cast("double"), lambda a, x: a + x).alias("centroid_sum"),
        F.aggregate("centroid", F.lit(0.0).cast("double"), lambda a, x: a + x * x).alias("centroid_norm2")),
        "centroid_sum", "centroid_norm2")


class PQState:
    """Residuals written by the assignment pass, the codebook trained on all of
    them, codes clustered by list, probes of every query."""

    def __init__(self, spark, sf):
        self.vecs, self.qs = fx.vectors(spark, sf), fx.queries(spark, sf)
        ranked = fx.hash_ranked(self.vecs)                 # one hash ranking: centroids and first words
        self.cent = fx.fixed_centroids(self.vecs, ranked)
        self.matrix = V.ref_matrix(self.cent, "list_id", "centroid")
        self.nlist, self.dim = self.cent.count(), V.vector_dim(self.cent, "centroid")
        self.res = snapshot(V.assign_carrying(self.vecs, self.cent, self.matrix).select("vec_id", "list_id", "dist", "res"),
                            "residuals")
        self.asg = self.res.select("vec_id", "list_id", "dist")
        words = (ranked.where((F.col("hrank") >= self.nlist) & (F.col("hrank") < self.nlist + KSUB))
                 .select("vec_id", (F.col("hrank") - self.nlist).alias("word_id")).join(self.res, "vec_id"))
        self.codebook = QZ.train_codebook(self.res, MSUB, KSUB, iters=PQ_STEPS, init=words)
        self._probes = self._index = None

    @property
    def probes(self) -> DataFrame:
        if self._probes is None:
            self._probes = snapshot(V.nearest(
                self.qs, self.cent, fx.NPROBE, base_id="qid", base_vec="embedding", ref_id="list_id", ref_vec="centroid",
                out_base="qid", out_ref="list_id", out_rank="probe_rank", out_dist="cdist", matrix=self.matrix), "probes")
        return self._probes

    def codes(self) -> DataFrame:
        return QZ.pq_encode(self.res, self.codebook)

    @property
    def index(self) -> IX.ClusteredIndex:
        if self._index is None:
            self._index = IX.build(self.codes(), "code", self.dim)
        return self._index

    def scan(self, probes: DataFrame) -> DataFrame:
        return IX.scan(self.index, probes, self.qs, fx.TOPK, mode="pq", centroids=self.cent, codebook=self.codebook)


_PQ_BASE = f"WITH {sp.CENT}, {sp.ASG}, {sp.RES}, {sp.WORDS}, {sp.BOOK}"
_PQ_SEARCH = f"{_PQ_BASE}, {sp.PROBES}, {sp.ENC}, {sp.QLUT}, {sp.ADC_CAND}"


@_reg("vec_pq_encode", f"{_PQ_BASE}, {sp.ENC} SELECT vec_id, list_id, CAST(m AS BIGINT) AS m, code FROM enc")
def vec_pq_encode(spark, sf):
    """Residual of every vector encoded to the nearest trained word per 2-d sub-space (broadcast codebook)."""
    st = PQState(spark, sf)
    return st.codes().select("vec_id", "list_id", F.posexplode("code").alias("m", "code")) \
        .select("vec_id", "list_id", F.col("m").cast("bigint").alias("m"), F.col("code").cast("bigint").alias("code"))


@_reg("vec_adc_lut", f"""{_PQ_BASE}, {sp.PROBES}, {sp.QLUT}
SELECT qid, list_id, CAST(m AS BIGINT) AS m, round(min(pd), 6) AS lut_min, round(sum(pd), 6) AS lut_sum,
  arg_min(code, pd) AS lut_argmin FROM qlut GROUP BY qid, list_id, m""")
def vec_adc_lut(spark, sf):
    """Per (query, probed list, sub-space): smallest / total partial distance
    and the closest trained word."""
    st = PQState(spark, sf)
    cb = QZ.codebook_frame(spark, st.codebook)
    lut = QZ.adc_lut(st.probes, st.qs, st.cent, cb, MSUB)
    out = lut.groupBy("qid", "list_id", "m").agg(
        F.min("pd").alias("lut_min"), F.sum("pd").alias("lut_sum"),
        F.min_by("code", F.struct("pd", "code")).cast("bigint").alias("lut_argmin"))
    return out.withColumn("m", F.col("m").cast("bigint")).withColumn("lut_min", round_to("lut_min", 6)) \
        .withColumn("lut_sum", round_to("lut_sum", 6))


@_reg("vec_adc_scan", f"""{_PQ_SEARCH}
SELECT qid, list_id, vec_id, round(dist, 4) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, list_id ORDER BY dist, vec_id) AS rn FROM adc) z WHERE rn <= {fx.TOPK}""")
def vec_adc_scan(spark, sf):
    """ADC scan: the k best codes of every probed list per query."""
    st = PQState(spark, sf)
    return _r4(S.per_list_topk(st.scan(st.probes), fx.TOPK).select("qid", "list_id", "vec_id", "dist"), "dist")


_IVFPQ_SQL = f"{_PQ_SEARCH} {sp.topk('adc')}"


@_reg("vec_ivfpq_search", _IVFPQ_SQL)
def vec_ivfpq_search(spark, sf):
    """Probe -> LUT -> ADC scan of the clustered codes -> final top-k."""
    st = PQState(spark, sf)
    res = V.merge_topk(st.scan(st.probes).drop("list_id"), fx.TOPK)
    return _r4(res.select("qid", "rank", "vec_id", "dist"), "dist")


@_reg("rte_hot_then_cold", _IVFPQ_SQL)
def rte_hot_then_cold(spark, sf):
    """Split search: probes routed to device shards (hot lists) and to the host
    (cold) are scanned separately and merged; equals the unsplit search."""
    from ragspark.operators import hitrate as hr
    from ragspark.operators import placement as pl
    from ragspark.operators import routing as rt
    st = PQState(spark, sf)
    nq = st.vecs.count()
    sizes = pl.list_sizes(st.cent, st.asg)
    hot = hr.half_set(hr.cdf(hr.frequency(st.probes, st.cent), fx.NPROBE * nq))
    lut = pl.full_lut(st.cent, pl.place(hot, sizes, fx.SHARDS), st.nlist)
    routed = snapshot(rt.route(st.probes, lut, st.nlist), "routed")
    hot_c = st.scan(routed.where(F.col("shard") >= 0)).drop("list_id")
    cold_c = st.scan(routed.where(F.col("shard") == -1)).drop("list_id")
    res = rt.hot_then_cold(hot_c, cold_c, fx.TOPK)
    return _r4(res.select("qid", "rank", "vec_id", "dist"), "dist")


@_reg("vec_pq_train", f"""{_PQ_BASE}
SELECT CAST(m AS INTEGER) AS m, code, round(list_sum(word), 6) AS word_sum FROM book""")
def vec_pq_train(spark, sf):
    """Codebook training (16 words per 2-d sub-space, ten steps) on all residuals, from the
    residuals first in hash order; partial sums per (sub-space, word)."""
    cb = QZ.codebook_frame(spark, PQState(spark, sf).codebook)
    return cb.select("m", "code", round_to(F.aggregate("word", F.lit(0.0), lambda a, x: a + x), 6).alias("word_sum"))


# ------------------------------------------------------------ recall
def _recall_row(name: str, cond: str) -> str:
    return f"""SELECT '{name}' AS search, count(*) AS queries, round(avg(nprobe), 4) AS avg_nprobe,
  round(avg(n_found / n_true::DOUBLE), 4) AS recall, min(n_found) AS least_found FROM ({cond}) z"""


def _per_query(found_: str, probes: str) -> str:
    return f"""SELECT t.qid, count(f.vec_id) AS n_found, count(*) AS n_true, any_value(np.nprobe) AS nprobe
  FROM truth t LEFT JOIN {found_} f ON f.qid = t.qid AND f.vec_id = t.vec_id
  JOIN (SELECT qid, count(*) AS nprobe FROM {probes} GROUP BY qid) np ON np.qid = t.qid GROUP BY t.qid"""


@_reg("vec_recall", f"""{_PQ_BASE}, {sp.PROBES}, {sp.ENC}, {sp.QLUT}, {sp.ADC_CAND}, {_POLICY[len('WITH ' + sp.CENT + ', ' + sp.ASG + ', '):]},
{sp.found('probes', 'f_fixed')}, {sp.found('pprobes', 'f_policy')},
f_pq AS (SELECT qid, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rn FROM adc) x
  WHERE rn <= {fx.TOPK})
{_recall_row('flat_fixed', _per_query('f_fixed', 'probes'))} UNION ALL
{_recall_row('flat_policy', _per_query('f_policy', 'pprobes'))} UNION ALL
{_recall_row('pq_fixed', _per_query('f_pq', 'probes'))}""")
def vec_recall(spark, sf):
    """Recall@10 against the exact neighbours and lists probed: fixed and calibrated
    probes on whole vectors, fixed probes on trained codes."""
    st, pq = FlatState(spark, sf), PQState(spark, sf)
    truth = snapshot(V.exact_knn(st.vecs, st.qs, fx.TOPK).select("qid", "vec_id"), "truth")
    fixed, (policy, _) = st.fixed_probes(), policy_probes(st, truth)
    out = None
    for name, probes, found in (("flat_fixed", fixed, st.search(fixed)), ("flat_policy", policy, st.search(policy)),
                                ("pq_fixed", fixed, V.merge_topk(pq.scan(fixed).drop("list_id"), fx.TOPK))):
        n = probes.groupBy("qid").agg(F.count(F.lit(1)).alias("nprobe"))
        row = PR.recall(found, truth).join(n, "qid").agg(
            F.count(F.lit(1)).alias("queries"), F.avg("nprobe").alias("avg_nprobe"), F.avg("recall").alias("recall"),
            F.min("n_found").alias("least_found")).select(F.lit(name).alias("search"), "*")
        out = row if out is None else out.unionByName(row)
    return _r4(out, "avg_nprobe", "recall")


@_reg("vec_graph_probe")
def vec_graph_probe(spark, sf):
    """Lists per query by beam search in the layered centroid graph, and how many of
    the exact nearest lists they hold (no SQL: the walk is tested against exact probes)."""
    from ragspark.operators import graph as G
    vecs, qs = fx.vectors(spark, sf), fx.queries(spark, sf)
    cent = snapshot(fx.fixed_centroids(vecs), "centroids")
    got = snapshot(G.probe(qs, cent, G.build(cent), fx.NPROBE), "graph-probes")
    exact = V.nearest(qs, cent, fx.NPROBE, base_id="qid", base_vec="embedding", ref_id="list_id", ref_vec="centroid",
                      out_base="qid", out_ref="list_id")
    hit = exact.select("qid", "list_id", F.lit(1).alias("_hit"))
    return _r4(got.join(hit, ["qid", "list_id"], "left").select(
        "qid", "probe_rank", "list_id", "cdist", (F.coalesce("_hit", F.lit(0)) == 1).alias("exact")), "cdist")
