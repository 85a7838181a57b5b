"""DuckDB SQL fragments for the oracle: the same role bindings as
``ragspark.plans.fixtures``, written independently as plain SQL."""

from __future__ import annotations

NPROBE = 4
TOPK = 10


def h(col: str) -> str:
    return f"('0x'||substr(md5(CAST({col} AS VARCHAR)),1,8))::BIGINT"


def l2(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a})+1), lambda i: "
            f"({a}[i]::DOUBLE - {b}[i]::DOUBLE)*({a}[i]::DOUBLE - {b}[i]::DOUBLE)))")


CENT = f"""cent AS (
  SELECT list_id, embedding AS centroid FROM (
    SELECT embedding, CAST(row_number() OVER (ORDER BY {h('vec_id')}, vec_id) - 1 AS BIGINT) AS list_id
    FROM embeddings) t
  WHERE list_id < (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM embeddings))"""

ASG = f"""asg AS (
  SELECT vec_id, list_id, dist FROM (
    SELECT vec_id, list_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, list_id) AS rn
    FROM (SELECT e.vec_id, c.list_id, {l2('e.embedding', 'c.centroid')} AS dist FROM embeddings e, cent c) x) y
  WHERE rn = 1)"""

PROBES = f"""probes AS (
  SELECT qid, CAST(rn - 1 AS BIGINT) AS probe_rank, list_id, cdist FROM (
    SELECT qid, list_id, cdist, row_number() OVER (PARTITION BY qid ORDER BY cdist, list_id) AS rn
    FROM (SELECT e.vec_id AS qid, c.list_id, {l2('e.embedding', 'c.centroid')} AS cdist FROM embeddings e, cent c) x) y
  WHERE rn <= {NPROBE})"""

# IVF-flat: exact distances of each query to the members of its probed lists
FLAT_CAND = f"""cand AS (
  SELECT p.qid, a.vec_id, {l2('q.embedding', 'v.embedding')} AS dist
  FROM probes p JOIN asg a ON a.list_id = p.list_id
  JOIN embeddings q ON q.vec_id = p.qid JOIN embeddings v ON v.vec_id = a.vec_id)"""


def topk(src: str, k: int = TOPK) -> str:
    return f"""SELECT qid, CAST(rn - 1 AS BIGINT) AS rank, vec_id, round(dist, 4) AS dist FROM (
  SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rn FROM {src}) z
WHERE rn <= {k}"""


# request log (FIXTURES section 3)
def requests_cte(batch_seconds: int = 3600) -> str:
    return f"""ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS rid,
         (epoch_us(ts) - 1704067200000000) / 1e6 AS arrival
  FROM events),
evb AS (
  SELECT *, CAST(floor(arrival / {float(batch_seconds)}) AS BIGINT) AS batch_id FROM ev),
pb AS (
  SELECT batch_id, CAST(count(*) AS INTEGER) AS batch_size, max(arrival) AS last_arrival FROM evb GROUP BY batch_id),
r0 AS (
  SELECT evb.*, pb.batch_size, pb.last_arrival,
         pb.last_arrival + (evb.batch_id % 7) / 100.0::DOUBLE AS start
  FROM evb JOIN pb USING (batch_id)),
r1 AS (SELECT *, start + 0.05::DOUBLE + value / 1000.0::DOUBLE AS callback FROM r0),
r2 AS (SELECT *, callback + (event_id % 13) / 1000.0::DOUBLE AS submit FROM r1),
r3 AS (SELECT *, submit + 0.1::DOUBLE + (user_id % 10) / 100.0::DOUBLE AS first_token FROM r2),
req AS (
  SELECT *, first_token + 1.0::DOUBLE + (event_id % 29) / 10.0::DOUBLE AS done,
         (event_id % 5) / 4.0::DOUBLE AS hit_rate, event_type AS mode,
         CAST((user_id % 5) * 8 + 8 AS INTEGER) AS rate,
         CAST(8 - (user_id % 3) * 2 AS INTEGER) AS ngpu,
         (event_id % 2) = 0 AS dispatcher,
         CAST(CASE WHEN user_id % 4 = 0 THEN 512 WHEN user_id % 4 = 3 THEN 2048 ELSE 1024 END AS INTEGER) AS input_len,
         CAST(CASE WHEN event_id % 3 = 0 THEN 128 WHEN event_id % 3 = 1 THEN 256 ELSE 512 END AS INTEGER) AS output_len,
         CAST(100 + (event_id % 4) * 50 AS INTEGER) AS slo_ms,
         CAST(floor(arrival / 86400.0::DOUBLE) AS BIGINT) AS run_day,
         [1.0::DOUBLE * value / 100000.0::DOUBLE, 2.0::DOUBLE * value / 100000.0::DOUBLE,
          3.0::DOUBLE * value / 100000.0::DOUBLE, 4.0::DOUBLE * value / 100000.0::DOUBLE,
          5.0::DOUBLE * value / 100000.0::DOUBLE, 6.0::DOUBLE * value / 100000.0::DOUBLE] AS breakdown
  FROM r3)"""


def stages_cte(batch_seconds: int = 3600, completed_only: bool = False, keep_unmatched: bool = False) -> str:
    """requests_cte + idle + stage columns -> CTE ``st`` (one row per request)."""
    gen_filter = "WHERE done <= (SELECT max(arrival) FROM req)" if completed_only else ""
    return requests_cte(batch_seconds) + f""",
bt AS (SELECT batch_id, min(start) AS b_start, max(callback) AS b_done FROM req GROUP BY batch_id),
bidle AS (SELECT batch_id, b_start - lag(b_done) OVER (ORDER BY batch_id) AS ann_idle FROM bt),
gen AS (SELECT rid, callback AS g_callback, submit AS g_submit, first_token AS g_first, done AS g_done FROM req {gen_filter}),
st AS (
  SELECT r.rid, r.batch_id, r.batch_size, r.mode, r.rate, r.ngpu, r.dispatcher, r.input_len, r.output_len,
         r.slo_ms, r.run_day, r.arrival, r.last_arrival, r.start, r.hit_rate, r.breakdown, bi.ann_idle,
         g.g_callback AS callback, g.g_submit AS submit, g.g_first AS first_token, g.g_done AS done,
         r.last_arrival - r.arrival AS ann_batch,
         r.start - r.last_arrival AS ann_pending,
         r.start - r.arrival AS ann_queue,
         g.g_callback - r.start AS ann_search,
         g.g_submit - g.g_callback AS llm_queue,
         g.g_first - g.g_submit AS prefill,
         g.g_done - g.g_first AS generate,
         (r.start - r.arrival) + (g.g_callback - r.start) + (g.g_submit - g.g_callback) + (g.g_first - g.g_submit) AS ttft,
         g.g_done - r.arrival AS e2e,
         (g.g_callback - r.start) + (r.start - r.arrival) AS ann_e2e,
         r.breakdown[1] AS quantize, r.breakdown[2] + r.breakdown[3] AS lut_compute,
         r.breakdown[4] + r.breakdown[5] + r.breakdown[6] AS lut_scan,
         (g.g_done - g.g_first) / CAST(r.output_len AS DOUBLE) AS tpot
  FROM req r {'LEFT ' if keep_unmatched else ''}JOIN gen g ON g.rid = r.rid LEFT JOIN bidle bi ON bi.batch_id = r.batch_id)"""


SHARDS = 3

SIZES = """sizes AS (SELECT c.list_id, count(a.vec_id) AS n FROM cent c LEFT JOIN asg a ON a.list_id = c.list_id GROUP BY c.list_id)"""
FREQ = """freq AS (SELECT c.list_id, count(p.qid) AS freq FROM cent c LEFT JOIN probes p ON p.list_id = c.list_id GROUP BY c.list_id)"""
CDF = f"""cdf AS (
  SELECT list_id, freq, hot_rank,
         sum(freq) OVER (ORDER BY hot_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           / CAST({NPROBE} * (SELECT count(*) FROM embeddings) AS DOUBLE) AS cdf
  FROM (SELECT list_id, freq, CAST(row_number() OVER (ORDER BY freq DESC, list_id) - 1 AS BIGINT) AS hot_rank FROM freq) h)"""
HALF = """half AS (SELECT list_id, freq, hot_rank, cdf FROM cdf WHERE hot_rank < (SELECT min(hot_rank) FROM cdf WHERE cdf >= 0.5))"""
PLACE = f"""place AS (
  SELECT list_id, n, rn % {SHARDS} AS shard, CAST(floor(rn / {SHARDS}) AS BIGINT) AS local_id FROM (
    SELECT h.list_id, s.n, CAST(row_number() OVER (ORDER BY s.n, h.list_id) - 1 AS BIGINT) AS rn
    FROM half h JOIN sizes s ON s.list_id = h.list_id) x)"""
LUT = """lut AS (SELECT c.list_id, coalesce(p.shard, -1) AS shard, coalesce(p.local_id, c.list_id) AS local_id
  FROM cent c LEFT JOIN place p ON p.list_id = c.list_id)"""
ROUTED = """routed AS (
  SELECT p.qid, p.probe_rank, p.list_id, l.shard, l.local_id,
         CAST(row_number() OVER (PARTITION BY p.qid, l.shard ORDER BY p.probe_rank) - 1 AS BIGINT) AS pos
  FROM probes p JOIN lut l ON l.list_id = p.list_id)"""


def index_ctes(*names: str) -> str:
    parts = {"cent": CENT, "asg": ASG, "probes": PROBES, "sizes": SIZES, "freq": FREQ, "cdf": CDF,
             "half": HALF, "place": PLACE, "lut": LUT, "routed": ROUTED}
    return "WITH " + ", ".join(parts[n] for n in names)


INDEX_ALL = ("cent", "asg", "probes", "sizes", "freq", "cdf", "half", "place", "lut", "routed")


def asg_for(cent_name: str, out: str) -> str:
    """Nearest-centroid assignment of every vector against CTE ``cent_name``."""
    return f"""{out} AS MATERIALIZED (
  SELECT vec_id, list_id, dist FROM (
    SELECT vec_id, list_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, list_id) AS rn
    FROM (SELECT e.vec_id, c.list_id, {l2('e.embedding', 'c.centroid')} AS dist FROM embeddings e, {cent_name} c) x) y
  WHERE rn = 1)"""


def lloyd_update(asg_name: str, cent_name: str, out: str) -> str:
    """Mean of the members per list and dimension; empty lists keep their centroid."""
    return f"""{out}_ex AS (
  SELECT a.list_id, unnest(range(1, len(e.embedding) + 1)) AS i, e.embedding AS emb
  FROM {asg_name} a JOIN embeddings e ON e.vec_id = a.vec_id),
{out}_m AS (SELECT list_id, i, avg(emb[i]::DOUBLE) AS x FROM {out}_ex GROUP BY list_id, i),
{out}_l AS (SELECT list_id, list(x ORDER BY i) AS mean FROM {out}_m GROUP BY list_id),
{out} AS MATERIALIZED (SELECT c.list_id, coalesce(l.mean, list_transform(c.centroid, lambda v: v::DOUBLE)) AS centroid
  FROM {cent_name} c LEFT JOIN {out}_l l ON l.list_id = c.list_id)"""


def lloyd(steps: int) -> str:
    """``steps`` Lloyd steps from ``cent``: assignments a1.., centroids c1..; step i
    assigns to the centroids of step i - 1."""
    return ", ".join(f"{asg_for('cent' if i == 1 else f'c{i - 1}', f'a{i}')}, "
                     f"{lloyd_update(f'a{i}', 'cent' if i == 1 else f'c{i - 1}', f'c{i}')}" for i in range(1, steps + 1))


# PQ fixture: the 16 vectors right after the centroids in hash order, as
# residuals to their list centroid, are the words of every sub-space.
RES = """res AS (
  SELECT a.vec_id, a.list_id, list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i] - c.centroid[i]) AS res
  FROM asg a JOIN embeddings e ON e.vec_id = a.vec_id JOIN cent c ON c.list_id = a.list_id)"""
WORDS = f"""words AS (
  SELECT CAST(hr.r - nl.nlist AS BIGINT) AS j, r2.res AS wres FROM (
    SELECT vec_id, row_number() OVER (ORDER BY {h('vec_id')}, vec_id) - 1 AS r FROM embeddings) hr,
    (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS nlist FROM embeddings) nl, res r2
  WHERE r2.vec_id = hr.vec_id AND hr.r >= nl.nlist AND hr.r < nl.nlist + 16)"""


def pq_step(i: int) -> str:
    """CTE(s) of codebook training step i: sub-vectors to their nearest word of
    ``pw{i}``, means to ``pw{i + 1}`` (words without members stay)."""
    first = """subs AS MATERIALIZED (SELECT r.vec_id, r.list_id, t.m, r.res[2 * t.m + 1]::DOUBLE AS a, r.res[2 * t.m + 2]::DOUBLE AS b
  FROM res r, range(0, CAST(len(r.res) / 2 AS BIGINT)) t(m)),
pw0 AS MATERIALIZED (SELECT t.m, w.j AS code, [w.wres[2 * t.m + 1]::DOUBLE, w.wres[2 * t.m + 2]::DOUBLE] AS word
  FROM words w, range(0, CAST(len(w.wres) / 2 AS BIGINT)) t(m)),
""" if i == 0 else ""
    return first + f"""pa{i} AS (SELECT m, code, avg(a) AS a, avg(b) AS b FROM (
  SELECT s.m, s.a, s.b, w.code, row_number() OVER (PARTITION BY s.vec_id, s.m ORDER BY
    (s.a - w.word[1]) * (s.a - w.word[1]) + (s.b - w.word[2]) * (s.b - w.word[2]), w.code) AS rn
  FROM subs s JOIN pw{i} w ON w.m = s.m) x WHERE rn = 1 GROUP BY m, code),
pw{i + 1} AS MATERIALIZED (SELECT w.m, w.code, CASE WHEN p.m IS NULL THEN w.word ELSE [p.a, p.b] END AS word
  FROM pw{i} w LEFT JOIN pa{i} p ON p.m = w.m AND p.code = w.code)"""


PQ_STEPS = 10
# the codebook: ten training steps from the words above
BOOK = ", ".join(pq_step(i) for i in range(PQ_STEPS)) + f""",
book AS MATERIALIZED (SELECT m, code, word FROM pw{PQ_STEPS})"""
ENC = """enc AS MATERIALIZED (
  SELECT vec_id, list_id, m, code FROM (
    SELECT s.vec_id, s.list_id, s.m, w.code,
      row_number() OVER (PARTITION BY s.vec_id, s.m ORDER BY
        (s.a - w.word[1]) * (s.a - w.word[1]) + (s.b - w.word[2]) * (s.b - w.word[2]), w.code) AS rn
    FROM subs s JOIN book w ON w.m = s.m) x
  WHERE rn = 1)"""
QLUT = """qlut AS MATERIALIZED (
  SELECT q.qid, q.list_id, w.m, w.code,
    (q.qr[2 * w.m + 1]::DOUBLE - w.word[1]) * (q.qr[2 * w.m + 1]::DOUBLE - w.word[1])
    + (q.qr[2 * w.m + 2]::DOUBLE - w.word[2]) * (q.qr[2 * w.m + 2]::DOUBLE - w.word[2]) AS pd
  FROM (SELECT p.qid, p.list_id, list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i] - c.centroid[i]) AS qr
        FROM probes p JOIN embeddings e ON e.vec_id = p.qid JOIN cent c ON c.list_id = p.list_id) q, book w)"""
ADC_CAND = """adc AS (
  SELECT l.qid, l.list_id, e.vec_id, sum(l.pd) AS dist
  FROM qlut l JOIN enc e ON e.list_id = l.list_id AND e.m = l.m AND e.code = l.code
  GROUP BY l.qid, l.list_id, e.vec_id)"""

# probe policy: gap classes, the reach of each, the lists within it
TRUE_KNN = f"""truth AS MATERIALIZED (
  SELECT qid, vec_id FROM (
    SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rn
    FROM (SELECT q.vec_id AS qid, v.vec_id, {l2('q.embedding', 'v.embedding')} AS dist FROM embeddings q, embeddings v) x) y
  WHERE rn <= {TOPK})"""


def policy(target: float, classes: tuple, calibration: str) -> str:
    case = " ".join(f"WHEN gap < {t} THEN {i}" for i, t in enumerate(classes))
    return f"""cdists AS MATERIALIZED (
  SELECT e.vec_id AS qid, c.list_id, {l2('e.embedding', 'c.centroid')} AS cdist FROM embeddings e, cent c),
two AS (SELECT qid, sqrt(min(cdist)) AS first, sqrt(max(cdist)) AS second FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cdist, list_id) AS rn FROM cdists) x WHERE rn <= 2 GROUP BY qid),
near AS MATERIALIZED (SELECT qid, first, CASE {case} ELSE {len(classes)} END AS gap_class
  FROM (SELECT *, (second - first) / greatest(first, 1e-12) AS gap FROM two) x),
need AS (SELECT n.gap_class, sqrt(d.cdist) - n.first AS gap
  FROM truth t JOIN asg a ON a.vec_id = t.vec_id JOIN cdists d ON d.qid = t.qid AND d.list_id = a.list_id
  JOIN near n ON n.qid = t.qid WHERE {calibration}),
reach AS (SELECT gap_class, gap AS reach, n FROM (
  SELECT *, row_number() OVER (PARTITION BY gap_class ORDER BY gap) AS rn, count(*) OVER (PARTITION BY gap_class) AS n FROM need) x
  WHERE rn = greatest(ceil(n * {target}::DOUBLE), 1)),
pprobes AS MATERIALIZED (SELECT d.qid, d.list_id, d.cdist
  FROM cdists d JOIN near n ON n.qid = d.qid LEFT JOIN reach r ON r.gap_class = n.gap_class
  WHERE sqrt(d.cdist) <= n.first + coalesce(r.reach, (SELECT max(reach) FROM reach)) + 1e-9)"""


def found(probes: str, out: str) -> str:
    """(qid, vec_id): the best members of the probed lists by exact distance."""
    return f"""{out} AS (
  SELECT qid, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rn FROM (
    SELECT p.qid, a.vec_id, {l2('q.embedding', 'v.embedding')} AS dist
    FROM {probes} p JOIN asg a ON a.list_id = p.list_id
    JOIN embeddings q ON q.vec_id = p.qid JOIN embeddings v ON v.vec_id = a.vec_id) x) y WHERE rn <= {TOPK})"""
