"""Near-duplicates by DartMinHash: signatures, banded joining, verified links.

A text is a weighted set of hashed five-word shingles.  Each shingle owns a
region as wide as its weight and endless in time; darts fall on all regions at
rate one, at places that are a hash of (shingle, unit strip, unit of time), so
they are the same in every text.  A dart names one of ``K`` coordinates; the
earliest dart on a coordinate that lands inside the text's regions is the
coordinate's value.  Two texts agree on a coordinate with their weighted
Jaccard similarity as probability, and a text needs only about K ln K darts,
however many shingles it has.

Grouping:

1. Texts of equal shingle sets form a class; only its least id goes on.
2. ``BANDS`` keys per class, of ``K / BANDS`` coordinates each.  In each bucket
   of a key, one member in an order seeded by the key is the hub; the others
   are linked to it (a star, never all pairs).
3. A pair is checked by its signatures: at ``SURE`` or more it is linked, below
   ``NEVER`` it is not (both over four standard errors from 0.8), in between
   it is settled by the exact sets, unless the two are connected already.
4. Buckets that still hold more than one component are searched whole, in
   cells of at most about ``CELL`` x ``CELL`` members, for links between
   components; a cell checks pairs the same way and sends on a spanning forest.
   So every pair that shares a bucket is settled or already connected, and none
   is lost to the choice of hubs.

Components are found by joins with contraction; links, components and
fingerprints stay on the executors.

Defined cases: words are lower case, cut at white space; the registered query
weighs each distinct shingle 1; a text of fewer than five words is one shingle
of all its words; null texts and texts without words are like nothing, each
its own class; rows of one id are one document; a row of a null id is searched
like any other under a number of its text's own beyond all ids (ids lie below
2^62), so it joins the class of its near copies, whose id is the least one there
is (null if there is none); ``keep_one`` leaves one row of a group without ids,
and one of the rows that repeat an id and a text; an empty table gives an empty
table; other columns are ignored; very long texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranks import snapshot
from ragspark.functions.sizing import fits
from ragspark.llm.common import lean

K, BANDS = 192, 32        # 6 coordinates a band: at 0.8, all bands miss with probability 6e-5
LEAST = 0.8
SURE, NEVER = 0.93, 0.65
CELL = 256
SHINGLE = 5
SEED = 29
_BROADCAST = 64 << 20     # bytes of ids that may be broadcast; beyond that, a shuffled join
_MEMO = 300_000

_U = np.uint64
_A, _B, _C, _D = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply)."""
    x = (x ^ (x >> _U(32))) * _D
    x = (x ^ (x >> _U(32))) * _D
    return x ^ (x >> _U(32))


def _poisson_steps() -> np.ndarray:
    """Cumulative probabilities of Poisson(1) as 64-bit thresholds."""
    p, total, out = np.exp(-1.0), 0.0, []
    for i in range(1, 20):
        total += p
        out.append(min(total, 1 - 2.0 ** -53))
        p /= i
    return (np.array(out) * 2.0 ** 64).astype(_U)


_STEPS = _poisson_steps()


def shingles(words: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a sequence of word hashes, and their counts."""
    n = len(words)
    if n == 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    many = max(1, n - width + 1)
    h = np.full(many, _U(min(n, width)))
    for j in range(min(n, width)):
        h = (h ^ words[j:j + many]) * _A
        h ^= h >> _U(29)
    return np.unique(_mix(h), return_counts=True)


def signature(items: np.ndarray, weights: np.ndarray, k: int = K, seed: int = SEED) -> np.ndarray:
    """Time of the earliest dart on each of k coordinates (uint64); weights > 0."""
    strips = np.ceil(weights).astype(np.int64)
    base, width = items, weights
    if (strips > 1).any() or (weights != strips).any():
        at = np.repeat(np.arange(len(items)), strips)
        no = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
        base, width = items[at] + no.astype(_U) * _B, np.minimum(1.0, weights[at] - no)
    base = _mix(base ^ _mix(np.array([seed], _U)))
    partial = (width < 1).any()
    out = np.full(k, _NONE)
    start, span = 0, max(1, int(np.ceil(k * (np.log(k) + 3) / len(base))))
    while True:
        # a cell is one strip during one unit of time: Poisson(1) darts
        time = np.arange(start, start + span, dtype=np.int64).astype(_U)
        cells = _mix(base[None, :] + (time * _C)[:, None])
        count = np.searchsorted(_STEPS, cells.ravel(), side="right")
        hit = np.nonzero(count)[0]
        cell = np.repeat(hit, count[hit])
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        dart = _mix(cells.ravel()[cell] + (nth + 1).astype(_U) * _A)
        row = cell // len(base)
        if partial:
            inside = (_mix(dart) >> _U(11)).astype(float) * 2.0 ** -53 < width[cell - row * len(base)]
            dart, row = dart[inside], row[inside]
        coordinate = ((dart & _U(0xFFFFFFFF)) * _U(k)) >> _U(32)
        np.minimum.at(out, coordinate.astype(np.int64), (time[row] << _U(32)) | (dart >> _U(32)))
        if (out != _NONE).all():
            return out
        start, span = start + span, start + span


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    h = np.arange(1, bands + 1).astype(_U) * _B
    for j in range(rows.shape[1]):
        h = _mix((h ^ rows[:, j]) * _A + _C)
    return h.view(np.int64)


class _Words:
    """64-bit hashes of words, remembered per task."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo = self.memo
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8"))
        return np.fromiter(map(memo.__getitem__, words), _U, len(words))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighting: str = "set") -> DataFrame:
    """(id, same, sig, keys): ``same`` is 16 bytes equal for equal shingle sets
    (null without words), ``sig`` the signature in 2 bytes per coordinate.
    ``weighting``: "set" (each distinct shingle 1) or "count" (its occurrences)."""
    @lean
    def run(batches):
        hashed = _Words()
        for b in batches:
            same, sig, keys = [], [], []
            for text in b.column(1).to_pylist():
                items, count = shingles(hashed(text))
                if not len(items):
                    same.append(None), sig.append(None), keys.append([])
                    continue
                weight = count.astype(float) if weighting == "count" else np.ones(len(items))
                s = signature(items, weight)
                marks = items if weighting == "set" else items + count.astype(_U) * _C
                both = np.array([_mix(marks ^ _B).sum(), _mix(marks ^ _C).sum()], _U)
                same.append(both.tobytes())
                sig.append((_mix(s + np.arange(len(s)).astype(_U) * _A) >> _U(48)).astype("<u2").tobytes())
                keys.append(band_keys(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(same, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "same", "sig", "keys"])
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "id bigint, same binary, sig binary, keys array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of an edge list (a, b).

    Each round hooks every node to its least neighbour, follows the hooks two
    more steps and contracts the edges; each round's tables are written."""
    spark = edges.sparkSession
    edges = snapshot(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select("b", "a")).groupBy("n").agg(
            F.min("m").alias("m")).select("n", F.least("n", "m").alias("p"))
        hook = snapshot(ends, "cc")
        for _ in range(2):
            up = hook.select(F.col("n").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p").select("n", F.col("q").alias("p"))
        hook = snapshot(hook, "cc")
        if labels is None:
            labels = hook
        else:
            step = hook.select(F.col("n").alias("p"), F.col("p").alias("q"))
            fresh = hook.join(labels.select("n"), "n", "left_anti")
            labels = snapshot(labels.join(step, "p", "left").select("n", F.coalesce("q", "p").alias("p")).unionByName(fresh), "cc")
        a, b = hook.select(F.col("n").alias("a"), F.col("p").alias("x")), hook.select(F.col("n").alias("b"), F.col("p").alias("y"))
        edges = snapshot(edges.join(a, "a").join(b, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc")
    if labels is None:
        return spark.createDataFrame([], "node bigint, label bigint")
    return labels.select(F.col("n").alias("node"), F.col("p").alias("label"))


def _agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, near): share of equal signature coordinates of each pair."""
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    @lean
    def run(batches):
        for t in batches:
            sa, sb = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u2").reshape(t.num_rows, -1) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array((sa == sb).mean(1))], names=["a", "b", "near"])
    return both.mapInArrow(lambda it: run(t for t in it if t.num_rows), "a bigint, b bigint, near double")


def _common(x: np.ndarray, wx: np.ndarray, many: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Weight that one sorted set has in common with each of several non-empty sets."""
    y, wy = np.concatenate(many), np.concatenate(weights)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    size = np.array([len(z) for z in many])
    return np.add.reduceat(np.where(x[at] == y, np.minimum(wx[at], wy), 0), np.cumsum(size) - size)


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, weighting: str) -> DataFrame:
    """(i, x, w): sorted shingle hashes and weights of the texts of some ids (i).
    Ids are broadcast if they are few enough (counted first), else joined."""
    ids = snapshot(ids.distinct(), "exact-ids")
    texts = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    small = fits(ids.sparkSession, ids.count(), 16, _BROADCAST)
    texts = texts.join(F.broadcast(ids) if small else ids, "i", "left_semi")

    @lean
    def run(batches):
        hashed = _Words()
        for b in batches:
            got = [shingles(hashed(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.tobytes() for x, _ in got], pa.binary()),
                 pa.array([(c if weighting == "count" else np.ones_like(c)).astype("<i4").tobytes() for _, c in got], pa.binary())],
                names=["i", "x", "w"])
    return snapshot(texts.mapInArrow(run, "i bigint, x binary, w binary").where(F.octet_length("x") > 0), "exact-sets")


def _exact(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, weighting: str, least: float) -> DataFrame:
    """The pairs whose exact (weighted) Jaccard similarity is ``least`` or more."""
    own = _sets(pairs.select(F.col("a").alias("i")).union(pairs.select("b")), docs, id_col, text_col, weighting)
    both = pairs.select("a", "b").join(own.toDF("a", "xa", "wa"), "a").join(own.toDF("b", "xb", "wb"), "b").select(
        "a", "b", "xa", "wa", "xb", "wb")

    @lean
    def keep(batches):
        for t in batches:
            ok = []
            for xa, wa, xb, wb in zip(*(t.column(c).to_pylist() for c in range(2, 6))):
                wa, wb = np.frombuffer(wa, "<i4"), np.frombuffer(wb, "<i4")
                common = float(_common(np.frombuffer(xa, _U), wa, [np.frombuffer(xb, _U)], [wb])[0])
                ok.append(common >= least * (float(wa.sum() + wb.sum()) - common) - 1e-9)
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return both.mapInArrow(lambda it: keep(t for t in it if t.num_rows), "a bigint, b bigint").distinct()


def _labelled(rows: DataFrame, col: str, labels: DataFrame, out: str) -> DataFrame:
    """Adds the component of ``col`` (itself if it has no link)."""
    at = labels.select(F.col("node").alias(col), F.col("label").alias("_label"))
    return rows.join(at, col, "left").withColumn(out, F.coalesce("_label", col)).drop("_label")


def _settle(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, id_col: str, text_col: str, weighting: str,
            least: float) -> DataFrame:
    """Components (node, label) of the pairs that are similar."""
    near = snapshot(_agreement(pairs, sigs).where(F.col("near") >= NEVER), "near")
    labels = components(near.where(F.col("near") >= SURE).select("a", "b"))
    open_ = _labelled(_labelled(near.where(F.col("near") < SURE).select("a", "b"), "a", labels, "la"), "b", labels, "lb")
    open_ = snapshot(open_.where("la <> lb").select("a", "b"), "near-open")
    return _joined(snapshot(_exact(open_, docs, id_col, text_col, weighting, least), "near-links"), labels)


def _joined(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Components after adding links to those of ``labels``."""
    if links.isEmpty():
        return labels
    return components(links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def _cell_kernel(least: float):
    def run(t: pa.Table) -> pa.Table:
        """Links that join components of the cell's members: a spanning forest at
        most, so a cell sends on fewer rows than it has members."""
        t = t.combine_chunks()
        ids, comp = t.column("id").to_numpy(), t.column("label").to_numpy().copy()
        left = t.column("left").to_numpy(zero_copy_only=False).astype(bool)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(len(ids), -1)
        x = [np.frombuffer(v, _U) for v in t.column("x").to_pylist()]
        w = [np.frombuffer(v, "<i4") for v in t.column("w").to_pylist()]
        total = np.array([float(v.sum()) for v in w])
        own = t.column("kind")[0].as_py() == 1 and t.column("i")[0].as_py() == t.column("j")[0].as_py()
        p = np.nonzero(left)[0]
        q = p if own else np.nonzero(~left)[0]
        a, b = [], []
        for i in p:
            near = (sig[q] == sig[i]).mean(1)
            for certain in (True, False):
                some = q[(comp[q] != comp[i]) & (near >= SURE if certain else (near >= NEVER) & (near < SURE))]
                if len(some) and not certain:
                    common = _common(x[i], w[i], [x[j] for j in some], [w[j] for j in some])
                    some = some[common >= least * (total[i] + total[some] - common) - 1e-9]
                for j in some:
                    if comp[j] != comp[i]:
                        a.append(ids[i])
                        b.append(ids[j])
                        comp[comp == comp[j]] = comp[i]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
    return run


def _cells(members: DataFrame, sigs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between different components within the buckets of
    ``members`` (key, id, label, head): cells of blocks, compared by signatures
    and exact sets.  Members of the hub's component are not compared with each other."""
    m = members.withColumn("minor", F.col("label") != F.col("head"))
    size = m.groupBy("key").agg(F.sum(F.col("minor").cast("int")).alias("n_minor"), F.count(F.lit(1)).alias("n"))
    m = m.join(size.select("key", F.ceil((F.col("n") - F.col("n_minor")) / CELL).cast("int").alias("nb"),
                           F.ceil(F.col("n_minor") / CELL).cast("int").alias("mb")), "key")
    mine = F.when(F.col("minor"), F.col("mb")).otherwise(F.col("nb"))
    m = m.withColumn("blk", F.pmod(F.xxhash64("id", "key"), F.greatest(mine, F.lit(1))).cast("int"))

    def cell(kind, i, j, left):
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("left"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    blk = F.col("blk")
    major = F.transform(upto(F.col("mb")), lambda j: cell(0, blk, j, True))
    minor = F.concat(F.transform(upto(F.col("nb")), lambda i: cell(0, i, blk, False)),
                     F.transform(F.sequence(blk, F.col("mb") - 1), lambda j: cell(1, blk, j, True)),
                     F.transform(F.filter(upto(blk), lambda i: i < blk), lambda i: cell(1, i, blk, False)))
    m = m.select("key", "id", "label", F.explode(F.when(F.col("minor"), minor).otherwise(major)).alias("c"))
    m = m.select("key", "id", "label", "c.*").join(sigs.select("id", "sig"), "id").join(
        sets.groupBy("i").agg(F.min(F.struct("x", "w")).alias("s")).select(F.col("i").alias("id"), "s.x", "s.w"), "id")
    return m.groupBy("key", "kind", "i", "j").applyInArrow(_cell_kernel(least), "a bigint, b bigint").distinct()


_NO_ID = 1 << 62          # numbers from here on stand for texts of null ids


def _numbered(id_col: str, text_col: str) -> Column:
    """The row's id; for a null id a number that its text chooses."""
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID) + F.pmod(own, F.lit(1 << 61)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST,
            weighting: str = "set") -> DataFrame:
    """(id, class_id): one row per input row; ``class_id`` is the least id of
    the row's group of near-duplicates (its own id if it has none)."""
    rows = docs.select(_numbered(id_col, text_col).alias(id_col), F.col(text_col).cast("string").alias(text_col))
    out = _classes(rows, id_col, text_col, least, weighting)
    return out.select(*[F.when(F.col(c) < _NO_ID, F.col(c)).alias(c) for c in (id_col, "class_id")])


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float, weighting: str) -> DataFrame:
    """``classes`` of rows that all have ids."""
    if not NEVER < least < SURE:
        raise ValueError(f"the similarity must lie between {NEVER} and {SURE}")
    sigs = snapshot(signatures(docs, id_col, text_col, weighting), "dart-sigs")
    heads = snapshot(sigs.where("same is not null").groupBy("same").agg(F.min("id").alias("head")), "dart-heads")
    reps = sigs.join(heads, "same").where(F.col("id") == F.col("head"))
    reps = snapshot(reps.select("id", "sig", "keys"), "dart-reps")
    keys = reps.select("id", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "key"), "id")).alias("hub"))
    hubs = hubs.where("n > 1").select("key", "n", F.col("hub.id").alias("hub"))
    members = snapshot(keys.join(hubs, "key"), "dart-buckets")
    stars = members.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    labels = snapshot(_settle(stars, reps, docs, id_col, text_col, weighting, least), "dart-labels")
    # buckets that still hold more than one component (two members: settled by their star)
    part = _labelled(members.where("n > 2"), "id", labels, "label")
    split = part.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = snapshot(_labelled(part.join(split, "key").select("key", "id", "label", "hub"), "hub", labels, "head"), "dart-split")
    sets = _sets(rest.select(F.col("id").alias("i")), docs, id_col, text_col, weighting)
    labels = _joined(snapshot(_cells(rest, reps, sets, least), "dart-cells"), labels)
    heads = _labelled(heads, "head", labels, "class_id").select("same", "class_id")
    out = sigs.select("id", "same").join(heads, "same", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The input rows (all columns) without the near-duplicates of a lesser id
    and without repeated rows."""
    spark = docs.sparkSession
    rows = docs.select(_numbered(id_col, text_col).alias(id_col), F.col(text_col).cast("string").alias(text_col))
    drop = snapshot(_classes(rows, id_col, text_col, least, "set").where(F.col(id_col) != F.col("class_id")).select(
        F.col(id_col).alias("_drop")).distinct(), "dart-drop")
    small = fits(spark, drop.count(), 16, _BROADCAST)
    kept = docs.withColumn("_number", _numbered(id_col, text_col)).withColumn("_hash", F.xxhash64(F.col(text_col).cast("string")))
    kept = kept.join(F.broadcast(drop) if small else drop, F.col("_number") == F.col("_drop"), "left_anti")
    worded = F.coalesce(F.col(text_col).cast("string").rlike(r"\S"), F.lit(False))
    again = snapshot(kept.where(worded).groupBy("_number", "_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                     .select("_number", "_hash"), "dart-again")
    if not again.isEmpty():                  # only the rows that repeat a row are regrouped
        one = kept.join(again, ["_number", "_hash"], "left_semi").dropDuplicates(["_number", "_hash"])
        kept = kept.join(again, ["_number", "_hash"], "left_anti").unionByName(one)
    return kept.select(*docs.columns)
