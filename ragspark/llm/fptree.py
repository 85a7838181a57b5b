"""Ranked lexical search by branch and bound over document FP-trees.

Documents are restricted to the terms that some item asks for.  Each task
sorts its restricted vectors by their terms, commonest term of the corpus
first, so that documents share trie paths from the root.  A node keeps, over
the documents below it, the greatest tf of every term and the least length
factor m; a score grows with tf and falls with m, so these bound every
document below the node.  Per item the trie is searched depth first, best
child first: a child whose bound is below the item's k-th score so far is cut,
a leaf's documents are scored exactly.  The k best of all tasks are merged.

A heavy child is split further in place of becoming a node of its own, so a
trie of D documents has at most log2(D) levels whatever its shape; branches of
few documents share a leaf.  Tries hold at most ``TREE_DOCS`` documents, the
scores found in one trie cut the next one of the same task, and items are
taken in blocks of bounded size, so no task's memory grows with the corpus or
with the number of items.

Scores are 64-bit integers as stated in ``SQL``; N counts the documents that
have a term, L all their terms.

Defined cases: null and termless texts match nothing, though repeated rows
each count as a document; an item row without terms gives no rows, and
repeated item rows are items of their own with their own ranks; equal scores
go by ascending id, a null id after all others, rows of one id in any order
among themselves (their output is equal); empty tables give an empty table;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragspark.llm.common import snapshot

TOP_K = 20
TREE_DOCS = 8192            # documents of a trie
TREE_TERMS = 1_000_000      # and their distinct terms together
LEAF = 48                   # documents of a leaf
ITEM_BYTES = 16 << 20       # texts of a block of items, which a task holds whole

# Fixed value: every other character ends a term; A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_CUT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.translate(_CUT).split() if text else []


def _csr(counts: list[Counter]):
    """Row starts, keys and counts of a list of counters."""
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum([len(c) for c in counts], out=starts[1:])
    total = int(starts[-1])
    return (starts, np.fromiter((k for c in counts for k in c), np.int64, total),
            np.fromiter((v for c in counts for v in c.values()), np.int64, total))


def vectors(docs: DataFrame, index: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs): every document's number of terms and its vector
    restricted to the terms of ``index``."""
    known = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        find = known.value.get
        for b in batches:
            lists = [terms(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            counts = [Counter([i for i in map(find, ws) if i is not None]) for ws in lists]
            starts, keys, tfs = _csr(counts)
            at = pa.array(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(ws) for ws in lists], pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(keys.astype(np.int32))),
                 pa.ListArray.from_arrays(at, pa.array(tfs.astype(np.int32)))], names=["id", "n", "terms", "tfs"])
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "id bigint, n bigint, terms array<int>, tfs array<int>")


class Trie:
    """FP-tree of one batch of documents.

    ``rank`` and ``tf`` hold the documents' vectors one after the other, each
    sorted by rank (0: the commonest term); ``starts`` where each begins.
    """

    def __init__(self, ids, null_id, starts, rank, tf, m, weight):
        n = len(ids)
        sizes = np.diff(starts)
        big = rank.astype(">u4").tobytes()
        edge = (starts * 4).tolist()
        paths = [big[edge[i]:edge[i + 1]] for i in range(n)]
        order = np.array(sorted(range(n), key=paths.__getitem__), np.int64)
        self._paths = [paths[i] for i in order]
        self.ids, self.null_id, m = ids[order], null_id[order], m[order]
        sizes = sizes[order]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(starts[order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.rank, tf = rank[take], tf[take]
        self.part = _part(weight[self.rank], tf, np.repeat(m, sizes))
        self._nodes(n)
        self._bounds(tf, m, weight)
        del self._paths

    def _shared(self, a: int, b: int) -> int:
        """Number of terms that all documents of a..b begin with."""
        x, y = self._paths[a], self._paths[b]
        n = min(len(x), len(y))
        diff = np.frombuffer(x, ">u4", n // 4) != np.frombuffer(y, ">u4", n // 4)
        return int(diff.argmax()) if diff.any() else n // 4

    def _branches(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Ranges of documents below a node: its branches, a branch of more
        than half of the documents split again, small neighbours together."""
        most, todo, out = max(LEAF, (hi - lo) // 2), [(lo, hi)], []
        while todo:
            a, b = todo.pop()
            if b - a <= most:
                out.append((a, b))
                continue
            depth = self._shared(a, b - 1)
            at = self.starts[a:b] + depth
            term = np.where(at < self.starts[a + 1:b + 1], self.rank[np.minimum(at, len(self.rank) - 1)], -1)
            cuts = (np.flatnonzero(term[1:] != term[:-1]) + 1 + a).tolist()
            if cuts:
                todo.extend(zip([a, *cuts], [*cuts, b]))
            else:                                  # one path only: equal documents
                out.extend((i, min(i + LEAF, b)) for i in range(a, b, LEAF))
        out.sort()
        joined = out[:1]
        for a, b in out[1:]:
            if b - joined[-1][0] <= LEAF:
                joined[-1] = (joined[-1][0], b)
            else:
                joined.append((a, b))
        return joined

    def _nodes(self, n: int):
        """``span`` (documents), ``kids`` (first and last + 1 child; a leaf has
        none) and ``levels`` (nodes of one depth) in breadth-first order."""
        self.span, self.kids, self.levels = [(0, n)], [], []
        level = [0]
        while level:
            self.levels.append(level)
            below = []
            for node in level:
                lo, hi = self.span[node]
                first = len(self.span)
                if hi - lo > LEAF:
                    self.span.extend(self._branches(lo, hi))
                self.kids.append((first, len(self.span)))
                below.extend(range(first, len(self.span)))
            level = below

    def _bounds(self, tf, m, weight):
        """Per node the terms below it, each with its greatest possible part of a score."""
        width = len(weight)
        sums, ranks, parts = [], [], []
        for level in self.levels:
            lo, hi = zip(*(self.span[v] for v in level))
            sizes = np.diff(self.starts)
            of = np.full(len(m), -1, np.int64)
            for i, (a, b) in enumerate(zip(lo, hi)):
                of[a:b] = i
            least = np.array([m[a:b].min() for a, b in zip(lo, hi)])
            node = np.repeat(of, sizes)
            here = np.flatnonzero(node >= 0)
            key = node[here] * width + self.rank[here]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            top = np.maximum.reduceat(tf[here][by], first)
            key = key[first]
            ranks.append(key % width)
            parts.append(_part(weight[ranks[-1]], top, least[key // width]))
            sums.append(np.bincount(key // width, minlength=len(level)))
        self.node_starts = np.concatenate(([0], np.cumsum(np.concatenate(sums))))
        self.node_rank, self.node_part = np.concatenate(ranks), np.concatenate(parts)

    def search(self, asked, best: list, k: int) -> list:
        """The k best of ``best`` and this trie's documents for one item, as
        (-score, id is null, id); ``asked`` holds the item's count of each term."""
        least = -best[-1][0] if len(best) == k else 1
        todo = [(1 << 62, 0)]
        while todo:
            bound, node = todo.pop()
            if bound < least:
                continue
            first, last = self.kids[node]
            if first < last:
                at = self.node_starts[first:last + 1]
                a, b = at[0], at[-1]
                up = np.add.reduceat(self.node_part[a:b] * asked[self.node_rank[a:b]], at[:-1] - a)
                keep = np.flatnonzero(up >= least)
                keep = keep[np.argsort(up[keep], kind="stable")]
                todo.extend(zip(up[keep].tolist(), (keep + first).tolist()))
                continue
            lo, hi = self.span[node]
            at = self.starts[lo:hi + 1]
            a, b = at[0], at[-1]
            got = np.add.reduceat(self.part[a:b] * asked[self.rank[a:b]], at[:-1] - a)
            keep = np.flatnonzero(got >= least)
            if len(keep):
                best = best + list(zip((-got[keep]).tolist(), self.null_id[lo + keep].tolist(),
                                       self.ids[lo + keep].tolist()))
                best.sort()
                del best[k:]
                if len(best) == k:
                    least = -best[-1][0]
        return best


def _part(w, tf, m):
    """A term's part of a score: w * ((10^9 tf) div (1000 tf + 12 m))."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _tries(batches, rank_of, n_docs: int, n_terms: int, weight):
    """Tries of a task's vectors, ``TREE_DOCS`` documents at a time."""
    held, rows, words = [], 0, 0

    def build():
        ids = np.concatenate([h[0] for h in held])
        null = np.concatenate([h[1] for h in held])
        n = np.concatenate([h[2] for h in held])
        sizes = np.concatenate([h[3] for h in held])
        rank = rank_of[np.concatenate([h[4] for h in held])]
        tf = np.concatenate([h[5] for h in held])
        doc = np.repeat(np.arange(len(ids)), sizes)
        by = np.argsort(doc * len(rank_of) + rank, kind="stable")
        m = 75 + (25 * n * n_docs) // max(n_terms, 1)
        return Trie(ids, null, np.concatenate(([0], np.cumsum(sizes))), rank[by], tf[by], m, weight)

    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            some = sizes > 0
            if not some.any():
                continue
            ids = part.column(0)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False)[some],
                         ids.is_null().to_numpy(zero_copy_only=False)[some],
                         part.column(1).to_numpy(zero_copy_only=False)[some], sizes[some],
                         part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                         part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            rows, words = rows + int(some.sum()), words + int(sizes.sum())
            if rows >= TREE_DOCS or words >= TREE_TERMS:
                yield build()
                held, rows, words = [], 0, 0
    if held:
        yield build()


def _search_block(docs: DataFrame, items: list, item_kind, k: int, id_col: str, text_col: str) -> DataFrame:
    """Ranked documents of one block of items, ``items`` as (item id, terms)."""
    spark, item_type, item_arrow = docs.sparkSession, item_kind.simpleString(), to_arrow_type(item_kind)
    index = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    vecs = snapshot(vectors(docs, index, id_col, text_col), "restricted")
    n_docs, n_terms = vecs.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(index), np.int64)
    for t, c in vecs.select(F.explode("terms").alias("t")).groupBy("t").count().collect():   # rows: the block's terms
        df[t] = c
    by = np.argsort(-df, kind="stable")
    rank_of = np.empty_like(by)
    rank_of[by] = np.arange(len(by))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in df[by].tolist()], np.int64)
    asked = [(i, rank_of[list(c)], np.array(list(c.values()), np.int64))
             for i, c in ((i, Counter(map(index.__getitem__, ts))) for i, ts in items)]
    model = spark.sparkContext.broadcast((rank_of, weight, asked))

    def run(batches):
        rank_of, weight, asked = model.value
        best = [[] for _ in asked]
        count = np.zeros(len(weight), np.int64)
        for trie in _tries(batches, rank_of, n_docs, n_terms, weight):
            for i, (_, at, c) in enumerate(asked):
                count[at] = c
                best[i] = trie.search(count, best[i], k)
                count[at] = 0
        out = [(i, *row) for i, rows in enumerate(best) for row in rows]
        if out:
            i, score, null, ids = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array([x for x in (asked[j][0] for j in i)]).cast(item_arrow),
                 pa.array(ids, pa.int64(), mask=np.array(null)), pa.array([-s for s in score], pa.int64())],
                names=["_item", "item_id", "doc_id", "score"])
    found = vecs.mapInArrow(run, f"_item int, item_id {item_type}, doc_id bigint, score bigint")
    # the k best of some groups of tasks, then of those
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salts = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    few = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("_item", "_salt").orderBy(*order)))
    out = few.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order)))
    return out.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item row."""
    asks = items.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = asks.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = -(-size // ITEM_BYTES)
    item_kind = items.schema[item_col].dataType
    out = None
    for b in range(blocks):
        mine = asks if blocks == 1 else asks.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        rows = [(i, terms(t.encode())) for i, t in mine.collect()]      # about ITEM_BYTES of text
        rows = [r for r in rows if r[1]]
        if rows:
            part = _search_block(docs, rows, item_kind, k, id_col, text_col)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return out


SQL = rf"""
WITH dl AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts
    FROM documents),
stat AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(ts)) AS BIGINT) AS l FROM dl WHERE len(ts) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM dl) GROUP BY ALL),
it AS (
    SELECT item_id, term, count(*) AS q FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
        FROM benchmark) GROUP BY ALL),
w AS (
    SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stat),
scored AS (
    SELECT item_id, doc_id,
           CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // l))))) AS BIGINT) AS score
    FROM it JOIN w USING (term) JOIN tf USING (term), stat GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP_K}
"""
