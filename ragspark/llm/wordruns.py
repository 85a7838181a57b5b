"""Periodic runs of words by maximal pairs.

A run is a stretch of words with smallest period q, at least ``LEAST`` words
and ``TIMES`` periods long, that no neighbouring word extends.  Two equal
stretches that differ in the word to their left and in the word to their right
are a maximal pair.  A run of L words is the maximal pair of its stretches of
L - q words that begin q apart; a maximal pair of l words whose distance d is
at most l / (TIMES - 1) is such a stretch with period d, already as long as it
can be.  So the pairs under that constraint are the runs, each found once for
q and maybe again for multiples of q, of which the least counts.

Pairs come from the LCP-interval tree of the suffixes, walked bottom-up.  A
node's members are kept in order of position with their left words; when two
children meet, each member of the smaller one looks into the larger one
within the allowed distance.  Equal stretches that lie so near stand one
period apart, and all but the first have the same left word, so a look finds
every pair of different left words without passing the others.  Suffixes are
sorted by prefix doubling over the texts of a batch together, and only for
texts in which some stretch of ``LEAST`` - 1 words returns; intervals whose
members all lie too far apart are left out before the walk.  A text costs
about n log n, whatever its words.

Every text is handled by itself within its batch: no shuffle, and a task holds
one batch.

Defined cases: words are cut at ASCII white space, as written; null, empty and
blank texts have no words and no runs; a very long text is read whole; each
input row gives one row, repeated rows too; runs may overlap; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6                  # words of a run
TIMES = 4                  # periods of a run
BATCH_WORDS = 400_000      # words sorted together (a longer text alone)


def planted(doc_id, words: list) -> list:
    """The words with a periodic tail in every tenth document (by the id's crc32)."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (1 + (n - a) // p))[:n - a]


def _returning(codes: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the texts in which a stretch of ``least`` - 1 words may occur twice."""
    n = len(codes) - least + 2
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for j in range(least - 1):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + n].astype(np.uint64)
        key ^= key >> np.uint64(29)
    by = np.argsort(key)
    key = key[by]
    return np.unique(doc[by[1:][key[1:] == key[:-1]]])


def _suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and the common words of each two neighbours in it.

    Every text in ``codes`` has its own codes and ends with a smaller one that
    occurs once, so stretches of different texts never meet."""
    rank, levels, width = codes, [], 1
    while True:
        kinds, rank = np.unique(rank, return_inverse=True)
        levels.append(rank.astype(np.int32))
        if len(kinds) == len(codes):
            break
        follow = np.zeros(len(codes), np.int64)
        follow[:-width] = rank[width:]
        rank = rank * len(kinds) + follow
        width *= 2
    order = np.empty(len(codes), np.int64)
    order[rank] = np.arange(len(codes))
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for at, level in reversed(list(enumerate(levels[:-1]))):
        step = (level[a] == level[b]) * np.int64(1 << at)
        a += step
        b += step
        common += step
    return order, common


def _meet(size: int, one: list, two: list, left, times: int, found: dict) -> list:
    """Maximal pairs between two children of a node of ``size`` words, then
    the members of both."""
    few, many = (one, two) if len(one) < len(two) else (two, one)
    reach = size // (times - 1)
    for i in few:
        at = bisect_left(many, i - reach)
        if at < len(many) and many[at] < i and left[many[at]] != left[i]:
            d = i - many[at]
            key = (many[at], size + d)
            found[key] = min(found.get(key, d), d)
        for at in range(bisect_right(many, i), len(many)):
            d = many[at] - i
            if d > reach or left[many[at]] == left[i]:
                break
            key = (i, size + d)
            found[key] = min(found.get(key, d), d)
    if len(few) * 8 < len(many):
        for i in few:
            insort(many, i)
    else:
        many.extend(few)
        many.sort()
    return many


def _walk(at: list, common: list, left, times: int, found: dict) -> None:
    """LCP intervals of neighbouring suffixes ``at``, from the deepest up."""
    open_, last = [], [at[0]]
    for size, suffix in zip(common, at[1:]):
        while open_ and open_[-1][0] > size:
            inner, members = open_.pop()
            last = _meet(inner, members, last, left, times, found)
        if open_ and open_[-1][0] == size:
            open_[-1][1] = _meet(size, open_[-1][1], last, left, times, found)
        else:
            open_.append([size, last])
        last = [suffix]
    while open_:
        inner, members = open_.pop()
        last = _meet(inner, members, last, left, times, found)


def _runs(codes: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """{(start, length): period} of the runs in texts laid end to end."""
    order, common = _suffixes(codes)
    deep = common >= least - 1
    # stretches of neighbours that share enough words
    edge = np.flatnonzero(np.diff(np.concatenate(([0], deep.astype(np.int8), [0]))))
    firsts, lasts = edge[::2], edge[1::2]                # suffixes firsts..lasts, both included
    found: dict[tuple[int, int], int] = {}
    if not len(firsts):
        return found
    sizes = lasts - firsts + 1
    group = np.repeat(np.arange(len(firsts)), sizes)
    begin = np.cumsum(sizes) - sizes
    members = order[np.arange(len(group)) - np.repeat(begin - firsts, sizes)]
    by = np.lexsort((members, group))
    gap = np.diff(members[by])
    gap[group[1:] != group[:-1]] = len(codes)
    nearest = np.minimum.reduceat(np.concatenate((gap, [len(codes)])), begin)
    longest = np.maximum.reduceat(np.where(deep, common, 0), firsts)
    left = np.concatenate(([-1], codes[:-1])).tolist()
    for g in np.flatnonzero(nearest * (times - 1) <= longest).tolist():
        a, b = int(firsts[g]), int(lasts[g])
        _walk(order[a:b + 1].tolist(), common[a:b].tolist(), left, times, found)
    return {k: q for k, q in found.items() if k[1] >= least}


def find(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs of each text's words as (start, length, period), in order."""
    out: list[list] = [[] for _ in texts]
    held, total = [], 0
    for i, words in enumerate(texts):
        if len(words) >= least:
            held.append(i)
            total += len(words)
        if held and (total >= BATCH_WORDS or i == len(texts) - 1):
            _find(texts, held, least, times, out)
            held, total = [], 0
    if held:
        _find(texts, held, least, times, out)
    return out


def _find(texts: list, which: list[int], least: int, times: int, out: list) -> None:
    codes, base = [], 0
    for i in which:
        known: dict = {}
        add = known.setdefault
        own = np.array([add(w, len(known)) for w in texts[i]], np.int64)
        codes.append(np.append(own + (base + 1), base))         # the end: less than the text's words
        base += len(known) + 1
    sizes = np.array([len(c) for c in codes])
    doc = np.repeat(np.arange(len(codes)), sizes)
    some = _returning(np.concatenate(codes), doc, least).tolist()
    if not some:
        return
    starts = np.cumsum([0] + [len(codes[j]) for j in some])
    found = _runs(np.concatenate([codes[j] for j in some]), least, times)
    for (at, length), q in sorted(found.items()):
        j = int(np.searchsorted(starts, at, "right")) - 1
        out[which[some[j]]].append((at - int(starts[j]), length, q))


def _kept(words: list, runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repeats: of each run only its first period stays."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in keep])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
         change=None) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of every whole text in order of
    start and period, and the text with each run cut to its first period.
    ``change(id, words)`` may rewrite a text's words first."""
    def run(batches):
        for b in batches:
            texts = [t.split() if t else [] for t in b.column(1).cast(pa.binary()).to_pylist()]
            if change:
                texts = [change(i, ws) for i, ws in zip(b.column(0).to_pylist(), texts)]
            got = find(texts, least, times)
            got = [sorted(r, key=lambda x: (x[0], x[2])) for r in got]
            flat = np.array([x for r in got for x in r], np.int64).reshape(-1, 3)
            at = pa.array(np.cumsum([0] + [len(r) for r in got]).astype(np.int32))
            parts = pa.StructArray.from_arrays([pa.array(flat[:, j].copy()) for j in range(3)], ["start", "length", "period"])
            text = pa.array([_kept(ws, r) for ws, r in zip(texts, got)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(ws) for ws in texts], pa.int64()), pa.ListArray.from_arrays(at, parts), text],
                names=[id_col, "n_words", "runs", "collapsed"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_words bigint, "
             "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: its longest run (least start, then period) and digests of all
    runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    # the greatest length, then the least start and period
    top = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    d = found.withColumn("_top", top)
    return d.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_top.s")).alias("start"),
        F.col("_top.l").alias("length"), (-F.col("_top.p")).alias("period"),
        F.expr("(1000 * _top.l) div (-_top.p)").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
