"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text gets one score, a sum of shared weights of hashed text features, and
ordered thresholds cut the score into grades:
P(grade <= j) = sigmoid(threshold_j - score).  The grade's expectation and the
probability of reaching a wanted grade follow from that.

Features of a text: each distinct word (lower case, outer punctuation off),
each word's first four characters (once per distinct word), and a few levels
of the whole text: how many words are distinct, the shares of capitals,
symbols and digits, and the length.

The fit uses a bounded sample of the rated rows: about ``FIT_ROWS`` rows of
each grade, chosen by a hash of the id, turned into features on the executors
from every word of their whole texts.  Features are counted per grade there, and
the driver gets only those of each text that tell grades apart.  Scoring reads
every whole text.

Defined cases: null and empty texts have no word and get expected grade 0 and
tail probability 0; ratings that are null, or of ids without a document, are
not used; a document rated more than once counts once with its lowest grade;
with fewer than two grades among the ratings every text with a word gets tail
probability 1; repeated rows give one row each; an empty table gives an empty
table.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranks import snapshot
from ragspark.llm.common import lean

FIT_ROWS = 3_000          # expected fitting rows per grade
BITS = 18                 # hashed word features
STEPS = 300
LEAST_PHI = 0.2           # of a common word feature that gets a weight
LEAST_HITS = 6            # of a rare one within its grade,
PURITY = 6                # and how much more often it must stand there than elsewhere
PENALTY = 3e-4            # on squared weights: few fitting rows, small weights
LEVELS = 10
_MEMO = 300_000

_HASHED = 1 << BITS
_SPACE = _HASHED + 5 * (LEVELS + 1)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?")
_OUTER = "".join(map(chr, _SYMBOL)) + ".,;:'\"()-?"


@dataclass(frozen=True)
class OrdinalModel:
    """Weights over the feature space and the ordered thresholds (grades - 1)."""

    weights: np.ndarray
    thresholds: np.ndarray


def _word_features(word: str) -> tuple[int, int]:
    """Buckets of a word and of its first four characters."""
    w = word.lower().strip(_OUTER) or word
    return zlib.crc32(b"w" + w.encode()) % _HASHED, zlib.crc32(b"p" + w[:4].encode()) % _HASHED


def _level_features(text: str, n_words: int, n_distinct: int) -> list[int]:
    """One bucket for each of the whole text's levels."""
    raw = text.encode("utf-8")
    n = max(1, len(raw))
    shares = [n_distinct / n_words, *(1 - len(raw.translate(None, x)) / n for x in (_UPPER, _SYMBOL, _DIGIT))]
    cut = [shares[0], *(min(1.0, 3 * x) for x in shares[1:]), min(1.0, np.log2(n_words) / 16)]
    return [_HASHED + j * (LEVELS + 1) + int(x * LEVELS) for j, x in enumerate(cut)]


def _features(text: str) -> list[int]:
    words = text.split()
    distinct = set(words)
    out = _level_features(text, len(words), len(distinct))
    for w in sorted(distinct):
        out += _word_features(w)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _telling(hit: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Which features get a weight, from their counts per grade (grades x
    ``_SPACE``) and the fitting rows per grade: all levels, and a word feature that
    tells one grade from the others by at least 4 standard errors, if either the phi
    coefficient of its presence is LEAST_PHI or more, or it is typical of a grade:
    LEAST_HITS fitting rows, and PURITY times its share elsewhere.  So a lexicon
    of rare words counts like a few common ones, whatever the sample's size."""
    per = np.maximum(per, 1e-9)[:, None].astype(float)
    other, n_other = hit.sum(0) - hit, per.sum() - per
    pool = np.clip(hit.sum(0) / per.sum(), 1e-9, 1 - 1e-9)
    gap = np.minimum(hit / per, 1) - np.minimum(other / n_other, 1)
    z = gap / np.sqrt(pool * (1 - pool) * (1 / per + 1 / n_other))
    broad = np.abs(z).max(0) >= max(4.0, LEAST_PHI * np.sqrt(round(per.sum())))
    typical = ((z >= 4) & (hit >= LEAST_HITS) & (hit / per >= PURITY * (other + 0.5) / n_other)).any(0)
    return (broad | typical | (np.arange(_SPACE) >= _HASHED)) & (hit.sum(0) > 0)


def _train(feats: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = STEPS) -> OrdinalModel:
    """Full-batch Adam on the mean negative log-likelihood over the features
    that tell grades apart; all others keep weight 0."""
    row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    used, col = np.unique(np.concatenate(feats), return_inverse=True)
    n = len(feats)
    # grades count alike, whatever their share of the ratings
    share = np.bincount(grades, minlength=n_grades).astype(float)
    balance = (n / (np.count_nonzero(share) * np.maximum(share, 1)))[grades]
    w, first, gaps = np.zeros(len(used)), np.array([-0.5]), np.zeros(n_grades - 2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, first, gaps)]
    for t in range(1, steps + 1):
        cuts = np.concatenate((first, first + np.cumsum(np.exp(gaps))))
        score = np.bincount(row, w[col], minlength=n)
        edge = np.concatenate((np.full((n, 1), 0.0), _sigmoid(cuts[None, :] - score[:, None]), np.full((n, 1), 1.0)), axis=1)
        hi, lo = edge[np.arange(n), grades + 1], edge[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p * balance, lo * (1 - lo) / p * balance   # d log p / d cut
        d_score = (d_hi - d_lo) / n
        d_cuts = np.zeros(n_grades - 1)
        for j in range(n_grades - 1):
            d_cuts[j] = (-(d_hi[grades == j]).sum() + d_lo[grades == j + 1].sum()) / n
        tail = np.cumsum(d_cuts[::-1])[::-1]
        grads = (np.bincount(col, d_score[row], minlength=len(used)) + PENALTY * w,
                 np.array([d_cuts.sum()]), tail[1:] * np.exp(gaps))
        for p_, g, s, lr in zip((w, first, gaps), grads, state, (0.1, 0.1, 0.1)):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            p_ -= lr * (s[0] / (1 - 0.9 ** t)) / (np.sqrt(s[1] / (1 - 0.999 ** t)) + 1e-8)
    out = np.zeros(_SPACE, np.float32)
    out[used] = w
    return OrdinalModel(out, np.concatenate((first, first + np.cumsum(np.exp(gaps)))))


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: bad; 1: well written but toxic; 2: good."""
    return F.when(F.col(quality) == 0, 0).when(F.coalesce(F.col(toxic), F.lit(0)) == 1, 1).when(F.col(quality) == 1, 2)


def fit(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text",
        fit_rows: int = FIT_ROWS, n_grades: int = 3) -> OrdinalModel | None:
    """Fit on about ``fit_rows`` rated documents of each grade; None with fewer than two grades."""
    rated = (labels.select(F.col(id_col).alias("i"), grade.cast("int").alias("g")).where("i is not null and g is not null")
             .groupBy("i").agg(F.min("g").alias("g")))
    size = {r["g"]: r["n"] for r in rated.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}   # n_grades rows
    if len(size) < 2:
        return None
    share = F.lit(0.0)
    for g, n in size.items():
        share = F.when(F.col("g") == g, min(1.0, fit_rows / n)).otherwise(share)
    point = F.pmod(F.xxhash64(F.col("i"), F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rated.where(point < share)          # bounded: about n_grades x fit_rows ids
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").join(
        F.broadcast(chosen), "i").select("i", "g", "t")

    rows = snapshot(rows, "ordinal-fit")         # bounded: read twice

    @lean
    def count(batches):
        """(grade, feature, times) per task, and under ``_SPACE`` the texts that have a word."""
        hit = np.zeros((n_grades, _SPACE + 1), np.int64)
        for b in batches:
            for g, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t.split():
                    np.add.at(hit[g], _features(t), 1)
                    hit[g, _SPACE] += 1
        at = np.nonzero(hit)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(hit[at])], names=["g", "f", "n"])
    counted = rows.mapInArrow(count, "g bigint, f bigint, n bigint").groupBy("g", "f").agg(F.sum("n").alias("n"))
    got = counted.toPandas()                     # at most n_grades x feature buckets
    hit = np.zeros((n_grades, _SPACE + 1))
    hit[got["g"].to_numpy(int), got["f"].to_numpy(int)] = got["n"].to_numpy(float)
    telling = docs.sparkSession.sparkContext.broadcast(_telling(hit[:, :_SPACE], hit[:, _SPACE]))

    @lean
    def run(batches):
        for b in batches:
            f = [np.array(_features(t) if t.split() else [], np.int32) for t in b.column(2).to_pylist()]
            f = [x[telling.value[x]].tobytes() for x in f]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], names=["i", "g", "f"])
    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"i {kind}, g int, f binary").toPandas().sort_values("i", kind="stable")
    feats = [np.frombuffer(x, np.int32) for x in got["f"]]
    live = [j for j, f in enumerate(feats) if len(f)]
    grades = got["g"].to_numpy(int)[live]
    if len(np.unique(grades)) < 2:
        return None
    return _train([feats[j] for j in live], grades, n_grades)


class Scorer:
    """Grades of whole texts; a word's summed weight is remembered per worker."""

    def __init__(self, model: OrdinalModel):
        self.model, self.memo = model, {}

    def _word(self, word: str) -> float:
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        a, b = _word_features(word)
        got = float(self.model.weights[a] + self.model.weights[b])
        if len(word) <= 64:
            self.memo[word] = got
        return got

    def __call__(self, text: str | None) -> tuple[float, float]:
        """(expected grade, P(grade is the best one))"""
        words = text.split() if text else []
        if not words:
            return 0.0, 0.0
        known, distinct = self.memo.get, set(words)
        parts = [k if (k := known(w)) is not None else self._word(w) for w in distinct]
        score = float(np.sum(np.sort(parts)))     # sorted: the same sum whatever the set's order
        score += float(self.model.weights[_level_features(text, len(words), len(distinct))].sum())
        above = 1 - _sigmoid(self.model.thresholds - score)
        return float(above.sum()), float(above[-1])




def _grades(texts: list[str | None], scorer: Scorer | None, n_grades: int = 3):
    if scorer is None:
        return [(float(n_grades - 1), 1.0) if t and t.split() else (0.0, 0.0) for t in texts]
    return [scorer(t) for t in texts]


def predict(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text",
            least: float = 0.4) -> DataFrame:
    """(id, expected_grade, tail_prob, selected) of every row, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        scorer = Scorer(sent.value) if sent.value is not None else None
        for b in batches:
            got = np.array(_grades(b.column(1).to_pylist(), scorer), float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(got[:, 1] >= least)],
                names=[id_col, "expected_grade", "tail_prob", "selected"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, expected_grade double, tail_prob double, selected boolean")


def accept(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The input rows (all columns) whose tail probability is ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @lean
    def run(batches):
        scorer = Scorer(sent.value) if sent.value is not None else None
        for b in batches:
            tail = np.array(_grades(b.column(at).to_pylist(), scorer), float).reshape(-1, 2)[:, 1]
            yield b.filter(pa.array(tail >= least))
    return docs.mapInArrow(run, docs.schema)
