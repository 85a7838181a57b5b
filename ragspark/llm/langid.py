"""Language ID by error-correcting output codes.

Each language has a codeword of bits.  One binary classifier per bit, over
hashed byte n-grams, tells the languages whose bit is set from the others; a
text's bits need not match any codeword, and decoding takes the language whose
codeword has the least loss.  Losses are weighted by how reliable each bit was
for each language on the fitting rows, and a text whose two nearest codewords
are about as near is flagged ambiguous.

Codewords only compare the learned languages.  Whether a text is in one of them
at all is told by an absolute measure: the mean log-likelihood of its n-grams in
the decoded language, against the same measure of the fitting rows of that
language, each without its own counts.  The spread allowed falls with the length
of the text, and the cut keeps about 99.9 % of the fitting rows.  A text beyond
it gets score 0; the pipeline drops it.

The classifiers are log-odds of n-gram counts, so fitting is one distributed
count and one pass that measures the fitting rows.  It uses a bounded sample: about ``FIT_ROWS`` rows of every language,
chosen by a hash of the id.  Prediction reads every whole text.

Defined cases: null text, or text without a letter: ``und``, score 0, not
ambiguous; rows with a null id or null language are not learned from but are
predicted; without any learnable row every text is ``und``; repeated rows give
one output row each; one single language always wins with score 1 (``accept``
still drops texts far from it); an empty table gives an empty table.  Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import lean, learns

UND = "und"
FIT_ROWS = 2_000          # expected fitting rows per language
ORDERS = (2, 3, 4)        # bytes per n-gram
BUCKETS = 1 << 14         # hashed n-grams per order
AMBIGUOUS = 0.6           # a best score below this is flagged
FAR_SHARE = 0.001         # of the fitting rows may be far from their language
FAR_LEAST = 5.0           # spreads below the middle that a text may always be

_NONE = len(ORDERS) * BUCKETS     # a bucket without weight

_LETTER = regex.compile(r"\p{L}").search
# ASCII that is not a letter counts as a space; ASCII capitals as small letters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class LangModel:
    """languages (K), codebook K x B of +-1, weights B x (orders*BUCKETS + 1),
    reliability K x B (rows sum to 1), likelihood K x (orders*BUCKETS + 1): log of
    each n-gram's rate over an even one, typical K x 4: middle of the fitting rows'
    mean likelihood, its variance between texts and by 1 / length, least distance."""

    languages: tuple[str, ...]
    codebook: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray
    likelihood: np.ndarray
    typical: np.ndarray


def codebook(k: int) -> np.ndarray:
    """K codewords: every two-way split of the languages for up to 6 of them,
    beyond that 8*log2(K) splits drawn once from a fixed seed (distinct rows)."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        splits = [s for s in itertools.product((1.0, -1.0), repeat=k) if s[0] > 0 and min(s) < 0]
        return np.array(splits).T
    rng = np.random.default_rng(7)
    bits = int(np.ceil(8 * np.log2(k)))
    while True:
        code = rng.choice((1.0, -1.0), size=(k, bits))
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all():
            return code


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after the other, and each text's count.
    Every text is folded, its words parted by single spaces."""
    folded = [b" " + b" ".join(t.lower().encode("utf-8").translate(_FOLD).split()) + b" " for t in texts]
    size = np.array([len(f) for f in folded])
    raw = np.frombuffer(b"".join(folded), np.uint8).astype(np.uint32)
    out, ends = np.empty((len(ORDERS), len(raw)), np.int32), np.cumsum(size)
    for row, n in enumerate(ORDERS):
        h = raw.copy()
        for j in range(1, n):
            h[:-j] = h[:-j] * np.uint32(0x01000193) + raw[j:]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[row] = (h >> np.uint32(18)).astype(np.int32) + row * BUCKETS
        for j in range(1, n):                   # those that run over a text's end count nothing
            out[row, ends - j] = _NONE
    return out, size


def _margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Per text and bit: the sum of log-odds over the text's n-grams, divided
    by the square root of their number."""
    grams, size = _grams(texts)
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    total = np.zeros((len(texts), len(weights)))
    for row in grams:
        for b, weight in enumerate(weights):
            total[:, b] += np.add.reduceat(weight[row], starts)
    return total / np.sqrt(len(ORDERS) * size)[:, None]


def _scores(texts: list[str], m: LangModel) -> np.ndarray:
    """Texts x languages: softmax of minus the reliability-weighted logistic loss."""
    f = np.clip(_margins(texts, m.weights), -30, 30)
    loss = np.log1p(np.exp(-m.codebook[None, :, :] * f[:, None, :]))
    near = -(loss * m.reliability[None, :, :]).sum(2) * m.codebook.shape[1]
    near = np.exp(near - near.max(1, keepdims=True))
    return near / near.sum(1, keepdims=True)


def _near(texts: list[str], which: np.ndarray, m: LangModel) -> np.ndarray:
    """Whether each text is as likely in language ``which`` as that language's texts are."""
    grams, size = _grams(texts)
    starts, lang = np.concatenate(([0], np.cumsum(size)[:-1])), np.repeat(which, size)
    total = sum(np.add.reduceat(m.likelihood[lang, row], starts, dtype=np.float64) for row in grams)
    middle, between, within, least = m.typical[which].T
    return (total / (len(ORDERS) * size) - middle) / np.sqrt(between + within / size) >= least


def _own_likelihood(text: str, counts: np.ndarray) -> tuple[float, int]:
    """Mean log-likelihood of a fitting text by its language's ``counts`` without its own; its length."""
    grams, size = _grams([text])
    total = 0.0
    for j, row in enumerate(grams):
        got, times = np.unique(row[row != _NONE], return_counts=True)
        all_ = counts[j * BUCKETS:(j + 1) * BUCKETS].sum() - times.sum()
        total += (times * np.log((counts[got] - times + 0.5) / (all_ + 0.5 * BUCKETS) * BUCKETS)).sum()
    return float(total / (len(ORDERS) * size[0])), int(size[0])


def _typical(mean: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Middle, variance between texts, variance by 1 / length and least distance of one language."""
    if not len(mean):
        return np.array([0.0, 0.0, 1.0, -np.inf])
    middle, long = np.median(mean), size >= np.median(size)
    square = (mean - middle) ** 2 / 0.455                  # median of a squared normal value
    between = max(float(np.median(square[long])), 1e-4)
    within = max(float(np.median((square * size)[~long])) if (~long).any() else 0.0, 1.0)
    far = (mean - middle) / np.sqrt(between + within / size)
    return np.array([middle, between, within, min(float(np.quantile(far, FAR_SHARE)), -FAR_LEAST)])


def _chunks(texts: list[str], most: int = 1 << 21):
    """Slices of a batch of about ``most`` characters (a long text alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        hold_mod: int = 5, fit_rows: int = FIT_ROWS) -> LangModel:
    """Fit on rows whose crc32(id) mod ``hold_mod`` is not 0 and whose language
    is not null; about ``fit_rows`` of each language, chosen by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"),
                       F.col(lang_col).alias("l")).where(
        learns("i", hold_mod) & F.col("l").isNotNull() & F.col("t").isNotNull())
    # one row per language
    size = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(size))
    k = len(languages)
    code = codebook(k)
    if not k:
        return LangModel(languages, code, np.zeros((1, _NONE + 1), np.float32), np.ones((k, 1)),
                         np.zeros((0, _NONE + 1), np.float32), np.zeros((0, 4)))
    share = F.lit(1.0)
    for lang in languages:
        share = F.when(F.col("l") == lang, min(1.0, fit_rows / size[lang])).otherwise(share)
    point = F.pmod(F.xxhash64(F.col("i"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(point < share)
    parts = max(1, min(k * fit_rows, sum(size.values())) // 1000)
    sample = sample.select("t", "l").repartition(int(parts))     # bounded rows, dealt evenly
    number = {lang: j for j, lang in enumerate(languages)}

    @lean
    def count(batches):
        table = np.zeros((k, _NONE + 1), np.int64)
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                grams, _ = _grams([text])
                table[number[lang]] += np.bincount(grams.ravel(), minlength=table.shape[1])
        table[:, _NONE] = 0
        at = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(table[at])], names=["k", "g", "n"])

    counts = sample.mapInArrow(count, "k bigint, g bigint, n bigint").groupBy("k", "g").agg(F.sum("n").alias("n"))
    got = counts.toPandas()                  # at most K x n-gram buckets
    table = np.zeros((k, _NONE))
    table[got["k"].to_numpy(int), got["g"].to_numpy(int)] = got["n"].to_numpy(float)
    per_order = table.reshape(k, len(ORDERS), BUCKETS) + 0.5
    rate = (per_order / per_order.sum(2, keepdims=True)).reshape(k, -1)
    weights = np.zeros((code.shape[1], _NONE + 1), np.float32)
    for b in range(code.shape[1] if k > 1 else 0):
        on, off = rate[code[:, b] > 0].mean(0), rate[code[:, b] < 0].mean(0)
        weights[b, :_NONE] = np.log(on) - np.log(off)

    likelihood = np.zeros((k, _NONE + 1), np.float32)
    likelihood[:, :_NONE] = np.log(rate * BUCKETS)

    sent = docs.sparkSession.sparkContext.broadcast(weights)
    sent_counts = docs.sparkSession.sparkContext.broadcast(table.astype(np.float64))

    @lean
    def measure(batches):
        for b in batches:
            which = [number[x] for x in b.column(1).to_pylist()]
            got = [_own_likelihood(t, sent_counts.value[j]) for t, j in zip(b.column(0).to_pylist(), which)]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([x for x, _ in got], pa.float64()),
                                              pa.array([n for _, n in got], pa.int64())], names=["k", "mean", "size"])
    # bounded: one row per fitting text that has a letter
    seen = sample.where(F.col("t").rlike(r"\p{L}")).mapInArrow(measure, "k bigint, mean double, size bigint").toPandas()
    typical = np.stack([_typical(g["mean"].to_numpy(), g["size"].to_numpy(float)) for g in (seen[seen["k"] == j] for j in range(k))])

    @lean
    def hits(batches):
        right, n = np.zeros_like(code), np.zeros(k)
        for b in batches:
            texts = b.column(0).to_pylist()
            which = np.array([number[x] for x in b.column(1).to_pylist()], int)
            for i, j in _chunks(texts):
                ok = np.sign(_margins(texts[i:j], sent.value)) == code[which[i:j]]
                np.add.at(right, which[i:j], ok)
                np.add.at(n, which[i:j], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(n), pa.array(list(right))],
                                         names=["k", "n", "right"])

    right, n = np.zeros_like(code), np.zeros(k)
    hit = sample.mapInArrow(hits, "k bigint, n double, right array<double>")
    for r in hit.groupBy("k").agg(F.sum("n").alias("n"), *[
            F.sum(F.col("right")[b]).alias(f"r{b}") for b in range(code.shape[1])]).collect():   # K rows
        n[r["k"]] = r["n"]
        right[r["k"]] = [r[f"r{b}"] for b in range(code.shape[1])]
    rel = (right + 1) / (n[:, None] + 2)
    return LangModel(languages, code, weights, rel / rel.sum(1, keepdims=True), likelihood, typical)


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, runner_up, ambiguous) of every row, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return _map(docs.select(id_col, F.col(text_col).cast("string").alias("_text")), sent, id_col)


def _map(rows: DataFrame, sent, id_col: str) -> DataFrame:
    @lean
    def run(batches):
        m = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score, second, vague = [UND] * len(texts), np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts), bool)
            live = [i for i, t in enumerate(texts) if t and m.languages and _LETTER(t)]
            for i, j in _chunks([texts[x] for x in live]):
                at = live[i:j]
                s = _scores([texts[x] for x in at], m)
                order = np.argsort(-s, axis=1, kind="stable")
                near = _near([texts[x] for x in at], order[:, 0], m) | (len(m.languages) == 1)
                for row, x in enumerate(at):
                    lang[x], score[x] = m.languages[order[row, 0]], s[row, order[row, 0]] * near[row]
                    if len(m.languages) > 1:
                        second[x], vague[x] = m.languages[order[row, 1]], score[x] < AMBIGUOUS
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang), pa.array(score), pa.array(second, pa.string()), pa.array(vague)],
                names=[id_col, "lang_pred", "score", "runner_up", "ambiguous"])
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, runner_up string, ambiguous boolean")


def accept(docs: DataFrame, model: LangModel, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The input rows (all columns) that have a language: not ``und``, near the
    decoded language and a best score of ``least`` or more.  Rows pass through whole; nothing is joined."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index(text_col), docs.schema

    @lean
    def run(batches):
        m = sent.value
        for b in batches:
            texts = b.column(at).to_pylist()
            keep = np.zeros(len(texts), bool)
            live = [i for i, t in enumerate(texts) if t and m.languages and _LETTER(t)]
            for i, j in _chunks([texts[x] for x in live]):
                some = [texts[x] for x in live[i:j]]
                s = _scores(some, m)
                keep[live[i:j]] = (s.max(1) >= least) & _near(some, s.argmax(1), m)
            yield b.filter(pa.array(keep))
    return docs.mapInArrow(run, schema)
