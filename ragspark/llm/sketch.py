"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the ``K`` smallest distinct 64-bit hashes of a text's shingles
of five words.  Sketches of parts merge to the sketch of the whole; two of
them estimate resemblance and containment, one estimates the number of
distinct shingles.  All of it is SQL functions on arrays: no Python runs on
the executors.

``edited`` gives each document the text that follows when its second half is
replaced from the next document in descending id order.  The order is never
put in one task: ids are cut into many ranges by quantiles, each range is one
window, and the first row of a range is sent to the range before it too.

Defined cases: null text counts as empty; a text without words has the empty
sketch, one of fewer than five words has one shingle of all its words; two
empty sketches have likeness 1, an empty and another one 0.  Words are cut at
white space, as written.  Rows of equal id are ordered by their text.  A null
id has no place in the order: the next text of such a row is empty.  A single
row is its own next.  An empty table gives an empty table.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128          # hashes kept; the error of an estimate is about sqrt(s(1-s)/K)
SHINGLE = 5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """White-space separated words, as written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The k smallest distinct hashes of a text's shingles, ascending."""
    def of(w):
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - shingle),
                           lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        few = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(n >= shingle, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(_let(words(text), of))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of two texts (0 to 1)."""
    def of(u):
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return _let(merge(a, b, k), of)


def n_distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = F.element_at(a, -1).cast("double") + 2.0 ** 63
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(
        (k - 1) / F.greatest(kth / 2.0 ** 64, F.lit(1e-300)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second one has."""
    both = resemblance(a, b, k) * n_distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / n_distinct(a, k)))


def fingerprint(a: Column) -> Column:
    """A sketch as text: base64 of the hashes, 8 bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def _bounds(docs: DataFrame, id_col: str, ranges: int) -> list[int]:
    """Ascending last ids of at most ``ranges`` ranges of about equally many rows."""
    steps = [(i + 1) / ranges for i in range(ranges)]
    got = docs.select(F.col(id_col).alias("i")).agg(
        F.percentile_approx("i", steps, max(10_000, 20 * ranges)).alias("q"), F.max("i").alias("m")).first()
    return sorted({*got["q"], got["m"]}) if got["q"] else []


def _placed(docs: DataFrame, id_col: str, bounds: list[int]) -> DataFrame:
    """Adds ``_range`` (the row's range), ``_last`` (the row has its range's last
    id) and one copy of each such row for the range after it (``_copy``)."""
    if not bounds:
        return docs.withColumn("_range", F.lit(0).cast("bigint")).withColumn("_copy", F.lit(False))
    side = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + side] for i in range(0, len(bounds), side)]
    nested = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    coarse = F.from_json(F.lit(json.dumps([g[-1] for g in groups[:-1]])), "array<bigint>")
    i = F.col(id_col)
    d = docs.withColumn("_group", F.size(F.filter(coarse, lambda x: x < i)))
    d = d.withColumn("_fine", F.get(nested, F.col("_group")))
    at = F.col("_group").cast("bigint") * side + F.size(F.filter("_fine", lambda x: x < i))
    d = d.withColumn("_at", F.when(i.isNull(), -1 - F.pmod(F.xxhash64("_text"), F.lit(len(bounds)))).otherwise(at))
    after = F.when(F.col("_at") == len(bounds) - 1, F.lit(0)).otherwise(F.col("_at") + 1)
    spots = F.when(F.coalesce(F.array_contains("_fine", i), F.lit(False)) & i.isNotNull(),
                   F.array(F.struct(F.col("_at").alias("r"), F.lit(False).alias("c")),
                           F.struct(after.alias("r"), F.lit(True).alias("c")))
                   ).otherwise(F.array(F.struct(F.col("_at").alias("r"), F.lit(False).alias("c"))))
    d = d.withColumn("_spot", F.explode(spots))
    return d.select(*docs.columns, F.col("_spot.r").alias("_range"), F.col("_spot.c").alias("_copy"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, n_chars, text, sketch, next_sketch, edited): every row with its whole
    text, the next document's sketch and the edited text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    n = docs.count()
    # only the size of a window: the driver holds one id per range
    ranges = min(max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4096), 1 << 16)
    d = _placed(rows, id_col, _bounds(docs, id_col, ranges))
    w = Window.partitionBy("_range").orderBy("_copy", F.col(id_col).desc(), "_text")
    d = d.withColumn("_next", F.lead("_text").over(w)).withColumn("_sketch", sketch(F.col("_text"), k))
    d = d.withColumn("_next_sketch", F.lead("_sketch").over(w)).where(~F.col("_copy"))
    known = F.col(id_col).isNotNull()
    after = F.when(known, F.coalesce("_next", F.lit(""))).otherwise(F.lit(""))
    half = F.floor(F.length("_text") / 2).cast("int")
    return d.select(
        id_col, F.length("_text").cast("bigint").alias("n_chars"), F.col("_text").alias("text"),
        F.col("_sketch").alias("sketch"),
        F.when(known, F.col("_next_sketch")).otherwise(F.array().cast("array<bigint>")).alias("next_sketch"),
        F.concat(F.expr("substring(_text, 1, length(_text) - cast(floor(length(_text) / 2) as int))"),
                 F.substring(after, F.lit(1), half)).alias("edited"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness."""
    d = edited(docs, id_col, text_col, k).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return d.select(
        id_col, "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_contained"),
        n_distinct(F.col("sketch"), k).alias("n_shingles"))
