"""Mixing sources to target weights: budgets down a tree, prefixes of seeded epochs.

A tree of levels (domain, language, source) has integer weights on its nodes
and a token budget at its root.  Going down, each parent's budget is shared
among its children by weight; a child that cannot use its share (its leaves
times the allowed epochs are too small) takes all it has, and what is left
over is shared among its siblings again.  Only what a whole subtree cannot use
goes to the subtree's own siblings.  One pass suffices: with children sorted by
capacity per weight, those that fill up come first, so the fill level is the
largest of (budget - capacities before) / (weights from here on).

A leaf spends its budget on whole passes over its documents and then on a
prefix of one more pass, in an order seeded by (seed, pass, id).  The prefix
comes from running sums inside about sqrt(rows) hash ranges per leaf on top of
the ranges' totals, so that a leaf with a third of all rows is no single task.

Only SQL functions run on the executors.

Defined cases: null levels are the node ``none`` (``und`` for a language);
null text has no words, and rows without words are taken with the pass they
fall in but cost nothing; a node of weight 0, or without a weight, gets
nothing; budgets are whole tokens, rounded down at each node, so up to one token
per node is not spent; rows of equal id in a leaf are ordered by their token
count; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.ranks import snapshot
from ragspark.llm.sketch import words

LEVELS = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def _key(seed: int, epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("")))
                 .cast("binary"))


def allocate(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget: Column) -> DataFrame:
    """Adds ``budget`` to a table of leaves (levels..., ``capacity``).

    ``weights[i]`` is the weight of a node at level i, from the columns of the
    levels up to it.  Works on one row per node: its size is the catalogue's."""
    up: DataFrame | None = None
    for i in range(len(levels)):
        path, parent = list(levels[:i + 1]), list(levels[:i])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("_cap")).withColumn(
            "_w", F.greatest(F.coalesce(weights[i].cast("bigint"), F.lit(0)), F.lit(0)))
        if up is None:
            nodes = nodes.withColumn("_have", budget.cast("bigint"))
        else:
            nodes = nodes.join(up, parent)
        live = F.col("_w") > 0
        order = [(~live).cast("int"), F.when(live, F.col("_cap") / F.col("_w")), F.col(levels[i])]
        w = Window.partitionBy(*parent, F.lit(0)).orderBy(*order)
        before = F.coalesce(F.sum(F.when(live, F.col("_cap"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        onward = F.sum("_w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("_fill", F.when(live, (F.col("_have") - before) / onward))
        level = F.max("_fill").over(Window.partitionBy(*parent, F.lit(0)))
        up = nodes.select(*path, F.when(live, F.least(
            F.col("_cap"), F.floor(F.greatest(F.col("_w") * level, F.lit(0.0))).cast("bigint"))).otherwise(F.lit(0))
            .alias("_have"))
    return leaves.join(up.withColumnRenamed("_have", "budget"), list(levels))


def plan(rows: DataFrame, levels: Sequence[str], weights: Sequence[Column], share: float, max_epochs: int,
         seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(leaves, starts) for rows of (id, levels..., n_tokens).

    leaves: one row per leaf with budget, ``whole`` passes and the tokens left
    for the prefix (``rest``); starts: every row with ``start``, the tokens
    before it in its leaf's last pass."""
    leaf = list(levels)
    size = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")).withColumn(
        "capacity", F.col("tokens") * max_epochs)
    total = snapshot(size, "mix-leaves")
    have = total.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    leaves = allocate(total, leaf, weights, F.floor(F.lit(float(have)) * share)).withColumn(
        "whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("bigint"))
    leaves = snapshot(leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-budgets")
    d = rows.join(leaves.select(*leaf, "n_docs", "whole", "rest"), leaf)
    d = d.withColumn("_key", _key(seed, F.col("whole") + 1, F.col("_id")))
    point = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0 ** 32
    d = d.withColumn("_range", F.floor(point * F.ceil(F.sqrt("n_docs"))))
    ranges = d.groupBy(*leaf, "_range").agg(F.sum("n_tokens").alias("_n"))
    run = Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*leaf, "_range", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*leaf, "_range").orderBy("_key", "_id", "n_tokens").rowsBetween(
        Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return leaves, d.join(ranges, [*leaf, "_range"]).withColumn("start", F.col("_before") + F.col("_in"))


def tree_rows(docs: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    """(_id, domain, lang, source, n_tokens) of every row, written once."""
    return snapshot(docs.select(
        F.col(id_col).alias("_id"), F.coalesce(domain, F.lit("none")).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("none")).alias("source"),
        n_words(F.col(text_col).cast("string")).alias("n_tokens")), "mix-rows")


def mix(rows: DataFrame, weights: Sequence[Column], share: float, max_epochs: int, seed: int = 17,
        id_col: str = "doc_id") -> DataFrame:
    """One row per (document, pass) that is taken: id, levels, ``epoch`` from 1,
    ``n_tokens``, and ``take_tokens``, fewer only for a prefix's last document."""
    _, d = plan(rows, LEVELS, weights, share, max_epochs, seed)
    some = F.col("start") < F.col("rest")
    passes = F.col("whole") + some.cast("bigint")
    d = d.where(passes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), passes)))
    last = F.col("epoch") > F.col("whole")
    return d.select(F.col("_id").alias(id_col), *LEVELS, "epoch", "n_tokens",
                    F.when(last, F.least("n_tokens", F.col("rest") - F.col("start"))).otherwise(F.col("n_tokens"))
                    .alias("take_tokens"))


def take(docs: DataFrame, domain: Column, weights: Sequence[Column], share: float, seed: int = 17,
         id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents (all columns) of one pass at most that the budgets take.

    Each leaf's prefix ends at its last taken (key, id): a table of one row per
    leaf, joined on the leaf, so the texts are not shuffled while it is small."""
    rows = tree_rows(docs, domain, id_col, text_col, lang_col, source_col)
    _, starts = plan(rows, LEVELS, weights, share, 1, seed)
    # with one pass at most, the prefix pass is the first one unless the leaf is taken whole
    ends = starts.where((F.col("whole") > 0) | (F.col("start") < F.col("rest"))).groupBy(*LEVELS).agg(
        F.max(F.struct("_key", "_id")).alias("_end"), F.max("whole").alias("_whole"))
    ends = snapshot(ends.toDF("_domain", "_lang", "_source", "_end", "_whole"), "mix-ends")
    own = docs.columns
    d = docs.withColumns({"_d": F.coalesce(domain, F.lit("none")),
                          "_l": F.coalesce(F.col(lang_col).cast("string"), F.lit("und")),
                          "_s": F.coalesce(F.col(source_col).cast("string"), F.lit("none")),
                          "_k": _key(seed, F.lit(1), F.col(id_col))})
    d = d.join(ends, (d["_d"] == ends["_domain"]) & (d["_l"] == ends["_lang"]) & (d["_s"] == ends["_source"]))
    inside = (F.col("_whole") > 0) | (F.struct(F.col("_k").alias("_key"), F.col(id_col).alias("_id")) <= F.col("_end"))
    return d.where(inside).select(*own)


# Production parameters of the registered query and of the pipeline.
SHARE, MAX_EPOCHS, SEED = 0.6, 3, 17


def domain_of(source: Column) -> Column:
    """Four domains, by the first hex digit of the source's MD5."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source.cast("binary")), 1, 1), 16, 10).cast("int") % 4).cast("string"))


def target_weights() -> list[Column]:
    """Domains 40/30/20/10; English 4, German, French and Spanish 2, others 1; sources alike."""
    d = F.col("domain")
    lang = F.when(F.col("lang") == "en", 4).when(F.col("lang").isin("de", "fr", "es"), 2).otherwise(1)
    return [F.when(d == "d0", 40).when(d == "d1", 30).when(d == "d2", 20).when(d == "d3", 10).otherwise(1), lang, F.lit(1)]


def _level_sql(i: int, weight: str) -> str:
    path, parent = ", ".join(LEVELS[:i + 1]), LEVELS[:i]
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    have = f"JOIN b{i - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN b_root"
    return f"""
n{i} AS (SELECT *, {weight} AS w FROM (SELECT {path}, CAST(sum(capacity) AS BIGINT) AS cap FROM leaves GROUP BY {path}) {have}),
f{i} AS (SELECT *, (have - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {LEVELS[i]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(w) OVER ({by} ORDER BY cap / w, {LEVELS[i]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill FROM n{i}),
b{i} AS (SELECT {path}, least(cap, CAST(floor(greatest(w * max(fill) OVER ({by}), 0.0)) AS BIGINT)) AS have FROM f{i})"""


SQL = f"""
WITH rows AS (SELECT doc_id, coalesce('d' || (instr('0123456789abcdef', substr(md5(source), 1, 1)) - 1) % 4, 'none') AS domain,
    coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens,
    CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS capacity FROM rows GROUP BY domain, lang, source),
b_root AS (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * CAST({SHARE} AS DOUBLE)) AS BIGINT) AS have FROM leaves),
{_level_sql(0, "CASE domain WHEN 'd0' THEN 40 WHEN 'd1' THEN 30 WHEN 'd2' THEN 20 WHEN 'd3' THEN 10 ELSE 1 END")},
{_level_sql(1, "CASE WHEN lang = 'en' THEN 4 WHEN lang IN ('de', 'fr', 'es') THEN 2 ELSE 1 END")},
{_level_sql(2, "1")},
cut AS (SELECT *, CASE WHEN tokens > 0 THEN have // tokens ELSE 0 END AS whole FROM leaves JOIN b2 USING (domain, lang, source)),
placed AS (SELECT *, have - whole * tokens AS rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{SEED}|' || (whole + 1) || '|' || doc_id), doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows JOIN cut USING (domain, lang, source)),
passes AS (SELECT *, unnest(range(1, CAST(whole + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) + 1)) AS epoch FROM placed)
SELECT doc_id, domain, lang, source, epoch, n_tokens,
    CAST(CASE WHEN epoch > whole THEN least(n_tokens, rest - start) ELSE n_tokens END AS BIGINT) AS take_tokens FROM passes
"""
