"""Mixing sources to target weights, by budgets handed down a tree.

The levels of the tree are columns, from the root's children to the leaves. A budget of tokens is handed down by weight; a
node can't take more than ``max_epochs`` times the tokens below it, and what it can't take goes to its siblings by weight, and
only what all siblings can't take goes to its parent's siblings. Each leaf fills its share with whole epochs of its documents and the
prefix of one more, in an order that is drawn anew, from the seed, for each epoch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: hex digits of the order's hash that name a stretch of a leaf's epoch: no task orders more than a stretch
STRETCH = 3


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, float] | None) -> Column:
    chosen = F.lit(None).cast("double")
    for value, weight in (weights or {}).items():
        chosen = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(chosen)
    return F.coalesce(chosen, F.lit(1.0))


def share_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``nodes`` (parent columns, ``name``, ``cap``, ``weight``, ``budget`` of the parent) with ``share``: the budget by weight, up to
    each cap, what is over going to the others by weight."""
    group = Window.partitionBy(*(parent or [F.lit(0)]))
    by_fill = group.orderBy((F.col("cap") / F.col("weight")).asc_nulls_last(), name)
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.where("weight > 0").withColumn("_level", (F.col("budget") - before) / rest)
    filled = F.least(F.col("cap"), F.col("weight") * F.greatest(F.max("_level").over(group), F.lit(0.0)))
    return nodes.withColumn("share", filled).drop("_level")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget: float, max_epochs: int
) -> DataFrame:
    """``levels, tokens, target`` of each leaf, from ``leaves`` (levels, tokens); a row for each leaf, so a small table."""
    caps = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    for level in levels:
        caps = caps.withColumn(f"_w_{level}", _weight(level, weights.get(level)))
    usable = F.lit(True)
    for level in levels:
        usable = usable & (F.col(f"_w_{level}") > 0)
    caps = caps.where(usable)
    parents, given = [], None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"_w_{level}").alias("weight"))
        nodes = nodes.withColumn("budget", F.lit(float(budget))) if given is None else nodes.join(given, parents)
        given = share_out(nodes, parents, level).select(*path, F.col("share").alias("budget"))
        parents = path
    return leaves.join(given, list(levels)).select(*levels, "tokens", F.floor("budget").cast("long").alias("target"))


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, float]],
    *,
    budget: int | float,
    max_epochs: int = 2,
    seed: int = 0,
) -> DataFrame:
    """How much to take of each document: ``doc_id, levels, n_tokens, epochs, last_tokens, taken``, one row for each of ``docs``.

    ``budget`` is a number of tokens or, below 1 as a float, a part of all there are. ``weights`` gives a level's values their
    weights, 1 where it names none; at weight 0 nothing is taken. ``epochs`` counts the whole epochs of the leaf, ``last_tokens`` the
    tokens that the prefix of one more takes of the document (the document at its end gives its first tokens only), ``taken``
    is their sum in tokens.

    ``docs`` may bring ``n_tokens``; else words are counted. A null level is the value ``unknown``. Null and empty texts have no
    tokens and are taken with 0. Rows without a doc_id, and rows that share one, are documents of their own. An empty table
    gives no rows.
    """
    if "n_tokens" not in docs.columns:
        docs = docs.withColumn("n_tokens", word_count(F.col("text")))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in levels]
    docs = stored(docs.select(F.col("doc_id").cast("long"), *named, F.col("n_tokens").cast("long")))
    leaves = stored(docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    if isinstance(budget, float) and budget < 1:
        budget = budget * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    plan = stored(leaf_budgets(leaves, levels, weights, budget, max_epochs))
    plan = plan.select(*levels, F.expr("if(tokens > 0, target div tokens, 0)").alias("epochs"), F.expr("if(tokens > 0, target % tokens, 0)").alias("rest"))

    order = F.md5(F.concat_ws("|", F.lit(seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    drawn = docs.join(plan, list(levels), "left").withColumn("order", order).withColumn("stretch", F.substring("order", 1, STRETCH))
    drawn = drawn.withColumns({"epochs": F.coalesce("epochs", F.lit(0)), "rest": F.coalesce("rest", F.lit(0))})
    stretches = drawn.groupBy(*levels, "stretch").agg(F.sum("n_tokens").alias("_n"))
    in_leaf = Window.partitionBy(*levels).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("_before", F.coalesce(F.sum("_n").over(in_leaf), F.lit(0))).drop("_n")
    in_stretch = Window.partitionBy(*levels, "stretch").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("_within", F.coalesce(F.sum("n_tokens").over(in_stretch), F.lit(0))).join(stretches, [*levels, "stretch"])
    last = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("_before") - F.col("_within")))
    placed = placed.withColumn("last_tokens", last)
    return placed.select(
        "doc_id", *levels, "n_tokens", "epochs", "last_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("last_tokens")).alias("taken")
    )
