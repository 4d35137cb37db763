"""Mixing of sources to target weights: budgets flow down a tree of domain, language and source, leaves give token prefixes.

A node hands its budget of tokens to its children by their weights; a child takes no more than its documents hold in
``max_epochs`` epochs. What a child cannot take goes to its siblings by weight, and only what all of them together cannot
take is missing one level higher, where the node's own siblings take it. So each child gets min(capacity, weight x level) with
one level for all children of a node, which running sums over the children in the order of capacity / weight give.

A leaf with budget b and T tokens gives b // T whole epochs and then a prefix of one more: its documents in the order of a
hash of seed, epoch and id, as long as their tokens fit into what is left. The prefix is found from sums per hash range (4,096
ranges a leaf, summed before they are shuffled); only the one range in which it ends is sorted. So the rows of a leaf never
meet in a task, however large the leaf, and the texts are not shuffled at all.

Tokens are words (runs of anything but ``[\\x20\\x09-\\x0D]``). Defined results: a null text has no words, null languages or sources
are leaves of their own, weights that are not listed are ``other``; leaves without tokens or weight give nothing; rows that
repeat an id stay or go together; an empty table gives an empty table. Other columns pass through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import saved, text_or_empty

#: Leaves up to this number are sent to all tasks (about 100 bytes each); beyond, Spark joins them.
BROADCAST_LEAVES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    domains: dict[str, float] = field(default_factory=dict)
    languages: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    tokens: int | None = None  # None: as many as the input has
    max_epochs: int = 4
    seed: int = 1


LEVELS = ("domain", "lang", "source")


def _weight(column: str, weights: dict[str, float], other: float) -> Column:
    pairs = [F.lit(x) for item in sorted(weights.items()) for x in (item[0], float(item[1]))]
    listed = F.create_map(*pairs)[F.col(column)] if pairs else F.lit(None).cast("double")
    return F.coalesce(listed, F.lit(float(other)))


def _shared_out(nodes: DataFrame, parent: list[str], level: str, weights: dict[str, float], other: float) -> DataFrame:
    """(keys, budget) of the nodes of a level, from (keys, capacity, parent_budget)."""
    weighted = nodes.withColumn("weight", _weight(level, weights, other)).where("weight > 0 and capacity > 0")
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), level)
    taken = F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("capacity")
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighted.withColumn("level", (F.col("parent_budget") - taken) / left)
    levels = levels.withColumn("level", F.max("level").over(Window.partitionBy(*parent)))
    return levels.select(*parent, level, F.least(F.col("capacity").cast("double"), F.col("level") * F.col("weight")).alias("budget"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, whole, rest): whole epochs and tokens of one more, from (domain, lang, source, tokens)."""
    weights = (mix.domains, mix.languages, mix.sources)
    weighed = [_weight(level, w, mix.other) > 0 for level, w in zip(LEVELS, weights, strict=True)]
    caps = leaves.where(weighed[0] & weighed[1] & weighed[2]).withColumn("capacity", F.col("tokens") * mix.max_epochs)
    wanted = F.lit(mix.tokens) if mix.tokens is not None else F.sum("tokens")
    total = caps.agg(F.least(wanted, F.sum("capacity")).cast("double").alias("parent_budget"))
    budgets, above = None, ["_root"]
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = caps.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("_root", F.lit(0))
        up = total.withColumn("_root", F.lit(0)) if budgets is None else budgets.withColumnRenamed("budget", "parent_budget")
        budgets = _shared_out(nodes.join(up, above), above, level, weights[depth], mix.other).select(*keys, "budget")
        above = keys
    out = leaves.join(budgets, list(LEVELS)).withColumn("budget", F.floor(F.col("budget") + 1e-6))
    out = out.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")))
    return out.select(*LEVELS, "tokens", "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest"))


def _place(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def mixed_documents(
    docs: DataFrame, mix: Mix, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``docs``, each row once for each epoch it is selected in, and the columns epoch, tokens and domain after the others."""
    leaf = [F.coalesce(domain, F.lit("")).alias("_sl_domain"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_sl_{k}") for c, k in ((lang_col, "lang"), (source_col, "source")))]
    n_tokens = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint").alias("_sl_tokens")
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*names, *leaf, n_tokens, F.col(id_col).alias("_sl_id"))

    narrow = saved(keyed.select(*(F.col(f"_sl_{k}").alias(k) for k in LEVELS), F.col("_sl_tokens").alias("tokens"), F.col("_sl_id").alias("id")))
    leaves = saved(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    few = leaves.count() <= BROADCAST_LEAVES
    sized = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    plan = saved(leaf_budgets(leaves, mix))

    partial = narrow.join(sized(plan.where("rest > 0").select(*LEVELS, "whole", "rest")), list(LEVELS))
    partial = partial.withColumn("place", _place(mix.seed, F.col("whole"), F.col("id"))).withColumn("range", F.substring("place", 1, 3))
    ranges = partial.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ranges.withColumn("before", F.sum("n").over(upto) - F.col("n")).where("before <= rest and before + n > rest")
    ends = ends.groupBy(*LEVELS).agg(F.max_by(F.struct("range", "before"), "range").alias("e")).select(*LEVELS, "e.range", "e.before")
    last = partial.join(sized(ends), [*LEVELS, "range"])
    upto = Window.partitionBy(*LEVELS, "range").orderBy("place", "id")
    last = last.withColumn("sum", F.col("before") + F.sum("tokens").over(upto)).where("sum <= rest")
    last = last.groupBy(*LEVELS).agg(F.max("place").alias("cut"))
    # nothing of the last range fits: the prefix ends before it
    cuts = ends.select(*LEVELS, "range").join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("cut", "range").alias("cut"))
    plan = saved(plan.join(cuts, list(LEVELS), "left").select(*(F.col(k).alias(f"_sl_{k}") for k in LEVELS), F.col("whole").alias("_sl_whole"), F.col("rest").alias("_sl_rest"), F.col("cut").alias("_sl_cut")))

    chosen = keyed.join(sized(plan), [f"_sl_{k}" for k in LEVELS])
    place = _place(mix.seed, F.col("_sl_whole"), F.col("_sl_id"))
    in_prefix = (F.col("_sl_rest") > 0) & (F.col("_sl_cut").isNull() | (place <= F.col("_sl_cut")))
    epochs = F.sequence(F.lit(0).cast("bigint"), F.col("_sl_whole") - F.when(in_prefix, 0).otherwise(1))
    chosen = chosen.where((F.col("_sl_whole") > 0) | in_prefix).withColumn("_sl_epoch", F.explode(epochs))
    return chosen.select(*names, F.col("_sl_epoch").alias("epoch"), F.col("_sl_tokens").alias("tokens"), F.col("_sl_domain").alias("domain"))
