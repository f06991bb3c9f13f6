"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is u^(1/w): u is a fixed uniform hash of its id, w its quality weight; within a
source, larger keys come first. Whole epochs of a source are granted first and the rest of its
budget goes to the documents with the largest keys. The prefix sums need no sort of a source: a
histogram of words over key intervals shows in which interval the budget ends, and only the
documents of that one interval are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, n_words

#: Key intervals of a source's histogram.
INTERVALS = 4096
#: Up to so many sources their budgets are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_SOURCES = 20_000


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """u^(1/w) in (0, 1), from the id or, where there is none, from the text; the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")))))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    return F.pow(u, 1.0 / weight)


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size): by weight, none above ``most`` times its size.

    Sources in order of code point, null last, weigh ``cycle`` in turn. The excess of a source
    above its ceiling is shared again by weight until none is above, which is the level L with
    sum(min(weight * L, ceiling)) = share * all words. The table has a row per source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.row_number().over(every) - 1,
        F.lit(len(cycle))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * F.lit(most))
    filling = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.sum("weight").over(rest) + F.col("weight"))
    levels = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("ceiling"))
    levels = levels.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level")))).over(whole)["level"])
    return levels.select("source", "source_size", F.coalesce(F.least(F.col("final") * F.col("weight"), F.col("ceiling")), F.col("ceiling")).alias("target"))


def mix_sources(docs: DataFrame, weight: Column | None = None, seed: str = "mix", cycle: tuple[int, ...] = (5, 2,
    1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Decide how many words the mix takes of each document (doc_id, text, source).

    Returns every column of ``docs`` with size, source_size, target and taken; taken
    is size times ``times``, how often the document is taken, so a repeat counts again. A source
    takes floor(target / source_size) whole epochs; the remainder goes to documents in order of
    key, and the last of them is in if at least half of it fits. ``weight`` is a positive quality
    weight per document (null, or not positive: 1).

    Nulls: a null source is a source of its own; a null text has size 0 and takes 0; a row
    without an id is keyed by its text. Rows that repeat a doc_id share a key and are ordered by
    size and text, so a rerun gives the same multiset of rows. Empty tables give no rows. Columns
    of ``docs`` named like the results are replaced; others may have any name.
    """
    w = F.lit(1.0) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(F.lit(1.0))
    results = ["size", "source_size", "target", "taken", "times"]
    names = [c for c in docs.columns if c not in results]
    rows = docs.select(F.struct(*names).alias("row"), sampling_key(F.col("doc_id"), F.col("text"), w, seed).alias("key"), n_words("text").alias("size"))
    rows = rows.withColumn("source", F.col("row.source")).withColumn("slot", F.floor((1.0 - F.col("key")) * INTERVALS).cast("int"))
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    budgets = source_targets(slots.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, share, most)
    budgets = budgets.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    budgets = budgets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    ends = slots.join(budgets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slot")) - F.col("words"))
    last = F.max(F.when(F.col("before") <= F.col("budget"), F.struct("slot", "before")))
    plan = ends.groupBy("s", "source_size", "target", "epochs", "budget").agg(last.alias("last"))
    plan = plan.select("s", "source_size", "target", "epochs", "budget", F.col("last.slot").alias("last_slot"), F.col("last.before").alias("before"))
    ensure_checkpoint_dir(docs.sparkSession)
    plan = plan.checkpoint()
    small = plan.count() <= BROADCAST_SOURCES
    marked = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("s")))
    chosen, at_end = F.col("slot") < F.col("last_slot"), F.col("slot") == F.col("last_slot")
    order = Window.partitionBy("source", "slot").orderBy(F.col("key").desc(), "row.doc_id", "size",
        F.xxhash64("row.text")).rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("before") + F.sum("size").over(order)
    ended = marked.filter(at_end).withColumn("extra", (through - F.col("size") / 2.0 <= F.col("budget")).cast("long"))
    others = marked.filter(~at_end).withColumn("extra", chosen.cast("long"))
    times = F.col("epochs") + F.col("extra")
    return others.unionByName(ended).select("row.*", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"),
        times.cast("int").alias("times"))
