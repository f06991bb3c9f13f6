"""Window functions. Every window has a partition; orders end in a unique column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of a key in order."""
    return Window.partitionBy(*key).orderBy(*order)


def last_n(key: Sequence[str], order: Sequence[str], n: int, current: bool = True) -> WindowSpec:
    """The last n rows up to the current one, or before it."""
    return ordered(key, order).rowsBetween(-(n - 1) if current else -n, 0 if current else -1)


def full(value: Column, w: WindowSpec, n: int) -> Column:
    """A windowed value where the window holds n rows, else null."""
    return F.when(F.count(F.lit(1)).over(w) == n, value)


def change(column: str, w: WindowSpec) -> Column:
    """Relative change from the row before."""
    before = F.lag(column).over(w)
    return (F.col(column) - before) / F.nullif(before, F.lit(0.0))


def ewm_mean(column: str, span: int, w: WindowSpec, horizon: int | None = None) -> Column:
    """Exponentially weighted mean with all weights kept: sum((1-a)^k x) / sum((1-a)^k).

    ``horizon`` rows carry all of the weight that a double can show (30 spans by default), so a
    row costs a bounded number of steps on a series of any length.
    """
    keep = 1 - 2.0 / (span + 1)
    size = horizon or 30 * span
    past = F.collect_list(F.col(column).cast("double")).over(w.rowsBetween(-(size - 1), 0))
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    folded = F.aggregate(past, start, lambda s, x: F.struct((s["v"] * keep + x).alias("v"), (s["w"] * keep + 1.0).alias("w")))
    return folded["v"] / folded["w"]


def fill(column: str, w: WindowSpec) -> Column:
    """The next known value, else the last known one."""
    ahead = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(ahead, F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def recent(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key, with ``k`` = 1 for the last."""
    latest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("k", F.row_number().over(latest)).filter(F.col("k") <= n)


def capped(df: DataFrame, key: Sequence[str], group: str, order: Sequence[Column], per_group: int, most: int) -> DataFrame:
    """At most ``per_group`` rows of each group, then ``most`` rows of each key, in order."""
    inner = df.withColumn("_g", F.row_number().over(Window.partitionBy(*key, group).orderBy(*order))).filter(F.col("_g") <= per_group)
    return inner.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= most).drop("_g")


def runs_of(df: DataFrame, key: Sequence[str], order: Sequence[str], hit: Column) -> DataFrame:
    """Add ``run``: how many hits in a row end here (0 on a row that is no hit)."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_hit", hit).withColumn("_island", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w))
    own = Window.partitionBy(*key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("run", F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(own)).drop("_hit", "_island")
