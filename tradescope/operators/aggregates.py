"""Aggregations that more than one query needs. Global figures are one-row aggregates, never OVER ()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.operators.ordered import running_sums


def with_figures(df: DataFrame, *figures: Column) -> DataFrame:
    """Add figures over all rows to each row: a one-row aggregate, broadcast."""
    return df.join(F.broadcast(df.agg(*figures)))


def analytics(df: DataFrame, group_by: Sequence[str], metrics: Sequence[Column], mode: str = "groupby") -> DataFrame:
    """Metrics by groups, or with all subtotals (``cube``) or those of prefixes (``rollup``)."""
    grouped = {"groupby": df.groupBy, "cube": df.cube, "rollup": df.rollup}[mode]
    return grouped(*group_by).agg(*metrics)


def concentration(df: DataFrame, entity: str, value: str) -> DataFrame:
    """One row: share of the largest, Herfindahl index, Gini index, and share of the top tenth.

    Entities are summed first; their ranks are places in a range-partitioned order.
    """
    sums = df.groupBy(entity).agg(F.sum(value).alias("v"))
    ranked = running_sums(sums, ["v", entity], []).withColumnRenamed("place", "i")
    total = sums.agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    j = ranked.join(F.broadcast(total))
    share = F.col("v") / F.col("total")
    return j.agg(
        F.max(share).alias("top_share"), F.sum(share * share).alias("herfindahl"),
        (F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("v")) / F.max(F.col("n") * F.col("total"))).alias("gini"),
        F.sum(F.when(F.col("i") > F.col("n") - F.ceil(F.col("n") / 10), share).otherwise(0.0)).alias("top_decile_share"),
    )


def entity_totals(records: DataFrame, companies: DataFrame, year: int | None = None, hs_code: str | None = None) -> DataFrame:
    """company_id, total, qty, n, products and last_year of every company, for a year and a product group if given; zeros where it has no records."""
    kept = records if year is None else records.filter(F.year("date") == year)
    kept = kept if hs_code is None else kept.filter(F.col("hs_code") == hs_code)
    sums = kept.groupBy("company_id").agg(F.sum("amount").alias("total"), F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("hs_code").alias("products"), F.max(F.year("date")).alias("last_year"))
    return companies.select("company_id").join(sums, "company_id", "left").fillna({"total": 0.0, "qty": 0.0, "n": 0, "products": 0})


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int, parts: int = 64) -> DataFrame:
    """The last ``n`` rows of each key in ``order``, which must be unique within it.

    Rows are ranked within a key's ``parts``, by a hash, first: a key that holds most rows is that
    many tasks, and only ``n`` rows of each part are ranked together.
    """
    down = [F.col(c).desc() for c in order]
    some = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*down))).filter(F.col("_k") <= n).drop("_part")
    return some.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*down))).filter(F.col("_k") <= n).drop("_k")


def tier(score: Column, *levels: tuple[float, str], otherwise: str) -> Column:
    """The name of the first level that a score reaches; levels from high to low."""
    found = F.when(score >= levels[0][0], levels[0][1])
    for least, name in levels[1:]:
        found = found.when(score >= least, name)
    return found.otherwise(otherwise)


def majority(df: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """Modal label of each key, ties to the first by code point, with its share."""
    counts = df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(label, F.struct("n", F.transform(F.split(label, ""), lambda c: -F.ascii(c))))
    return counts.groupBy(*key).agg(best.alias(label), (F.max("n") / F.sum("n")).alias("agreement"))
