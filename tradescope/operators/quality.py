"""Data quality: checks, dimensions, profiles. One pass over the rows for any number of rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.operators.ordered import exact_quantiles


def row_errors(rules: Mapping[str, Column]) -> Column:
    """Names of the rules whose condition a row does not meet (null counts as not)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def validation(df: DataFrame, row_id: str, rules: Mapping[str, Column]) -> DataFrame:
    """Failures by rule: rule, failed, total."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("failed")) for name in rules])
    return counts.select(F.explode(pairs).alias("p"), "total").select("p.rule", "p.failed", "total")


def validation_score(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: 1 - share of invalid rows - errors per row, not below 0."""
    errors = df.select(F.size(row_errors(rules)).alias("e"))
    n = F.count(F.lit(1))
    return errors.agg(F.round(F.greatest(F.lit(0.0), 1 - F.count_if(F.col("e") > 0) / n - F.sum("e") / n), 4).alias("score"))


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns as rows: column, value (double)."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: nulls, distinct values, least, quartiles, greatest, mean, deviation."""
    v = F.col("value")
    p = unpivot(df, columns).groupBy("column").agg(
        F.count_if(v.isNull()).alias("nulls"), F.count_distinct(v).alias("distinct_values"), F.min(v).alias("low"),
            F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("deviation"),
    )
    q = exact_quantiles(unpivot(df, columns), "value", (0.25, 0.5, 0.75), by=("column",))  # a row per column
    p = p.join(F.broadcast(q), "column", "left").withColumns({n: F.col("q")[i] for i, n in enumerate(("q1", "median", "q3"))})
    return p.select("column", "nulls", "distinct_values", *[F.round(c, 4).alias(c) for c in ("low", "q1", "median", "q3", "high", "mean", "deviation")])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair, all in one aggregate: a, b, r."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}~{b}"),
        6).alias("r")) for a, b in pairs])).alias("p")).select("p.*")


def outliers(df: DataFrame, columns: Sequence[str], z: float = 3.0, width: float = 1.5) -> DataFrame:
    """Rows with a column further than ``z`` deviations, or than ``width`` ranges beyond the quartiles."""
    figures = [f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"d_{c}"))]
    quartiles = exact_quantiles(unpivot(df, columns), "value", (0.25, 0.75), by=("column",))  # a row per column
    wide = quartiles.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"q_{c}") for c in columns])
    joined = df.join(F.broadcast(df.agg(*figures).join(F.broadcast(wide))))

    def odd(c: str) -> Column:
        q, x = F.col(f"q_{c}"), F.col(c)
        return (F.abs(x - F.col(f"m_{c}")) > z * F.col(f"d_{c}")) | (x < q[0] - width * (q[1] - q[0])) | (x > q[1] + width * (q[1] - q[0]))

    return joined.filter(reduce(lambda a, b: a | b, [odd(c) for c in columns])).select(*df.columns)
