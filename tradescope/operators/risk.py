"""Risk and fraud: profiles, rules, behaviour, network and ensemble scores, company risk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.operators import rules

#: What a rule of a severity weighs (fixed values).
SEVERITIES = {"low": 0.3, "medium": 0.6, "high": 0.9}
#: Weights of the methods of the fraud ensemble (fixed values).
FRAUD_WEIGHTS = {"isolation": 0.15, "forest": 0.20, "boosted": 0.20, "leaf_boosted": 0.15, "rules": 0.10, "behaviour": 0.10, "network": 0.10}


def profiles(history: DataFrame) -> DataFrame:
    """Users as their transactions (user_id, amount, location, ts) show them: mean, deviation, places, hours."""
    return history.groupBy("user_id").agg(F.avg("amount").alias("mean_amount"), F.stddev_pop("amount").alias("sd_amount"),
        F.collect_set("location").alias("places"), F.collect_set(F.hour("ts")).alias("hours"))


def last_hour(transactions: DataFrame) -> DataFrame:
    """Add ``in_hour``: the user's transactions in the hour up to each, itself included."""
    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-3599, 0)
    return transactions.withColumn("in_hour", F.count(F.lit(1)).over(w))


def fraud_rules(large: float = 10_000, round_over: float = 5_000, often: int = 5, times_mean: float = 3.0) -> list[tuple[str, Column, str]]:
    """(name, condition, severity) over transactions with a profile and ``in_hour``."""
    amount = F.col("amount")
    return [
        ("large amount", amount > large, "medium"),
        ("new place", F.size("places").isNotNull() & ~F.array_contains("places", F.col("location")), "medium"),
        ("often", F.col("in_hour") > often, "high"),
        ("round amount", (amount > round_over) & (F.round(amount).cast("long") % 1000 == 0), "low"),
        ("at night", F.hour("ts").between(2, 5), "medium"),
        ("far over mean", amount > times_mean * F.col("mean_amount"), "high"),
    ]


def rule_score(found: list[tuple[str, Column, str]]) -> tuple[Column, Column]:
    """Names of the rules that hold, and the mean weight of their severities (0 if none does)."""
    hits = rules.hits([(name, condition, SEVERITIES[severity]) for name, condition, severity in found])
    total = F.aggregate(hits, F.lit(0.0), lambda t, h: t + h["confidence"])
    return F.array_join(F.transform(hits, lambda h: h["rule"]), ","), F.coalesce(total / F.nullif(F.size(hits), F.lit(0)), F.lit(0.0))


def behaviour_score(usual: float = 2.0) -> Column:
    """Share of four anomalies, of amount, place, hour and frequency; 0.5 without a profile."""
    odd = [
        F.abs(F.col("amount") - F.col("mean_amount")) / F.greatest("sd_amount", F.lit(1.0)) > 3,
        ~F.array_contains("places", F.col("location")),
        ~F.array_contains("hours", F.hour("ts")),
        F.col("in_hour") > 3 * usual,
    ]
    return F.when(F.col("mean_amount").isNull(), 0.5).otherwise(sum((F.coalesce(c, F.lit(False)).cast("int") for c in odd), F.lit(0)) / 4.0)


def network_scores(pairs: DataFrame) -> DataFrame:
    """(user_id, merchant, score): share of a busy user, a rare merchant, and no neighbour in common.

    ``pairs`` (user_id, merchant) are a two-sided graph; centralities are degrees over all other nodes.
    """
    e = pairs.select(F.concat(F.lit("u:"), F.col("user_id")).alias("u"), F.concat(F.lit("m:"), F.col("merchant")).alias("m"), "user_id", "merchant").distinct()
    degree = lambda c: e.groupBy(c).agg(F.count(F.lit(1)).alias(f"d_{c}"))
    nodes = degree("u").agg(F.count(F.lit(1)).alias("users")).join(degree("m").agg(F.count(F.lit(1)).alias("merchants")))
    both = e.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("m").alias("a"),
        F.col("u").alias("b")))).alias("x")).select("x.*")
    common = e.join(both.select(F.col("a").alias("u"), F.col("b").alias("c")), "u").join(both.select(F.col("a").alias("m"),
        F.col("b").alias("c")), ["m", "c"]).select("u", "m").distinct().withColumn("common", F.lit(True))
    j = e.join(degree("u"), "u").join(degree("m"), "m").join(F.broadcast(nodes)).join(common, ["u", "m"], "left")
    others = F.nullif(F.col("users") + F.col("merchants") - 1, F.lit(0))
    flags = [F.col("d_u") / others > 0.8, F.col("d_m") / others < 0.1, F.col("common").isNull()]
    return j.select("user_id", "merchant", (sum((f.cast("int") for f in flags), F.lit(0)) / 3.0).alias("score"))


def ensemble(methods: Mapping[str, Column], weights: Mapping[str, float] = FRAUD_WEIGHTS) -> Column:
    """Weighted mean of the methods that are at hand, by name."""
    return rules.weighted([(column, weights[name]) for name, column in methods.items()])


def company_period_risk(alerts: Column, severe: Column, age_days: Column, volume: Column) -> Column:
    """0 to 100 of a company in a period: 30 for alerts (ten are full), 20 for the share of severe ones, 25 for an age under a year, 25 for volume (10 million is full)."""
    share = lambda x, full: F.least(F.coalesce(x, F.lit(0.0)) / full, F.lit(1.0))
    return 30 * share(alerts, 10) + 20 * F.coalesce(severe / F.nullif(alerts, F.lit(0)), F.lit(0.0)) + 25 * F.when(age_days < 365,
        1.0).otherwise(0.0) + 25 * share(volume, 1e7)
