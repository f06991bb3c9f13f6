"""Risk by dimensions: long factor tables against a rule table of weights and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors (fixed values): dimension, factor, weight, and how a value becomes a risk: at + slope * value, not below low, not above high.
FACTORS = [
    ("financial", "liquidity_ratio", 0.15, 2.0, -1.0, 0.0, 1.0), ("financial", "debt_to_equity", 0.20, 0.0, 0.5, None, 1.0),
    ("financial", "profit_margin", 0.15, 1.0, -1.0, 0.0, None), ("financial", "cash_flow_volatility", 0.10, 0.0, 2.0, None, 1.0),
    ("financial", "credit_rating", 0.20, 0.5, 0.0, None, None), ("financial", "market_volatility", 0.20, 0.0, 1.0, None, 1.0),
    ("operational", "system_uptime", 0.25, 1.0, -1.0, None, None), ("operational", "process_efficiency", 0.20, 1.0, -1.0, None, None),
    ("operational", "employee_turnover", 0.15, 0.0, 2.0, None, 1.0), ("operational", "supply_chain_disruption", 0.15, 0.0, 1.0, None, 1.0),
    ("operational", "cybersecurity_threats", 0.15, 0.0, 1.0, None, 1.0), ("operational", "regulatory_changes", 0.10, 0.0, 1.0, None, 1.0),
    ("compliance", "audit_findings", 0.30, 0.0, 0.1, None, 1.0), ("compliance", "regulatory_fines", 0.25, 0.0, 1e-6, None, 1.0),
    ("compliance", "policy_violations", 0.20, 0.0, 0.2, None, 1.0), ("compliance", "data_breach_incidents", 0.15, 0.0, 1 / 3, None, 1.0),
    ("compliance", "compliance_training", 0.10, 1.0, -1.0, None, None),
    ("reputational", "customer_satisfaction", 0.25, 1.0, -0.2, None, None), ("reputational", "media_mentions", 0.20, 0.0, 0.02, None, 1.0),
    ("reputational", "social_media_sentiment", 0.20, 1.0, -1.0, None, None), ("reputational", "brand_value", 0.15, 1.0, -0.1, None, None),
    ("reputational", "crisis_events", 0.20, 0.0, 0.2, None, 1.0),
    ("strategic", "market_share", 0.20, 1.0, -1.0, None, None), ("strategic", "competitive_position", 0.20, 1.0, -1.0, None, None),
    ("strategic", "innovation_index", 0.15, 1.0, -1.0, None, None), ("strategic", "talent_attraction", 0.15, 1.0, -1.0, None, None),
    ("strategic", "sustainability_score", 0.15, 1.0, -1.0, None, None), ("strategic", "geopolitical_risks", 0.15, 0.0, 1.0, None, 1.0),
]
#: Risks of credit ratings; another rating is 0.5 (fixed values).
RATINGS = {"AAA": 0.0, "AA": 0.1, "A": 0.2, "BBB": 0.4, "BB": 0.6, "B": 0.8, "CCC": 1.0}
#: Weights of dimensions, and least scores of levels (fixed values).
DIMENSIONS = {"financial": 0.25, "operational": 0.20, "compliance": 0.20, "reputational": 0.15, "strategic": 0.20}
LEVELS = [(0.8, "critical"), (0.6, "high"), (0.3, "medium")]
SHAPE = "dimension string, factor string, weight double, at double, slope double, low double, high double"


def _risk(value: Column, rating: Column) -> Column:
    """A factor's risk by its rule; a null value counts as 0, as a factor that is not given does."""
    x = F.col("at") + F.col("slope") * F.coalesce(value, F.lit(0.0))
    x = F.greatest(x, F.coalesce("low", x))
    x = F.least(x, F.coalesce("high", x))
    known = F.create_map(*[F.lit(v) for pair in RATINGS.items() for v in pair])
    return F.when(F.col("factor") == "credit_rating", F.coalesce(F.try_element_at(known, F.upper(rating)), F.lit(0.5))).otherwise(x)


def factor_importance(factors: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(entity_id, dimension, factor, risk, impact) of given factors (entity_id, factor, value, rating); impact is risk times weight.

    ``rules`` are rows like FACTORS, broadcast: a row per factor. Factors that no rule names go;
    of a factor that is given twice the largest risk counts.
    """
    table = factors.sparkSession.createDataFrame(rules or FACTORS, SHAPE)
    found = factors.join(F.broadcast(table), "factor").withColumn("risk", _risk(F.col("value"), F.col("rating")))
    one = found.groupBy("entity_id", "dimension", "factor").agg(F.max("risk").alias("risk"), F.first("weight").alias("weight"))
    return one.select("entity_id", "dimension", "factor", "risk", (F.col("risk") * F.col("weight")).alias("impact"))


def dimension_risks(factors: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(entity_id, dimension, score) for every entity and dimension: the weighted mean of its factors' risks.

    A factor that is not given counts as a value of 0, so an entity's sum is that of zeros, a
    fixed figure, and what its given factors differ from it: no row is made for what is missing.
    """
    spark = factors.sparkSession
    table = spark.createDataFrame(rules or FACTORS, SHAPE).withColumn("zero", _risk(F.lit(0.0), F.lit(None).cast("string")))
    base = table.groupBy("dimension").agg(F.sum(F.col("zero") * F.col("weight")).alias("base"), F.sum("weight").alias("total"))  # a row per dimension
    given = factor_importance(factors, rules).join(F.broadcast(table.select("factor", (F.col("zero") * F.col("weight")).alias("none"))), "factor")
    more = given.groupBy("entity_id", "dimension").agg(F.sum(F.col("impact") - F.col("none")).alias("more"))
    every = factors.select("entity_id").distinct().join(F.broadcast(base))
    return every.join(more, ["entity_id", "dimension"], "left").select("entity_id", "dimension",
        ((F.col("base") + F.coalesce("more", F.lit(0.0))) / F.col("total")).alias("score"))


def overall_risk(scores: DataFrame) -> DataFrame:
    """(entity_id, score, level) from scores of dimensions, by DIMENSIONS; another dimension weighs 0.2."""
    weights = F.create_map(*[F.lit(v) for pair in DIMENSIONS.items() for v in pair])
    w = F.coalesce(F.try_element_at(weights, F.col("dimension")), F.lit(0.2))
    s = scores.groupBy("entity_id").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))
    return s.select("entity_id", "score", risk_level(F.col("score")).alias("level"))


def risk_level(score: Column) -> Column:
    """low, medium, high or critical; a negative score, which no range holds, is critical."""
    level = F.when(score < 0, "critical")
    for least, name in LEVELS:
        level = level.when(score >= least, name)
    return level.otherwise("low")
