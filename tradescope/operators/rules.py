"""Rule tables: all rules of a table are evaluated in one pass, as an array of hits that is exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column, float]


def hits(rules: Sequence[Rule]) -> Column:
    """Array of struct(rule, confidence) of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"),
        F.lit(float(w)).alias("confidence"))) for n, c, w in rules]))


def alerts(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """A row per rule that a row meets: keys, rule, confidence."""
    return df.select(*keys, F.explode(hits(rules)).alias("h")).select(*keys, "h.rule", "h.confidence")


def weighted(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are known."""
    top = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    return top / F.nullif(sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0)), F.lit(0.0))


#: Severities of signatures, and their confidence (fixed values).
SIGNATURES = {"brute_force": "high", "unusual_traffic": "medium", "suspicious_login": "medium"}
SIGNATURE_CONFIDENCE = 0.9


def signatures(df: DataFrame, keys: Sequence[str], failed: Column, requests: Column, new_place: Column, attempts: int = 5, per_minute: int = 1000) -> DataFrame:
    """A row per signature that a row meets: more failed attempts or requests a minute than the limits, a login from a new place; unknown figures meet none."""
    met = {"brute_force": failed > attempts, "unusual_traffic": requests > per_minute, "suspicious_login": new_place}
    found = alerts(df, keys, [(name, when, SIGNATURE_CONFIDENCE) for name, when in met.items()])
    names = F.create_map(*[F.lit(v) for pair in SIGNATURES.items() for v in pair])
    return found.withColumn("severity", F.element_at(names, F.col("rule")))


def login_level(failures: Column, blocked: Column) -> tuple[Column, Column, Column]:
    """level, confidence and indicators of a login: 3 failures in a row are medium, 5 high, a blocked address high."""
    bad = F.coalesce(blocked, F.lit(False))
    level = F.when(bad | (failures >= 5), "high").when(failures >= 3, "medium").otherwise("low")
    indicators = [F.when(failures >= 3, "multiple_failed_attempts"), F.when(failures >= 5, "brute_force_attempt"), F.when(bad, "blocked_ip")]
    return level.alias("level"), F.when(level != "low", 0.8).otherwise(0.3).alias("confidence"), F.concat_ws(",", *indicators).alias("indicators")
