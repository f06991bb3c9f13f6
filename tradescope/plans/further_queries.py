"""Further queries: sinks as projections, alert windows, lexicons, retrieval and risk reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradescope.registry import query
from tradescope.streaming import events as E


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    return F.round(c, digits)


@query(
    "str17_ratio_alerts",
    """WITH w AS (SELECT date_trunc('hour', ts) AS h, avg((event_type = 'error')::INT) AS ratio FROM events GROUP BY 1) SELECT epoch_ms(h)
    // 1000 AS start, round(ratio, 6) AS ratio FROM w WHERE ratio > 0.3""",
)
def str17(t):
    w = E.keyed_windows(t("events").withColumn("k", F.lit(1)), "k", "1 hour", F.avg((F.col("event_type") == "error").cast("int")).alias("ratio"))
    return w.filter("ratio > 0.3").select("start", r(F.col("ratio")).alias("ratio"))


@query(
    "str23_violation_bursts",
    """WITH e AS (SELECT user_id, unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOURS, ts + INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS w FROM events WHERE event_type = 'error')
    SELECT user_id, epoch_ms(w) // 1000 AS start, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 2""",
)
def str23(t):
    """Users with more than two violations in 24 hours, by windows that begin every hour."""
    found = E.keyed_windows(t("events").filter("event_type = 'error'"), "user_id", "24 hours", rows().alias("n"), slide="1 hour")
    return found.filter("n > 2")


@query(
    "str24_early_warning",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'disk' ELSE 'memory' END AS metric, 'capacity' AS prediction FROM events
    WHERE (event_type = 'view' AND value > 375) OR (event_type = 'click' AND value > 400)""",
)
def str24(t):
    return t("events").filter("(event_type = 'view' AND value > 375) OR (event_type = 'click' AND value > 400)").select("event_id",
        F.when(F.col("event_type") == "view", "disk").otherwise("memory").alias("metric"), F.lit("capacity").alias("prediction"))


@query(
    "rsk24_composite_score",
    """SELECT p_partkey, least(10, round(p_size * 0.1 * CASE WHEN p_retailprice > 1500 THEN 2.0 WHEN p_retailprice > 1200 THEN 1.5
    ELSE 1.0 END, 6))::DOUBLE AS score FROM part""",
)
def rsk24(t):
    impact = F.when(F.col("p_retailprice") > 1500, 2.0).when(F.col("p_retailprice") > 1200, 1.5).otherwise(1.0)
    return t("part").select("p_partkey", F.least(F.lit(10.0), F.round(F.col("p_size") * 0.1 * impact, 6)).alias("score"))


@query(
    "rec12_engagement",
    """SELECT user_id, category, round(0.1 * sum(rating), 6)::DOUBLE AS engagement, CASE WHEN count(*) > 10 THEN 'strong' ELSE 'weak'
    END AS interest FROM interactions GROUP BY 1, 2""",
)
def rec12(t):
    return t("interactions").groupBy("user_id", "category").agg(r(F.sum("rating") * 0.1).alias("engagement"), F.when(rows() > 10,
        "strong").otherwise("weak").alias("interest"))
