"""Queries of learned detectors, recommendations and forecasts (rows only: SQL cannot express them), and further text and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.operators import boundary
from tradescope.operators import models
from tradescope.operators import windows as W
from tradescope.operators.rules import login_level
from tradescope.plans.window_queries import series
from tradescope.registry import query

FEATURES = ("amount", "location", "hour")


def r(c, digits=6):
    return F.round(c, digits)


def rows():
    return F.count(F.lit(1))


def features(t):
    return t("transactions").select("transaction_id", "amount", F.col("location").cast("double").alias("location"),
        F.hour("ts").cast("double").alias("hour"), (F.col("merchant") == "error").cast("int").alias("label"))


@query("out05_isolation_forest")
def out05(t):
    return models.flagged(models.isolation_scores(features(t), "transaction_id", FEATURES), 0.05)


@query("out07_mahalanobis")
def out07(t):
    return models.flagged(models.distance_scores(features(t), "transaction_id", FEATURES), 0.1)


@query("out07_one_class_boundary")
def out07b(t):
    """Transactions beyond the boundary that leaves a tenth out, by how far."""
    scores = boundary.one_class_scores(features(t), "transaction_id", FEATURES)
    return scores.filter("score > 0").withColumn("score", F.round("score", 6))


@query("out08_reconstruction")
def out08(t):
    return models.flagged(models.reconstruction_scores(features(t), "transaction_id", FEATURES), 0.05)


@query("rsk17_fraud_model")
def rsk17(t):
    return models.fraud_probabilities(features(t), "transaction_id", FEATURES, "label")


@query("rec01_matrix_factorisation")
def rec01(t):
    return models.recommend(t("interactions"), "user_id", "item_id", "rating")


@query("fcs01_seasonal_forecast")
def fcs01(t):
    return series(t).groupBy("id").applyInPandas(models.seasonal_forecast("id", "date", "amount"), "id int, date date, forecast double, low double, high double")


@query("fcs05_backtest")
def fcs05(t):
    return series(t).groupBy("id").applyInPandas(models.backtest("id", "date", "amount"), "id int, date date, actual double, forecast double")


# text


@query(
    "txt17_span_merge",
    """WITH s AS (SELECT user_id, epoch_ms(date_trunc('second', ts)) // 1000 AS a, epoch_ms(date_trunc('second', ts)) // 1000 +
    3600 AS b, event_id FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN
    UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), g AS (SELECT *, sum(CASE WHEN before >= a THEN 0 ELSE 1 END)
    OVER (PARTITION BY user_id ORDER BY a, event_id) AS g FROM m) SELECT user_id, min(a) AS start, max(b) AS stop, count(*)
    AS parts FROM g GROUP BY user_id, g""",
)
def txt17(t):
    a = F.unix_timestamp(F.col("ts").cast("timestamp"))
    s = t("events").select("user_id", a.alias("a"), (a + 3600).alias("b"), "event_id")
    w = W.ordered(["user_id"], ["a", "event_id"])
    m = s.withColumn("before", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = m.withColumn("g", F.sum(F.when(F.col("before") >= F.col("a"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("user_id", "g").agg(F.min("a").alias("start"), F.max("b").alias("stop"), rows().alias("parts")).drop("g")


@query(
    "sec03_login_level",
    """WITH x AS (SELECT *, event_type IN ('error', 'click') AS hit FROM events), y AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE
    1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x), z AS (SELECT *, sum(hit::INT) OVER (PARTITION
    BY user_id, island ORDER BY ts, event_id) AS run FROM y), q AS (SELECT event_id, CASE WHEN hit THEN run ELSE 0 END AS run, user_id % 200 IN (3, 77) AS blocked FROM z)
    SELECT event_id, CASE WHEN blocked OR run >= 5 THEN 'high' WHEN run >= 3 THEN 'medium' ELSE 'low' END AS level, CASE WHEN blocked OR run >= 3 THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence,
    concat_ws(',', CASE WHEN run >= 3 THEN 'multiple_failed_attempts' END, CASE WHEN run >= 5 THEN 'brute_force_attempt' END, CASE WHEN blocked THEN 'blocked_ip' END) AS indicators
    FROM q WHERE run > 0 OR blocked""",
)
def sec03(t):
    """Levels of logins by failures in a row and by a list of blocked addresses."""
    hit = F.col("event_type").isin("error", "click")
    runs = W.runs_of(t("events"), ["user_id"], ["ts", "event_id"], hit).withColumn("ip", F.concat(F.lit("10.0.0."), F.col("user_id") % 200))
    listed = t.spark.createDataFrame([("10.0.0.3",), ("10.0.0.77",)], "ip string").withColumn("blocked", F.lit(True))  # a list that a caller gives
    x = runs.join(F.broadcast(listed), "ip", "left").filter((F.col("run") > 0) | F.col("blocked"))
    return x.select("event_id", *login_level(F.col("run"), F.col("blocked")))


@query("sec08_audit_query", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-24' AND event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def sec08(t):
    return t("events").filter("ts > TIMESTAMP_NTZ '2024-01-24 00:00:00' AND event_type = 'error'").orderBy(F.desc("ts"),
        F.desc("event_id")).limit(100).select("event_id")


@query(
    "rec09_personalisation",
    """WITH own AS (SELECT user_id, item_id, max(rating) AS rating FROM interactions GROUP BY 1, 2), liked AS (SELECT DISTINCT user_id,
    item_id % 8 AS category FROM own WHERE rating >= 4) SELECT o.user_id, o.item_id, CASE WHEN o.rating >= 3 THEN o.rating
    / 5.0 WHEN l.user_id IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM own o LEFT JOIN liked l ON l.user_id = o.user_id
    AND l.category = o.item_id % 8""",
)
def rec09(t):
    own = t("interactions").groupBy("user_id", "item_id").agg(F.max("rating").alias("rating")).withColumn("category", F.col("item_id") % 8)
    liked = own.filter("rating >= 4").select("user_id", "category", F.lit(True).alias("liked")).distinct()
    return own.join(liked, ["user_id", "category"], "left").select("user_id", "item_id", F.when(F.col("rating") >= 3,
        F.col("rating") / 5.0).when(F.col("liked"), 0.7).otherwise(0.5).alias("score"))


@query(
    "mon04_degradation_level",
    """WITH m AS (SELECT event_type AS model, avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (WHERE
    ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1) SELECT model, round(greatest(0, (a - b) / a), 6) AS degradation,
    greatest(0, (a - b) / a) > 0.015 AS trigger FROM m""",
)
def mon04(t):
    early = F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    m = t("events").groupBy(F.col("event_type").alias("model")).agg(F.avg(F.when(early, F.col("value"))).alias("a"),
        F.avg(F.when(~early, F.col("value"))).alias("b"))
    d = F.greatest(F.lit(0.0), (F.col("a") - F.col("b")) / F.col("a"))
    return m.select("model", r(d).alias("degradation"), (d > 0.015).alias("trigger"))
