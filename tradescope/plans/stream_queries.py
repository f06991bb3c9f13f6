"""Queries of streaming operators on tables, and of sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.registry import query
from tradescope.streaming import events as E
from tradescope.streaming import keyed as K


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    return F.round(c, digits)


@query("str03_cdc_apply", "SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 97 <> 0")
def str03(t):
    target = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    e = t("orders").filter("o_orderkey % 89 = 0 OR o_orderkey % 97 = 0").select("o_orderkey", F.lit("X").alias("status"),
        F.lit(2).alias("seq"), (F.col("o_orderkey") % 97 == 0).alias("gone"))
    return E.apply_changes(target, e, "o_orderkey", "seq", F.col("gone"))


@query(
    "str04_change_capture",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'DELETE' WHEN o_orderkey % 89 = 0 THEN 'UPDATE' END AS op FROM orders
    WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 UNION ALL SELECT o_orderkey + 10000000, 'INSERT' FROM orders WHERE o_orderkey
    % 101 = 0""",
)
def str04(t):
    before = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.filter("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0,
        F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    after = after.unionByName(before.filter("o_orderkey % 101 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    return E.changes(before, after, "o_orderkey").select("o_orderkey", "op")


@query(
    "str05_retry",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber + 1 AS retry_count, CASE WHEN l_linenumber + 1 >= 3 THEN 'failed' ELSE
    'pending' END AS status FROM lineitem WHERE l_discount > 0.09""",
)
def str05(t):
    n = F.col("l_linenumber") + 1
    return t("lineitem").filter("l_discount > 0.09").select("l_orderkey", "l_partkey", "l_suppkey", n.alias("retry_count"),
        F.when(n >= 3, "failed").otherwise("pending").alias("status"))


@query(
    "str11_error_bursts",
    """SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTES, ts)) // 1000 AS start, count(*) FILTER (WHERE event_type = 'error') AS hits,
    count(*) AS total FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') >= 2""",
)
def str11(t):
    return E.bursts(t("events"), F.col("event_type") == "error")


@query(
    "str12_window_sentiment",
    """SELECT event_type, epoch_ms(date_trunc('hour', ts)) // 1000 AS start, count(*) AS n, round(avg(value / 250 - 1), 6) AS polarity
    FROM events GROUP BY 1, 2""",
)
def str12(t):
    return E.keyed_windows(t("events"), "event_type", "1 hour", rows().alias("n"), r(F.avg(F.col("value") / 250 - 1)).alias("polarity"))


@query(
    "str13_trending_items",
    """WITH e AS (SELECT max(ts) AS last FROM interactions), c AS (SELECT h AS hours, item_id, count(*) AS n FROM interactions, e, (VALUES (1), (24), (168)) w(h)
    WHERE ts > last - to_hours(h) GROUP BY 1, 2) SELECT hours, item_id, n FROM c QUALIFY row_number() OVER (PARTITION BY hours ORDER BY n DESC, item_id) <= 5""",
)
def str13(t):
    """The five items with most interactions in the last hour, day and week before the last one."""
    return E.trending(t("interactions"), "item_id", (1, 24, 168), 5)


@query("str13_daily_items", "SELECT item_id, epoch_ms(date_trunc('day', ts)) // 1000 AS start, count(*) AS n FROM interactions GROUP BY 1, 2")
def str13b(t):
    return E.keyed_windows(t("interactions"), "item_id", "24 hours", rows().alias("n"))


@query(
    "str15_rate_limit",
    """SELECT user_id, epoch_ms(date_trunc('minute', ts)) // 1000 AS start, count(*) AS n, count(*) - 1 AS refused FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def str15(t):
    """Users with more than one request in a minute; the tables have few."""
    return E.over_limit(t("events"), "user_id", 1, "60 seconds")


@query(
    "str16_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w
    AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts,
    event_id) AS sid FROM g) SELECT user_id, epoch_ms(date_trunc('second', min(ts))) // 1000 AS start, epoch_ms(date_trunc('second',
    max(ts))) // 1000 AS last, count(*) AS events FROM s GROUP BY user_id, sid""",
)
def str16(t):
    return E.sessions(t("events"), "user_id")


@query(
    "str19_pattern_alerts",
    """SELECT event_id, CASE WHEN line LIKE '%ERROR%' THEN 'error' ELSE 'warning' END AS alert FROM logs WHERE line LIKE '%ERROR%'
    OR line LIKE '%WARN%'""",
)
def str19(t):
    return E.pattern_alerts(t("logs"), {"error": "(?i)error|critical|exception|traceback", "warning": "WARN"}).select("event_id", "alert")


@query(
    "str20_metric_thresholds",
    """SELECT event_id, event_type AS metric, CASE WHEN value > 400 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE
    (event_type = 'view' AND value > 200) OR (event_type = 'click' AND value > 250)""",
)
def str20(t):
    limits = t("region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "view").otherwise("click").alias("event_type"),
        (200 + 50 * F.col("r_regionkey")).alias("most"))
    return t("events").join(F.broadcast(limits), "event_type").filter("value > most").select("event_id",
        F.col("event_type").alias("metric"), F.when(F.col("value") > 400, "critical").otherwise("warning").alias("severity"))


@query("str21_latest_rating", "SELECT user_id, item_id, arg_max(rating, (ts, event_id)) AS rating FROM interactions GROUP BY 1, 2")
def str21(t):
    return t("interactions").groupBy("user_id", "item_id").agg(F.max_by("rating", F.struct("ts", "event_id")).alias("rating"))


@query(
    "str22_health_rollup",
    """SELECT epoch_ms(date_trunc('hour', ts)) // 1000 AS start, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN
    1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY 1""",
)
def str22(t):
    worst = F.max(F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0))
    g = t("events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(worst.alias("w"))
    return g.select(F.unix_timestamp("h").alias("start"), F.when(F.col("w") == 2, "unhealthy").when(F.col("w") == 1,
        "degraded").otherwise("healthy").alias("status"))


@query(
    "str09_alert_cool_down",
    """WITH RECURSIVE a AS (SELECT CAST(user_id AS VARCHAR) AS stream, epoch_ms(date_trunc('second', ts)) // 1000 AS sec FROM events WHERE event_type = 'error'),
    r(stream, sec) AS (SELECT stream, min(sec) FROM a GROUP BY 1 UNION ALL SELECT r.stream, min(a.sec) FROM r JOIN a ON a.stream = r.stream AND a.sec >= r.sec + 7200 GROUP BY r.stream, r.sec)
    SELECT stream, sec AS "at" FROM r""",
)
def str09(t):
    a = t("events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("stream"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return E.cool_down_table(a, "stream", 7200)


@query(
    "str16_concurrent_sessions",
    """WITH x AS (SELECT user_id, event_type AS token, epoch_ms(date_trunc('second', ts)) // 1000 AS seq FROM events),
    g AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY user_id, token ORDER BY seq) < 172800 THEN 0 ELSE 1 END AS fresh FROM x),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g),
    s AS (SELECT user_id, token, min(seq) AS start, max(seq) + 172800 AS over FROM r GROUP BY user_id, token, run)
    SELECT a.user_id, a.token, a.start, count(*) AS active, count(*) <= 3 AS allowed FROM s a JOIN s b ON a.user_id = b.user_id AND (b.start < a.start OR b.start = a.start
    AND b.token <= a.token) AND b.over > a.start GROUP BY a.user_id, a.token, a.start""",
)
def str16b(t):
    """Kinds of events as a user's sessions, open for two days."""
    x = t("events").select("user_id", F.col("event_type").alias("token"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seq"))
    return K.concurrent_sessions_table(x, "user_id", 172_800, 3)


@query(
    "str18_live_counters",
    """WITH x AS (SELECT user_id, event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS seq FROM events),
    g AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY user_id ORDER BY seq, event_id) < 43200 THEN 0 ELSE 1 END AS fresh FROM x),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
    SELECT user_id, count(*) AS n FROM r GROUP BY user_id, run HAVING max(seq) + 43200 > epoch_ms(TIMESTAMP '2024-01-30 12:00:00') // 1000
    AND min(seq) <= epoch_ms(TIMESTAMP '2024-01-30 12:00:00') // 1000""",
)
def str18(t):
    """Counters of twelve hours that are live at noon of 30 January, as they stand in the end."""
    x = t("events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seq"))
    now = F.unix_timestamp(F.lit("2024-01-30 12:00:00"))
    found = K.expiring_counters_table(x, "user_id", ("seq", "event_id"), 43_200)
    return found.groupBy("user_id", "ends").agg(F.max("n").alias("n"), F.min("seq").alias("start")).filter((F.col("ends") > now) & (F.col("start") <= now)).select("user_id", "n")


# sources and sinks


@query("src03_record_scan", "SELECT pk, hs_code, date, round(amount, 4) AS amount FROM records WHERE date >= DATE '2001-06-01'")
def src03(t):
    return t("records").filter("date >= DATE '2001-06-01'").select("pk", "hs_code", "date", F.round("amount", 4).alias("amount"))


@query(
    "src13_outbox_poll",
    """SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber < 3 ORDER BY l_shipdate,
    l_orderkey, l_partkey, l_suppkey LIMIT 100""",
)
def src13(t):
    return t("lineitem").filter("l_linestatus = 'F' AND l_linenumber < 3").orderBy("l_shipdate", "l_orderkey", "l_partkey",
        "l_suppkey").limit(100).select("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "src15_market_bars",
    """SELECT symbol, epoch_ms(ts) // 1000 AS at, open, high, low, close, volume FROM bars QUALIFY row_number() OVER (PARTITION
    BY symbol ORDER BY ts DESC) <= 100""",
)
def src15(t):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return t("bars").withColumn("k", k).filter("k <= 100").select("symbol", F.unix_timestamp("ts").alias("at"), "open", "high", "low", "close", "volume")
