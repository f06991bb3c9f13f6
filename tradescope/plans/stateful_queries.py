"""Queries of outbox streams and of detectors that keep state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradescope.registry import query
from tradescope.streaming import detectors as D
from tradescope.streaming import events as E
from tradescope.streaming import outbox as O


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    return F.round(c, digits)


@query(
    "str01_str02_outbox_routing",
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'unrouted' END AS route, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END * o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def str01(t):
    path = t.scratch()
    outbox = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("aggregate_type"), F.col("o_totalprice").alias("total"))
    outbox.repartition(8, "id").write.parquet(f"{path}/inbox")
    handlers = {"F": lambda d: d.withColumn("total", F.col("total") * 2), "O": lambda d: d}
    O.process_outbox(t.spark, f"{path}/inbox", outbox.schema, handlers, f"{path}/done")
    done = lambda folder, route: t.spark.read.parquet(f"{path}/done/{folder}").groupBy(F.lit(route).alias("route")).agg(rows().alias("n"),
        r(F.sum("total"), 2).alias("total"))
    return done("F", "closed").union(done("O", "open")).union(done("unrouted", "unrouted"))


@query(
    "str06_cdc_lag",
    """WITH m AS (SELECT max(o_orderdate) AS now FROM orders), a AS (SELECT epoch_ms(now) // 1000 - epoch_ms(o_orderdate) // 1000
    AS age FROM orders, m WHERE o_orderstatus = 'O') SELECT count(*) AS pending, round(avg(age), 3) AS mean_age, max(age)
    AS max_age, count(*) FILTER (WHERE age > 86400 * 365) AS stuck FROM a""",
)
def str06(t):
    x = t("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    log = x.join(F.broadcast(x.agg(F.max("o_orderdate").alias("now"))))
    return O.lag_gauge(log, F.col("o_orderdate"), F.col("o_orderstatus") == "O", F.col("now"), 86400 * 365).withColumn("mean_age", r(F.col("mean_age"), 3))


_RING = "x AS (SELECT event_id, item_id, ts, price, count(*) OVER r AS kept, coalesce(abs(price - avg(price) OVER r) / nullif(stddev_pop(price) OVER r, 0), 0) AS z, price > max(price) OVER r OR price < min(price) OVER r AS outside FROM interactions WINDOW r AS (PARTITION BY item_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))"


@query(
    "str07_ring_buffer_scores",
    f"""WITH {_RING} SELECT event_id, round(z, 5) AS z, round(0.6 * least(z / 6, 1) + 0.4 * outside::INT, 5)::DOUBLE AS score FROM
    x WHERE kept >= 10""",
)
def str07(t):
    s = D.ring_scores_table(t("interactions").select("event_id", "item_id", "ts", "price"), "item_id", ("ts", "event_id"), "price")
    return s.select("event_id", r(F.col("z"), 5).alias("z"), r(F.col("score"), 5).alias("score"))


_QUICK = """s AS (SELECT *, price - lag(price) OVER (PARTITION BY item_id ORDER BY ts, event_id) AS step FROM interactions), q AS (SELECT event_id,
    count(*) OVER a = 10 AND abs(price - avg(price) OVER a) > 2 * stddev_pop(price) OVER a AS odd, coalesce(count(step) OVER b >= 19 AND abs(step) > 3 * stddev_pop(step) OVER b, false) AS jump
    FROM s WINDOW a AS (PARTITION BY item_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION
    BY item_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query("str08_quick_checks", f"WITH {_QUICK} SELECT event_id, odd, jump FROM q WHERE odd OR jump")
def str08(t):
    return D.quick_checks(t("interactions"), "item_id", ("ts", "event_id"), "price").filter("odd OR jump").select("event_id", "odd", "jump")


@query(
    "str14_failed_logins",
    """WITH x AS (SELECT *, (event_type = 'error')::INT AS f, sum((event_type IN ('signup', 'purchase'))::INT) OVER (PARTITION
    BY user_id ORDER BY ts, event_id) AS run FROM events),
    y AS (SELECT event_id, user_id, sum(f) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS failures FROM
    x) SELECT event_id, user_id, failures, failures >= 3 AS locked FROM y WHERE failures > 0""",
)
def str14(t):
    kind = F.col("event_type")
    found = D.failed_logins_table(t("events"), "user_id", ("ts", "event_id"), kind == "error", kind.isin("signup", "purchase"))
    return found.filter("failures > 0").select("event_id", "user_id", "failures", "locked")


@query(
    "str25_error_rate",
    """WITH e AS (SELECT event_type = 'error' AS hit, unnest(range(date_trunc('hour', ts) + INTERVAL 10 MINUTE * (date_part('minute',
    ts) // 10)::INT - INTERVAL 50 MINUTE, ts + INTERVAL 1 MICROSECOND, INTERVAL 10 MINUTE)) AS w FROM events)
    SELECT epoch_ms(w) // 1000 AS start, count(*) FILTER (WHERE hit) AS hits, count(*) AS total FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE hit) >= 3""",
)
def str25(t):
    return E.bursts(t("events"), F.col("event_type") == "error", "1 hour", "10 minutes", least=3)
