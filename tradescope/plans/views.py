"""Domain views over the base tables, as DataFrames and as SQL for the checks.

records       customs declarations: order lines with their product, company, country and office
companies     suppliers with the date of their first order
transactions  events as payments: amount, merchant and place
interactions  events as ratings of items by users
bars          hourly open, high, low, close and volume per event type
daily         amount and number of declarations per day
logs          events as lines of text
edges         pairs of companies that declare a product group on the same day more than 3 times, with that number
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.operators.joins import counted_pairs

VIEWS: dict[str, Callable[..., DataFrame]] = {}
SQL: dict[str, str] = {}


def view(name: str, sql: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        VIEWS[name], SQL[name] = f, sql
        return f

    return add


def with_views(sql: str) -> str:
    """Put the definitions of the views that ``sql`` names, and of those that they name, in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in dict.fromkeys(needed))
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    if recursive:
        return f"WITH RECURSIVE {head}, {body[14:].strip()}"
    return f"WITH {head}, {body[4:].strip()}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def item_of(props: Column) -> Column:
    """The number k of an event's properties."""
    return F.regexp_extract(props, '"k": *([0-9]+)', 1).cast("int")


@view(
    "records",
    """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pk, CAST(8000 + p_size AS VARCHAR) AS hs_code, CAST(l_shipdate AS DATE) AS date,
    l_extendedprice * (1 - l_discount) AS amount, l_quantity AS qty, 'N' || chr(CAST(65 + n_nationkey AS INTEGER)) AS country_code, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS edrpou,
    s_name AS company_name, r_name AS customs_office, s_suppkey AS company_id, l_orderkey AS order_id, l_linenumber AS line_number, p_partkey AS product_id
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey =
    s_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def records(t) -> DataFrame:
    joined = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    joined = joined.join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pk"),
            (F.lit(8000) + F.col("p_size")).cast("string").alias("hs_code"), F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), F.col("l_quantity").alias("qty"),
            F.concat(F.lit("N"), F.char(F.lit(65) + F.col("n_nationkey"))).alias("country_code"),
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("edrpou"), F.col("s_name").alias("company_name"), F.col("r_name").alias("customs_office"),
        F.col("s_suppkey").alias("company_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
            F.col("p_partkey").alias("product_id"),
    )


@view(
    "companies",
    """SELECT s_suppkey AS company_id, s_name AS company_name, s_nationkey AS nation_id, s_acctbal AS balance, min(CAST(o_orderdate
    AS DATE)) AS registration_date
    FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY s_suppkey, s_name, s_nationkey, s_acctbal""",
)
def companies(t) -> DataFrame:
    first = t("lineitem").select("l_suppkey", "l_orderkey").join(t("orders").select("o_orderkey", "o_orderdate"),
        F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_suppkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("registration_date"))
    return t("supplier").join(first, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(F.col("s_suppkey").alias("company_id"),
        F.col("s_name").alias("company_name"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"),
        "registration_date")


@view("transactions", """SELECT event_id AS transaction_id, user_id, value * 100 AS amount, ts, event_type AS merchant, CAST(floor(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) / 10) AS INTEGER) AS location FROM events""")
def transactions(t) -> DataFrame:
    return t("events").select(F.col("event_id").alias("transaction_id"), "user_id", (F.col("value") * 100).alias("amount"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("merchant"), F.floor(item_of(F.col("props")) / 10).cast("int").alias("location"))


@view("interactions", """SELECT event_id, user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS item_id, CAST(1 + floor(value / 100) AS INTEGER) AS rating, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 8 AS category, ts, event_type, value AS price FROM events""")
def interactions(t) -> DataFrame:
    item = item_of(F.col("props"))
    return t("events").select("event_id", "user_id", item.alias("item_id"), (1 + F.floor(F.col("value") / 100)).cast("int").alias("rating"),
        (item % 8).alias("category"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("price"))


@view(
    "bars",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
    FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)
def bars(t) -> DataFrame:
    at = F.struct("ts", "event_id")
    return t("events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour",
        F.col("ts").cast("timestamp")).alias("hour")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")).withColumnRenamed("hour",
        "ts")


@view("daily", "SELECT CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice * (1 - l_discount)), 4) AS amount, count(*) AS n FROM lineitem GROUP BY 1")
def daily(t) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        4).alias("amount"), F.count(F.lit(1)).alias("n"))


#: Levels of log lines by event type (fixed values).
LEVELS = {"error": "ERROR", "view": "DEBUG", "click": "INFO", "signup": "INFO", "purchase": "WARNING"}


@view(
    "logs",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view'
    THEN 'DEBUG' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END || ' - '
    || CASE WHEN event_type = 'error' THEN 'TimeoutError: request ' || event_id || ' failed with 504' ELSE event_type ||
    ' accepted with 200' END || ' user_id=' || user_id || ' ip=10.0.' || (user_id % 200) || '.' || (event_id % 250) || ' took '
    || (event_id % 997) || 'ms' AS line FROM events""",
)
def logs(t) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view",
        "DEBUG").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("TimeoutError: request "), F.col("event_id"),
        F.lit(" failed with 504"))).otherwise(F.concat(F.col("event_type"), F.lit(" accepted with 200")))
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return t("events").select("event_id", F.concat(when, F.lit(" - "), level, F.lit(" - "), message, F.lit(" user_id="),
        F.col("user_id"), F.lit(" ip=10.0."), F.col("user_id") % 200, F.lit("."), F.col("event_id") % 250, F.lit(" took "),
        F.col("event_id") % 997, F.lit("ms")).alias("line"))


#: Shared declarations that make two companies partners: more than so many (fixed value).
PARTNERS_OVER = 3


@view(
    "edges",
    f"""SELECT a.s AS src, b.s AS dst, count(*) AS weight FROM (SELECT DISTINCT p_size AS h, l_shipdate AS d, l_suppkey AS
    s FROM lineitem JOIN part ON p_partkey = l_partkey) a
    JOIN (SELECT DISTINCT p_size AS h, l_shipdate AS d, l_suppkey AS s FROM lineitem JOIN part ON p_partkey = l_partkey)
    b ON a.h = b.h AND a.d = b.d AND a.s < b.s GROUP BY a.s, b.s HAVING count(*) > {PARTNERS_OVER}""",
)
def edges(t) -> DataFrame:
    lines = t("lineitem").select("l_partkey", "l_shipdate", "l_suppkey").join(t("part").select("p_partkey", "p_size"), F.col("p_partkey") == F.col("l_partkey"))
    pairs = counted_pairs(lines, ["p_size", "l_shipdate"], "l_suppkey", PARTNERS_OVER, t("supplier").count())
    return t.stored("edges", pairs)
