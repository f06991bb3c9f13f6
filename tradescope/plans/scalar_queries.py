"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.registry import query


@query("scl01_normalise_text", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def scl01(t):
    return t("documents").select("doc_id", F.md5(S.normalise(F.col("text"))).alias("digest"))


@query("scl02_validation_patterns", r"""WITH x AS (SELECT url, '10.0.' || page_id % 300 || CASE WHEN page_id % 7 = 0 THEN '' ELSE '.1' END AS ip, CASE page_id % 3 WHEN 0 THEN 'u' || page_id
    || '@example.org' WHEN 1 THEN 'u@' || page_id ELSE 'a b@c.de' END AS mail, CASE page_id % 4 WHEN 0 THEN '(0' || page_id || ') 12-3' WHEN 1 THEN '+' || page_id WHEN 2 THEN page_id || 'x' ELSE '+' END AS phone,
    '4000-1234 5678' || CASE page_id % 3 WHEN 0 THEN '-' ELSE '' END || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || CASE WHEN page_id % 5 = 0 THEN '9' ELSE '' END AS card,
    lpad(CAST(page_id AS VARCHAR), 5, '0') || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-6789' WHEN 2 THEN ' 6789' ELSE '-67' END AS postal FROM pages)
    SELECT count(*) FILTER (WHERE (starts_with(url, 'http://') OR starts_with(url, 'https://')) AND length(split_part(url, '://', 2)) > 0 AND NOT regexp_matches(url, '\s')) AS urls,
    count(*) FILTER (WHERE len(string_split(ip, '.')) = 4 AND TRY_CAST(string_split(ip, '.')[3] AS INTEGER) BETWEEN 0 AND 255) AS ips,
    count(*) FILTER (WHERE mail LIKE 'u%@example.org') AS emails, count(*) FILTER (WHERE length(translate(ltrim(phone, '+'), '0123456789 ()-', '')) = 0 AND length(ltrim(phone, '+')) > 0) AS phones,
    count(*) FILTER (WHERE length(regexp_replace(card, '[ -]', '', 'g')) = 16) AS cards, count(*) FILTER (WHERE length(postal) IN (5, 10)) AS postals FROM x""")
def scl02(t):
    """All six kinds, on texts of which some are nearly right."""
    k, text = F.col("page_id"), F.col("page_id").cast("string")
    zeros = lambda c, n: F.lpad(c.cast("string"), n, "0")
    given = {
        "urls": ("url", F.col("url")), "ips": ("ip", F.concat(F.lit("10.0."), k % 300, F.when(k % 7 == 0, "").otherwise(".1"))),
        "emails": ("email", F.when(k % 3 == 0, F.concat(F.lit("u"), text, F.lit("@example.org"))).when(k % 3 == 1, F.concat(F.lit("u@"), text)).otherwise("a b@c.de")),
        "phones": ("phone", F.when(k % 4 == 0, F.concat(F.lit("(0"), text, F.lit(") 12-3"))).when(k % 4 == 1, F.concat(F.lit("+"), text)).when(k % 4 == 2,
            F.concat(text, F.lit("x"))).otherwise("+")),
        "cards": ("card", F.concat(F.lit("4000-1234 5678"), F.when(k % 3 == 0, "-").otherwise(""), zeros(k % 10000, 4), F.when(k % 5 == 0, "9").otherwise(""))),
        "postals": ("postal", F.concat(zeros(k, 5), F.when(k % 4 == 0, "").when(k % 4 == 1, "-6789").when(k % 4 == 2, " 6789").otherwise("-67"))),
    }
    return t("pages").agg(*[F.count_if(S.is_valid(kind, c)).alias(name) for name, (kind, c) in given.items()])


@query(
    "scl03_occurrence_counts",
    """SELECT doc_id, CAST((length(text) - length(replace(text, '!', ''))) AS BIGINT) AS exclamations, CAST((length(text) - length(replace(text,
    '...', ''))) / 3 AS BIGINT) AS ellipses, starts_with(text, 'The') AS the_first FROM documents""",
)
def scl03(t):
    return t("documents").select("doc_id", S.occurrences(F.col("text"), "!").alias("exclamations"), S.occurrences(F.col("text"),
        "...").alias("ellipses"), F.startswith(F.col("text"), F.lit("The")).alias("the_first"))


@query(
    "scl04_number_format",
    """SELECT c_custkey, format('{:,}', CAST(trunc(c_acctbal) AS BIGINT)) AS shown, CAST(c_custkey % 100 AS VARCHAR) || '%' AS share
    FROM customer""",
)
def scl04(t):
    return t("customer").select("c_custkey", F.format_number(F.when(F.col("c_acctbal") < 0,
        F.ceil("c_acctbal")).otherwise(F.floor("c_acctbal")).cast("long"), 0).alias("shown"), F.format_string("%d%%", F.col("c_custkey") % 100).alias("share"))


@query("scl05_template", "SELECT o_orderkey, 'Order ' || o_orderkey || ' is ' || o_orderstatus || ' (' || o_orderstatus || ')' AS message FROM orders")
def scl05(t):
    values = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus"))
    return t("orders").select("o_orderkey", S.fill_template(F.lit("Order {{id}} is {{status}} ({{status}})"), values).alias("message"))


@query(
    "scl06_concat_skip_null",
    """SELECT pk, substr(concat_ws(' ', hs_code, company_name, CASE WHEN qty > 25 THEN customs_office END), 1, 2000) AS full_text
    FROM records""",
)
def scl06(t):
    return t("records").select("pk", F.substring(F.concat_ws(" ", "hs_code", "company_name", F.when(F.col("qty") > 25,
        F.col("customs_office"))), 1, 2000).alias("full_text"))


@query(
    "scl07_hashes",
    """SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 16) AS short_hash, substr(md5(text), 1, 8) AS tiny_hash
    FROM documents""",
)
def scl07(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("full_hash"), S.short_hash(F.col("text")).alias("short_hash"),
        F.substring(F.md5("text"), 1, 8).alias("tiny_hash"))


@query("scl08_parse_dates", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'on ' || strftime(o_orderdate,
    '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') || ' it' WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE
    'never' END AS s, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(d AS DATE) END AS date FROM x""")
def scl08(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    s = F.when(k == 0, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"))).when(k == 1, F.concat(F.date_format(d,
        "dd.MM.yyyy"), F.lit(" it"))).when(k == 2, F.date_format(d, "MM/dd/yyyy")).otherwise("never")
    return t("orders").select("o_orderkey", S.parse_date(s).alias("date"))


@query("scl09_log_timestamps", "SELECT event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS seconds FROM events")
def scl09(t):
    k, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    s = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2,
        F.date_format(ts, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
    return t("events").select("event_id", F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])).alias("seconds"))


@query(
    "scl10_date_parts",
    """SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS weekday, month(ts) AS month, quarter(ts) AS quarter,
    year(ts) AS year FROM events""",
)
def scl10(t):
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.weekday(ts).alias("weekday"),
        F.month(ts).alias("month"), F.quarter(ts).alias("quarter"), F.year(ts).alias("year"))


@query(
    "scl11_age",
    """SELECT company_id, date_diff('day', registration_date, DATE '2002-01-01') AS days, CAST(date_diff('day', registration_date,
    DATE '2002-01-01') AS DOUBLE) / 30 AS months FROM companies""",
)
def scl11(t):
    days = F.datediff(F.to_date(F.lit("2002-01-01")), F.col("registration_date"))
    return t("companies").select("company_id", days.cast("long").alias("days"), (days / 30).alias("months"))


@query("scl12_floor_5_minutes", "SELECT event_id, epoch_ms(time_bucket(INTERVAL 5 MINUTES, ts)) // 1000 AS start FROM events")
def scl12(t):
    return t("events").select("event_id", F.unix_timestamp(F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"]).alias("start"))


@query(
    "scl13_time_slot",
    """SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN
    hour(ts) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS slot FROM events""",
)
def scl13(t):
    return t("events").select("event_id", S.time_slot(F.col("ts").cast("timestamp")).alias("slot"))


@query(
    "scl14_recency",
    """SELECT pk, CASE WHEN d < 0 THEN 0.2 WHEN d < 7 THEN 1.0 WHEN d < 30 THEN 0.8 WHEN d < 90 THEN 0.6 WHEN d < 365 THEN 0.4 ELSE
    0.2 END::DOUBLE AS weight FROM (SELECT pk, date_diff('day', date, DATE '2001-06-30') AS d FROM records)""",
)
def scl14(t):
    return t("records").select("pk", S.recency(F.datediff(F.to_date(F.lit("2001-06-30")), F.col("date"))).alias("weight"))


@query("scl15_decay", "SELECT event_id, round(pow(0.95, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31')), 9) AS weight FROM events")
def scl15(t):
    return t("events").select("event_id", F.round(F.pow(F.lit(0.95), F.datediff(F.to_date(F.lit("2024-01-31")), F.col("ts").cast("date"))), 9).alias("weight"))


@query("scl16_log_and_round_flags", "SELECT pk, round(ln(1 + amount), 9) AS value_log, qty % 10 = 0 AS value_rounded FROM records")
def scl16(t):
    return t("records").select("pk", F.round(F.log1p("amount"), 9).alias("value_log"), (F.col("qty") % 10 == 0).alias("value_rounded"))


@query("scl17_sigmoid_clamp", "SELECT event_id, round(1 / (1 + exp(-(value - 100) / 50)), 9) AS p, greatest(0.0, least(1.0, value / 100)) AS share FROM events")
def scl17(t):
    return t("events").select("event_id", F.round(S.sigmoid((F.col("value") - 100) / 50), 9).alias("p"), S.clamp(F.col("value") / 100).alias("share"))


@query(
    "scl19_map_merge",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS priority, coalesce(CASE WHEN o_orderstatus
    = 'F' THEN 'yes' END, 'no') AS closed FROM orders""",
)
def scl19(t):
    done = F.col("o_orderstatus") == "F"
    base = F.map_from_arrays(F.array(F.lit("priority")), F.array("o_orderpriority"))
    more = F.when(done, F.map_from_arrays(F.array(F.lit("priority"), F.lit("closed")), F.array(F.lit("done"),
        F.lit("yes")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k))
    merged = F.map_concat(kept, more)
    return t("orders").select("o_orderkey", F.try_element_at(merged, F.lit("priority")).alias("priority"),
        F.coalesce(F.try_element_at(merged, F.lit("closed")), F.lit("no")).alias("closed"))


@query("scl20_json", """SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS payload FROM events""")
def scl20(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"),
        F.col("event_type").alias("type"))).alias("payload"))


@query(
    "scl22_severity",
    """SELECT event_id, CASE WHEN value / 500 >= 0.95 THEN 'critical' WHEN value / 500 >= 0.9 THEN 'high' WHEN value / 500 >= 0.75
    THEN 'medium' ELSE 'low' END AS severity FROM events""",
)
def scl22(t):
    return t("events").select("event_id", S.severity(F.col("value") / 500).alias("severity"))


@query(
    "scl23_escalation",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'executive' WHEN 1 THEN 'management' WHEN 2 THEN 'team' ELSE 'log' END AS
    level, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 24 ELSE 168 END AS hours FROM events""",
)
def scl23(t):
    level = F.element_at(F.array(*map(F.lit, S.ESCALATION)), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", S.escalation(level, 0).alias("level"), S.escalation(level, 1).alias("hours"))


@query(
    "scl24_pseudo_embedding",
    """SELECT item_id, [round(CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS INTEGER) / 255.0, 9)::DOUBLE FOR i IN range(0,
    32)] AS vector FROM benchmark""",
)
def scl24(t):
    return t("benchmark").select("item_id", F.transform(S.pseudo_embedding(F.col("text")), lambda x: F.round(x, 9)).alias("vector"))


@query(
    "scl25_url_parts",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)
    AS path FROM pages""",
)
def scl25(t):
    return t("pages").select("page_id", F.parse_url(F.col("url"), F.lit("HOST")).alias("host"), F.parse_url(F.col("url"), F.lit("PATH")).alias("path"))


@query("scl26_resource_cost", "SELECT p_partkey, round(p_size * 0.05 + p_retailprice * 0.01 + (p_partkey % 3) * 0.5, 6) AS cost FROM part")
def scl26(t):
    return t("part").select("p_partkey", F.round(S.resource_cost(F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey") % 3), 6).alias("cost"))
