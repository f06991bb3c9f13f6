"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.operators import aggregates as A
from tradescope.operators import ordered as O
from tradescope.registry import query

def rows():
    """Number of rows, as an aggregate."""
    return F.count(F.lit(1))


def r(c, digits=4):
    return F.round(c, digits)


@query(
    "agg01_global_stats",
    """SELECT count(amount) AS n, round(sum(amount), 4) AS total, round(avg(amount), 4) AS mean, round(quantile_cont(amount, 0.5),
    4) AS median FROM records WHERE amount > 0""",
)
def agg01(t):
    x = t("records").filter("amount > 0").select("amount")
    figures = x.agg(F.count("amount").alias("n"), r(F.sum("amount")).alias("total"), r(F.avg("amount")).alias("mean"))
    return figures.join(F.broadcast(O.quantile_figures(x, "amount", median=0.5))).select("n", "total", "mean", r(F.col("median")).alias("median"))


@query(
    "agg02_group_sums_by_prefix",
    """SELECT substr(hs_code, 1, 3) AS hs_prefix, company_name, round(sum(amount), 4) AS total FROM records GROUP BY 1, 2 ORDER
    BY total DESC, hs_prefix, company_name LIMIT 50""",
)
def agg02(t):
    return t("records").groupBy(F.substring("hs_code", 1, 3).alias("hs_prefix"),
        "company_name").agg(r(F.sum("amount")).alias("total")).orderBy(F.desc("total"), "hs_prefix", "company_name").limit(50)


@query(
    "agg03_hs_clusters",
    """SELECT hs_code, count(DISTINCT company_id) AS companies, round(sum(amount), 4) AS total, count(*) AS n, CASE WHEN count(*)
    * 1.0 / count(DISTINCT company_id) > 15 THEN 'high' WHEN count(*) * 1.0 / count(DISTINCT company_id) > 12 THEN 'medium'
    ELSE 'low' END AS tier FROM records GROUP BY 1 HAVING count(DISTINCT company_id) > 10 ORDER BY total DESC, hs_code LIMIT
    20""",
)
def agg03(t):
    g = t("records").groupBy("hs_code").agg(F.count_distinct("company_id").alias("companies"), r(F.sum("amount")).alias("total"),
        rows().alias("n")).filter("companies > 10")
    per = F.col("n") / F.col("companies")
    return g.withColumn("tier", F.when(per > 15, "high").when(per > 12, "medium").otherwise("low")).orderBy(F.desc("total"), "hs_code").limit(20)


@query(
    "agg04_entity_totals",
    """SELECT c.company_id, coalesce(round(sum(amount), 4), 0) AS total, coalesce(sum(qty), 0) AS qty, count(pk) AS n, count(DISTINCT hs_code) AS products, max(year(date)) AS last_year
    FROM companies c LEFT JOIN records r ON r.company_id = c.company_id GROUP BY 1""",
)
def agg04(t):
    """Totals of every company over all records; those without records have zeros."""
    return A.entity_totals(t("records"), t("companies")).withColumn("total", r(F.col("total")))


@query("agg05_daily_series", "SELECT date, amount, n FROM daily")
def agg05(t):
    return t("daily")


@query(
    "agg06_pending_and_lag",
    """SELECT event_type, count(*) FILTER (WHERE event_id % 3 = 0) AS pending, count(*) FILTER (WHERE event_id % 3 <> 0) AS processed,
    max(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31')) FILTER (WHERE event_id % 3 = 0) AS oldest_s
    FROM events GROUP BY 1""",
)
def agg06(t):
    age = F.unix_timestamp(F.lit("2024-01-31 00:00:00")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    pending = F.col("event_id") % 3 == 0
    return t("events").groupBy("event_type").agg(F.count_if(pending).alias("pending"), F.count_if(~pending).alias("processed"),
        F.max(F.when(pending, age)).alias("oldest_s"))


@query(
    "agg07_outbox_groups",
    """SELECT o_orderstatus AS aggregate_type, o_orderpriority AS event_type, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS oldest,
    CAST(max(o_orderdate) AS DATE) AS newest, round(avg(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')),
    6) AS mean_age FROM orders GROUP BY 1, 2""",
)
def agg07(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").groupBy(F.col("o_orderstatus").alias("aggregate_type"),
        F.col("o_orderpriority").alias("event_type")).agg(rows().alias("n"), F.min(d).alias("oldest"), F.max(d).alias("newest"),
        r(F.avg(F.datediff(F.to_date(F.lit("2002-01-01")), d)), 6).alias("mean_age"))


@query(
    "agg08_dlq_stats",
    """SELECT l_returnflag AS target, l_linestatus AS status, count(*) AS n, count(*) FILTER (WHERE l_linenumber < 3) AS retryable
    FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2""",
)
def agg08(t):
    return t("lineitem").filter("l_discount > 0.05").groupBy(F.col("l_returnflag").alias("target"),
        F.col("l_linestatus").alias("status")).agg(rows().alias("n"), F.count_if(F.col("l_linenumber") < 3).alias("retryable"))


@query(
    "agg08_dlq_top_errors",
    """WITH l AS (SELECT 'E' || event_id % 37 AS error, event_type AS operation, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)
    SELECT error, count(*) AS n, count(*) FILTER (WHERE operation = 'error') AS failed, count(DISTINCT user_id) AS targets FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def agg08b(t):
    """The ten commonest error types of the last 24 hours."""
    x = A.with_figures(t("events"), F.max("ts").alias("end")).filter(F.col("ts") > F.col("end") - F.expr("INTERVAL 24 HOURS"))
    g = x.groupBy(F.concat(F.lit("E"), F.col("event_id") % 37).alias("error")).agg(rows().alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"),
        F.count_distinct("user_id").alias("targets"))
    return g.orderBy(F.desc("n"), "error").limit(10)


@query(
    "agg09_counts_above_quantile",
    """WITH c AS (SELECT company_id, count(*) AS n FROM records GROUP BY 1) SELECT company_id, n FROM c WHERE n > (SELECT quantile_cont(n,
    0.95) FROM c)""",
)
def agg09(t):
    c = t("records").groupBy("company_id").agg(rows().alias("n"))
    return A.with_figures(c, F.percentile("n", 0.95).alias("q")).filter("n > q").select("company_id", "n")


@query("agg10_repeated_values", "SELECT company_id, qty, count(*) AS n FROM records GROUP BY 1, 2 HAVING count(*) > 15")
def agg10(t):
    return t("records").groupBy("company_id", "qty").agg(rows().alias("n")).filter("n > 15")


@query(
    "agg11_behaviour_profile",
    """SELECT user_id, round(avg(amount), 6) AS mean, round(stddev_pop(amount), 6) AS deviation, count(DISTINCT location) AS locations,
    count(DISTINCT hour(ts)) AS hours, round(count(*) / 24.0, 6)::DOUBLE AS per_hour FROM transactions GROUP BY 1 HAVING
    count(*) >= 10""",
)
def agg11(t):
    g = t("transactions").groupBy("user_id").agg(r(F.avg("amount"), 6).alias("mean"), r(F.stddev_pop("amount"),
        6).alias("deviation"), F.count_distinct("location").alias("locations"), F.count_distinct(F.hour("ts")).alias("hours"),
        rows().alias("n"))
    return g.filter("n >= 10").withColumn("per_hour", r(F.col("n") / 24.0, 6)).drop("n")


@query(
    "agg12_behaviour_analysis",
    """WITH h AS (SELECT user_id, hour(ts) AS hour, count(*) AS n FROM transactions GROUP BY 1, 2), m AS (SELECT user_id, string_agg(CAST(hour
    AS VARCHAR), ',' ORDER BY hour) AS modes FROM (SELECT * FROM h QUALIFY n = max(n) OVER (PARTITION BY user_id)) GROUP
    BY 1) SELECT user_id, count(*) AS n, round(avg(amount), 4) AS mean, round(count(*) / 30.0, 6)::DOUBLE AS per_day, count(DISTINCT merchant) AS merchants, count(DISTINCT location) AS places,
    round(stddev_pop(amount) / avg(amount), 6) AS cv, any_value(modes) AS modes FROM transactions JOIN m USING (user_id) GROUP BY 1""",
)
def agg12(t):
    x = t("transactions")
    hours = x.groupBy("user_id", F.hour("ts").alias("hour")).agg(rows().alias("k"))
    per = hours.groupBy("user_id").agg(F.max("k").alias("top"), F.sort_array(F.collect_list(F.struct("hour", "k"))).alias("h"))
    modes = per.select("user_id", F.array_join(F.transform(F.filter("h", lambda e: e["k"] == F.col("top")),
        lambda e: e["hour"].cast("string")), ",").alias("modes"))
    figures = [rows().alias("n"), r(F.avg("amount")).alias("mean"), r(rows() / 30.0, 6).alias("per_day"), F.count_distinct("merchant").alias("merchants"),
        F.count_distinct("location").alias("places"), r(F.stddev_pop("amount") / F.avg("amount"), 6).alias("cv")]
    return x.groupBy("user_id").agg(*figures).join(modes, "user_id")


@query(
    "agg13_amount_pattern",
    """WITH z AS (SELECT user_id, abs(amount - avg(amount) OVER (PARTITION BY user_id)) / nullif(stddev_pop(amount) OVER (PARTITION
    BY user_id), 0) AS z FROM transactions) SELECT user_id, round(avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE
    AS share, round(max(z), 6) AS top FROM z GROUP BY 1""",
)
def agg13(t):
    w = Window.partitionBy("user_id")
    z = F.abs(F.col("amount") - F.avg("amount").over(w)) / F.nullif(F.stddev_pop("amount").over(w), F.lit(0.0))
    return t("transactions").select("user_id", z.alias("z")).groupBy("user_id").agg(r(F.avg(F.when(F.col("z") > 2,
        1.0).otherwise(0.0)), 6).alias("share"), r(F.max("z"), 6).alias("top"))


@query(
    "agg14_location_pattern",
    """WITH l AS (SELECT user_id, location, count(*) AS n FROM transactions GROUP BY 1, 2) SELECT user_id, count(*) AS locations,
    round(max(n) * 1.0 / sum(n), 6)::DOUBLE AS dominant, count(*) > 5 AND max(n) * 1.0 / sum(n) < 0.3 AS suspicious FROM
    l GROUP BY 1""",
)
def agg14(t):
    g = t("transactions").groupBy("user_id", "location").agg(rows().alias("n")).groupBy("user_id").agg(rows().alias("locations"),
        (F.max("n") / F.sum("n")).alias("d"))
    return g.select("user_id", "locations", r(F.col("d"), 6).alias("dominant"), ((F.col("locations") > 5) & (F.col("d") < 0.3)).alias("suspicious"))


@query(
    "agg15_hour_histogram",
    """SELECT h.hour, count(event_id) AS n FROM (SELECT unnest(range(0, 24)) AS hour) h LEFT JOIN events e ON hour(e.ts) = h.hour
    AND e.event_type = 'error' GROUP BY 1""",
)
def agg15(t):
    spine = t.spark.range(24).select(F.col("id").alias("hour"))
    counts = t("events").filter("event_type = 'error'").groupBy(F.hour(F.col("ts").cast("timestamp")).cast("long").alias("hour")).agg(rows().alias("n"))
    return spine.join(counts, "hour", "left").fillna({"n": 0})


@query(
    "agg16_threat_report",
    """SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 300) AS severe, count(DISTINCT user_id) AS users FROM
    events GROUP BY 1 ORDER BY severe DESC, event_type LIMIT 5""",
)
def agg16(t):
    return t("events").groupBy("event_type").agg(rows().alias("total"), F.count_if(F.col("value") > 300).alias("severe"),
        F.count_distinct("user_id").alias("users")).orderBy(F.desc("severe"), "event_type").limit(5)


_SEVERITY = "CASE WHEN value > 400 THEN 'critical' WHEN value > 250 THEN 'high' WHEN value > 100 THEN 'medium' ELSE 'low' END"


@query(
    "agg17_alert_summary",
    f"""WITH a AS (SELECT 'type' AS kind, event_type AS name, event_id, ts FROM events UNION ALL SELECT 'severity', {_SEVERITY}, event_id, ts FROM events
    UNION ALL SELECT 'all', 'all', event_id, ts FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY ts DESC, event_id DESC) AS k FROM a)
    SELECT kind, name, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 10) AS latest FROM k GROUP BY 1, 2""",
)
def agg17(t):
    """Numbers of alerts and the ten latest: by type, by severity and in all."""
    v = F.col("value")
    severity = F.when(v > 400, "critical").when(v > 250, "high").when(v > 100, "medium").otherwise("low")
    names = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("type", F.col("event_type")), ("severity", severity), ("all", F.lit("all")))])
    a = t("events").select("event_id", "ts", F.explode(names).alias("x")).select("event_id", "ts", "x.*")
    top = A.latest(a, ["kind", "name"], ["ts", "event_id"], 10)
    latest = top.groupBy("kind", "name").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False).alias("l"))  # ten
    return a.groupBy("kind", "name").agg(rows().alias("n")).join(latest, ["kind", "name"]).select("kind", "name", "n",
        F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("latest"))


@query(
    "agg18_severity_score",
    """SELECT user_id, CAST(sum(CASE WHEN value > 400 THEN 10 WHEN value > 250 THEN 5 WHEN value > 100 THEN 2 ELSE 0 END) AS BIGINT)
    AS score, CASE WHEN sum(CASE WHEN value > 400 THEN 10 WHEN value > 250 THEN 5 WHEN value > 100 THEN 2 ELSE 0 END) >=
    60 THEN 'critical' WHEN sum(CASE WHEN value > 400 THEN 10 WHEN value > 250 THEN 5 WHEN value > 100 THEN 2 ELSE 0 END)
    >= 30 THEN 'high' ELSE 'low' END AS tier FROM events GROUP BY 1""",
)
def agg18(t):
    v = F.col("value")
    g = t("events").groupBy("user_id").agg(F.sum(F.when(v > 400, 10).when(v > 250, 5).when(v > 100, 2).otherwise(0)).alias("score"))
    return g.withColumn("tier", A.tier(F.col("score"), (60, "critical"), (30, "high"), otherwise="low"))


@query(
    "agg19_compliance_score",
    """SELECT l_shipdate_year AS year, round(avg(ok), 6)::DOUBLE AS score, CASE WHEN avg(ok) >= 0.95 THEN 'compliant' WHEN avg(ok)
    >= 0.8 THEN 'partial' ELSE 'breach' END AS status FROM (SELECT year(l_shipdate) AS l_shipdate_year, CASE WHEN l_discount
    <= 0.08 THEN 1.0 ELSE 0.0 END AS ok FROM lineitem) GROUP BY 1""",
)
def agg19(t):
    g = t("lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.avg(F.when(F.col("l_discount") <= 0.08, 1.0).otherwise(0.0)).alias("s"))
    return g.select("year", r(F.col("s"), 6).alias("score"), A.tier(F.col("s"), (0.95, "compliant"), (0.8, "partial"), otherwise="breach").alias("status"))


@query(
    "agg20_level_and_hour",
    """SELECT split_part(line, ' - ', 2) AS level, CAST(substr(line, 12, 2) AS INTEGER) AS hour, count(*) AS n FROM logs GROUP BY
    1, 2""",
)
def agg20(t):
    return t("logs").groupBy(F.split_part("line", F.lit(" - "), F.lit(2)).alias("level"), F.substring("line", 12,
        2).cast("int").alias("hour")).agg(rows().alias("n"))


@query(
    "agg21_normalised_errors",
    """SELECT regexp_replace(regexp_replace(split_part(line, ' - ', 3), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}',
    'UUID', 'g'), '[0-9]+', 'NUM', 'g') AS message, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, message LIMIT 10""",
)
def agg21(t):
    text = F.split_part("line", F.lit(" - "), F.lit(3))
    text = F.regexp_replace(F.regexp_replace(text, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "UUID"), "[0-9]+", "NUM")
    return t("logs").groupBy(text.alias("message")).agg(rows().alias("n")).orderBy(F.desc("n"), "message").limit(10)


@query(
    "agg22_aggregate_sentiment",
    """SELECT event_type AS source, round(avg(value / 250 - 1), 6) AS polarity, CASE WHEN avg(value / 250 - 1) > 0.3 THEN 'very positive'
    WHEN avg(value / 250 - 1) > 0.1 THEN 'positive' WHEN avg(value / 250 - 1) < -0.3 THEN 'very negative' WHEN avg(value
    / 250 - 1) < -0.1 THEN 'negative' ELSE 'neutral' END AS label, count(*) AS n FROM events GROUP BY 1""",
)
def agg22(t):
    g = t("events").groupBy(F.col("event_type").alias("source")).agg(F.avg(F.col("value") / 250 - 1).alias("p"), rows().alias("n"))
    p = F.col("p")
    return g.select("source", r(p, 6).alias("polarity"), F.when(p > 0.3, "very positive").when(p > 0.1, "positive").when(p < -0.3,
        "very negative").when(p < -0.1, "negative").otherwise("neutral").alias("label"), "n")


@query(
    "agg23_overall_sentiment",
    """SELECT round(avg(m), 6) AS overall, CASE WHEN avg(m) > 0 THEN 'bullish' ELSE 'bearish' END AS mood FROM (SELECT event_type,
    avg(value / 250 - 1) AS m FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1)""",
)
def agg23(t):
    recent = t("events").filter("ts > TIMESTAMP_NTZ '2024-01-30 12:00:00'").groupBy("event_type").agg(F.avg(F.col("value") / 250 - 1).alias("m"))
    return recent.agg(F.avg("m").alias("m")).select(r(F.col("m"), 6).alias("overall"), F.when(F.col("m") > 0, "bullish").otherwise("bearish").alias("mood"))


@query("agg24_market_share", "SELECT company_name, round(100 * sum(amount) / (SELECT sum(amount) FROM records), 6) AS share FROM records GROUP BY 1")
def agg24(t):
    g = t("records").groupBy("company_name").agg(F.sum("amount").alias("v"))
    return A.with_figures(g, F.sum("v").alias("total")).select("company_name", r(100 * F.col("v") / F.col("total"), 6).alias("share"))


@query(
    "agg25_query_history",
    """SELECT event_type, round(avg(event_id % 997), 6) AS mean_ms, round(avg(value / 500), 6) AS confidence, round(avg(CASE WHEN
    event_id % 7 > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS success FROM events GROUP BY 1""",
)
def agg25(t):
    return t("events").groupBy("event_type").agg(r(F.avg(F.col("event_id") % 997), 6).alias("mean_ms"), r(F.avg(F.col("value") / 500),
        6).alias("confidence"), r(F.avg(F.when(F.col("event_id") % 7 > 0, 1.0).otherwise(0.0)), 6).alias("success"))


@query(
    "agg26_run_summary",
    """SELECT o_orderdate_year AS run, count(*) FILTER (WHERE o_orderstatus = 'O') AS passed, count(*) FILTER (WHERE o_orderstatus
    = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS skipped, count(*) AS total, round(100.0 * count(*) FILTER
    (WHERE o_orderstatus = 'O') / count(*), 6)::DOUBLE AS success FROM (SELECT *, year(o_orderdate) AS o_orderdate_year FROM
    orders) GROUP BY 1""",
)
def agg26(t):
    s = F.col("o_orderstatus")
    return t("orders").groupBy(F.year("o_orderdate").alias("run")).agg(F.count_if(s == "O").alias("passed"),
        F.count_if(s == "F").alias("failed"), F.count_if(s == "P").alias("skipped"), rows().alias("total"), r(100.0 * F.count_if(s == "O") / rows(),
        6).alias("success"))


@query(
    "agg27_completion_ratio",
    """SELECT l_orderkey, round(100.0 * count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 6)::DOUBLE AS done, CASE WHEN count(*)
    FILTER (WHERE l_linestatus <> 'F') = 0 THEN 'completed' WHEN count(*) FILTER (WHERE l_linestatus = 'F') = 0 THEN 'not started'
    ELSE 'in progress' END AS status FROM lineitem GROUP BY 1""",
)
def agg27(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("d"), rows().alias("n"))
    return g.select("l_orderkey", r(100.0 * F.col("d") / F.col("n"), 6).alias("done"), F.when(F.col("d") == F.col("n"),
        "completed").when(F.col("d") == 0, "not started").otherwise("in progress").alias("status"))


@query("agg28_entity_histogram", "SELECT c_mktsegment AS type, count(DISTINCT c_nationkey) AS unique_texts, count(*) AS n FROM customer GROUP BY 1")
def agg28(t):
    return t("customer").groupBy(F.col("c_mktsegment").alias("type")).agg(F.count_distinct("c_nationkey").alias("unique_texts"), rows().alias("n"))


@query(
    "agg29_user_preferences",
    """SELECT user_id, round(avg(rating), 6) AS mean_rating, count(DISTINCT category) FILTER (WHERE rating >= 4) AS liked, least(count(*)
    / 100.0, 1.0)::DOUBLE AS engagement, round(count(DISTINCT category) / 8.0, 6)::DOUBLE AS diversity FROM interactions
    GROUP BY 1""",
)
def agg29(t):
    return t("interactions").groupBy("user_id").agg(r(F.avg("rating"), 6).alias("mean_rating"),
        F.count_distinct(F.when(F.col("rating") >= 4, F.col("category"))).alias("liked"), F.least(rows() / 100.0, F.lit(1.0)).alias("engagement"),
        r(F.count_distinct("category") / 8.0, 6).alias("diversity"))


@query(
    "agg30_concentration",
    """WITH s AS (SELECT company_id, sum(amount) AS v FROM records GROUP BY 1), k AS (SELECT v, row_number() OVER (ORDER BY v, company_id)
    AS i, count(*) OVER () AS n, sum(v) OVER () AS total FROM s) SELECT round(max(v / total), 6) AS top_share, round(sum(v
    / total * v / total), 6) AS herfindahl, round(sum((2 * i - n - 1) * v) / max(n * total), 6) AS gini, round(sum(CASE WHEN
    i > n - ceil(n / 10.0) THEN v / total ELSE 0 END), 6) AS top_decile_share FROM k""",
)
def agg30(t):
    c = A.concentration(t("records"), "company_id", "amount")
    return c.select(*[r(F.col(x), 6).alias(x) for x in c.columns])


@query(
    "agg31_vote_consensus",
    """SELECT user_id, arg_max(event_type, (value, event_id)) AS answer, array_to_string(list_sort(list(DISTINCT event_type))[1:5],
    ',') AS risks, round(least(count(*) / 100.0, 1), 6)::DOUBLE AS confidence FROM events GROUP BY 1""",
)
def agg31(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("answer"),
        F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 5), ",").alias("risks"), r(F.least(rows() / 100.0,
        F.lit(1.0)), 6).alias("confidence"))


@query(
    "agg32_majority_label",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(n * 1.0
    / total, 6)::DOUBLE AS agreement FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION
    BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1""",
)
def agg32(t):
    return A.majority(t("events"), ["user_id"], "event_type").withColumn("agreement", r(F.col("agreement"), 6))


@query(
    "agg33_freshness_gap",
    """SELECT date_diff('second', date_trunc('second', (SELECT max(ts) FROM events WHERE event_id % 100 <> 99)), date_trunc('second',
    (SELECT max(ts) FROM events))) AS gap_s, (SELECT count(*) FROM events) - (SELECT count(*) FROM events WHERE event_id
    % 100 <> 99) AS missing""",
)
def agg33(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    replica = F.col("event_id") % 100 != 99
    return e.agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.max(F.when(replica, F.col("ts"))))).alias("gap_s"), F.count_if(~replica).alias("missing"))


@query(
    "agg34_session_counters",
    """SELECT user_id, count(*) AS interactions, epoch_ms(date_trunc('second', max(ts))) // 1000 AS last_s, arg_max(event_type,
    (ts, event_id)) AS page FROM events GROUP BY 1""",
)
def agg34(t):
    return t("events").groupBy("user_id").agg(rows().alias("interactions"),
        F.unix_timestamp(F.max(F.col("ts").cast("timestamp"))).alias("last_s"), F.max_by("event_type", F.struct("ts", "event_id")).alias("page"))


@query(
    "agg35_stage_runs",
    """SELECT o_custkey AS run, count(*) FILTER (WHERE o_orderstatus <> 'F') AS succeeded, round(avg(o_totalprice / 500000), 6)
    AS confidence, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def agg35(t):
    return t("orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("succeeded"),
        r(F.avg(F.col("o_totalprice") / 500000), 6).alias("confidence"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "agg36_analytics_request",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY CUBE (l_returnflag,
    l_linestatus)""",
)
def agg36(t):
    return A.analytics(t("lineitem"), ["l_returnflag", "l_linestatus"], [rows().alias("n"), F.sum("l_quantity").alias("qty")], "cube")


@query(
    "agg36_rollup_request",
    """SELECT year(o_orderdate) AS year, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderpriority)""",
)
def agg36_rollup(t):
    return A.analytics(t("orders").withColumn("year", F.year("o_orderdate")), ["year", "o_orderpriority"], [rows().alias("n")], "rollup")


@query(
    "agg37_impact_rollup",
    """SELECT s_nationkey, CASE WHEN bool_or(s_acctbal < -500) THEN 'high' ELSE 'low' END AS impact, CASE WHEN bool_or(s_acctbal
    < -500) THEN 30 ELSE 90 END AS days FROM supplier GROUP BY 1""",
)
def agg37(t):
    g = t("supplier").groupBy("s_nationkey").agg(F.bool_or(F.col("s_acctbal") < -500).alias("h"))
    return g.select("s_nationkey", F.when(F.col("h"), "high").otherwise("low").alias("impact"), F.when(F.col("h"), 30).otherwise(90).alias("days"))


@query(
    "agg38_audit_rollup",
    """SELECT customs_office, round(avg(CASE WHEN qty <= 45 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS compliant, CASE WHEN avg(CASE
    WHEN qty <= 45 THEN 1.0 ELSE 0.0 END) < 0.9 THEN 'urgent' ELSE 'planned' END AS priority FROM records GROUP BY 1""",
)
def agg38(t):
    g = t("records").groupBy("customs_office").agg(F.avg(F.when(F.col("qty") <= 45, 1.0).otherwise(0.0)).alias("c"))
    return g.select("customs_office", r(F.col("c"), 6).alias("compliant"), F.when(F.col("c") < 0.9, "urgent").otherwise("planned").alias("priority"))


@query(
    "agg39_group_fairness",
    """WITH g AS (SELECT lang, avg(quality) AS rate, avg(quality) FILTER (WHERE toxic = 0) AS tpr FROM labels JOIN documents USING
    (doc_id) GROUP BY 1) SELECT round(min(rate) / max(rate), 6) AS disparate_impact, round(min(tpr) / max(tpr), 6) AS equal_opportunity,
    CASE WHEN min(rate) / max(rate) >= 0.9 THEN 'fair' ELSE 'review' END AS status FROM g""",
)
def agg39(t):
    j = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    g = j.groupBy("lang").agg(F.avg("quality").alias("rate"), F.avg(F.when(F.col("toxic") == 0, F.col("quality"))).alias("tpr"))
    a = g.agg((F.min("rate") / F.max("rate")).alias("d"), (F.min("tpr") / F.max("tpr")).alias("e"))
    return a.select(r(F.col("d"), 6).alias("disparate_impact"), r(F.col("e"), 6).alias("equal_opportunity"), F.when(F.col("d") >= 0.9,
        "fair").otherwise("review").alias("status"))
