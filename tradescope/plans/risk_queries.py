"""Queries of risk and fraud scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators import models as M
from tradescope.operators import ordered as O
from tradescope.operators import aggregates as A
from tradescope.operators import risk as K
from tradescope.operators import rules
from tradescope.registry import query


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    return F.round(c, digits)


_ALERTS = """a AS (SELECT pk, company_id, date, amount, rule, confidence FROM (SELECT *, 'bulk' AS rule, 0.6 AS confidence FROM records WHERE qty = 50 UNION ALL SELECT *, 'large', 0.95 FROM records WHERE amount > 90000 UNION ALL SELECT *, 'cheap', 0.8 FROM records WHERE amount / qty < 950))"""
_SEVERITY = "CASE WHEN confidence >= 0.95 THEN 'critical' WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.75 THEN 'medium' ELSE 'low' END"


def record_alerts(t):
    found = [("bulk", F.col("qty") == 50, 0.6), ("large", F.col("amount") > 90000, 0.95), ("cheap", F.col("amount") / F.col("qty") < 950, 0.8)]
    return rules.alerts(t("records"), ["pk", "company_id", "date", "amount"], found).withColumn("severity", S.severity(F.col("confidence")))


@query(
    "rsk02_high_frequency",
    """WITH g AS (SELECT company_id, date, count(*) AS n FROM records GROUP BY 1, 2) SELECT company_id, date, n FROM g WHERE n >=
    3 AND n > (SELECT quantile_cont(n, 0.95) FROM g)""",
)
def rsk02(t):
    g = t("records").groupBy("company_id", "date").agg(rows().alias("n"))
    return A.with_figures(g, F.percentile("n", 0.95).alias("q")).filter("n >= 3 AND n > q").drop("q")


@query(
    "rsk03_value_spike",
    """WITH m AS (SELECT company_id, date_trunc('month', date)::DATE AS month, round(sum(amount), 4) AS s FROM records GROUP BY
    1, 2), c AS (SELECT *, s / lag(s) OVER (PARTITION BY company_id ORDER BY month) - 1 AS change FROM m) SELECT company_id,
    month, round(change, 6) AS change FROM c WHERE change > 2""",
)
def rsk03(t):
    m = t("records").groupBy("company_id", F.trunc("date", "month").alias("month")).agg(r(F.sum("amount"), 4).alias("s"))
    change = F.col("s") / F.lag("s").over(Window.partitionBy("company_id").orderBy("month")) - 1
    return m.withColumn("change", change).filter("change > 2").select("company_id", "month", r(F.col("change")).alias("change"))


@query("rsk05_repeated_values", "SELECT company_id, qty, hs_code, count(*) AS n, 0.75 AS confidence FROM records GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def rsk05(t):
    return t("records").groupBy("company_id", "qty", "hs_code").agg(rows().alias("n")).filter("n >= 3").withColumn("confidence", F.lit(0.75))


@query(
    "rsk07_alert_assembly",
    f"""WITH {_ALERTS}, s AS (SELECT *, {_SEVERITY} AS severity FROM a) SELECT pk, rule, confidence::DOUBLE AS confidence, severity,
    CASE severity WHEN 'critical' THEN 'block and investigate' WHEN 'high' THEN 'review by an expert' WHEN 'medium' THEN
    'manual check' ELSE 'watch' END AS recommendation, rule || ' alert of company ' || company_id AS title FROM s""",
)
def rsk07(t):
    a = record_alerts(t)
    return a.select("pk", "rule", "confidence", "severity", S.escalation(F.col("severity"), 2).alias("recommendation"),
        F.concat("rule", F.lit(" alert of company "), "company_id").alias("title"))


@query(
    "rsk09_company_risk_period",
    f"""WITH {_ALERTS}, g AS (SELECT company_id, sum(amount) AS volume, max(date) AS last FROM records WHERE year(date) =
    1999 GROUP BY 1), n AS (SELECT company_id, count(*) AS alerts, count(*) FILTER (WHERE confidence >= 0.9) AS severe FROM
    a WHERE year(date) = 1999 GROUP BY 1),
    s AS (SELECT company_id, 30 * least(coalesce(alerts, 0) / 10.0, 1) + 20 * coalesce(severe * 1.0 / nullif(alerts, 0),
    0) + 25 * coalesce((date_diff('day', registration_date, last) < 365)::INT, 0) + 25 * least(volume / 1e7, 1) AS score
    FROM g LEFT JOIN n USING (company_id) JOIN companies USING (company_id))
    SELECT company_id, round(score, 4)::DOUBLE AS score, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 50 THEN 'high'
    WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM s""",
)
def rsk09(t):
    g = t("records").filter("year(date) = 1999").groupBy("company_id").agg(F.sum("amount").alias("volume"), F.max("date").alias("last"))
    n = record_alerts(t).filter("year(date) = 1999").groupBy("company_id").agg(rows().alias("alerts"), F.count_if(F.col("confidence") >= 0.9).alias("severe"))
    j = g.join(n, "company_id", "left").join(t("companies").select("company_id", "registration_date"), "company_id")
    score = K.company_period_risk(F.col("alerts"), F.col("severe"), F.datediff("last", "registration_date"), F.col("volume"))
    return j.select("company_id", r(score, 4).alias("score"), A.tier(score, (70, "critical"), (50, "high"), (30, "medium"), otherwise="low").alias("level"))


@query(
    "rsk10_alert_drill_down",
    f"""WITH {_ALERTS}, k AS (SELECT company_id, string_agg(pk || ':' || rule, ',' ORDER BY date DESC, pk, rule) AS related,
    count(*) AS shown FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY date DESC, pk, rule)
    <= 10) GROUP BY 1),
    c AS (SELECT company_id, count(*) AS n, round(avg(amount), 4) AS mean, count(DISTINCT hs_code) AS products FROM records
    GROUP BY 1), y AS (SELECT company_id, string_agg(year || '=' || n, ',' ORDER BY year) AS history FROM (SELECT company_id,
    year(date) AS year, count(*) AS n FROM records GROUP BY 1, 2) GROUP BY 1)
    SELECT company_id, related, shown, n, mean, products, history FROM k JOIN c USING (company_id) JOIN y USING (company_id)""",
)
def rsk10(t):
    a, x = record_alerts(t), t("records")
    newest = Window.partitionBy("company_id").orderBy(F.desc("date"), "pk", "rule")
    k = a.withColumn("k", F.row_number().over(newest)).filter("k <= 10").groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("k",
        F.concat_ws(":", "pk", "rule").alias("v")))).alias("l"))
    c = x.groupBy("company_id").agg(rows().alias("n"), r(F.avg("amount"), 4).alias("mean"), F.count_distinct("hs_code").alias("products"))
    y = x.groupBy("company_id",
        F.year("date").alias("year")).agg(rows().alias("n")).groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("year", "n"))).alias("h"))
    history = F.array_join(F.transform("h", lambda v: F.concat(v["year"].cast("string"), F.lit("="), v["n"].cast("string"))), ",")
    return k.join(c, "company_id").join(y, "company_id").select("company_id", F.array_join("l.v", ",").alias("related"),
        F.size("l").cast("long").alias("shown"), "n", "mean", "products", history.alias("history"))


@query(
    "rsk11_pattern_flags",
    """WITH m AS (SELECT hs_code, quantile_cont(amount / qty, 0.5) AS med FROM records GROUP BY 1), c AS (SELECT company_id,
    year(date) AS y, count(*) AS n FROM records GROUP BY 1, 2),
    f AS (SELECT pk, concat_ws(',', CASE WHEN amount / qty < 0.65 * med THEN 'dumping' END, CASE WHEN date_diff('day', registration_date,
    date) < 30 THEN 'young firm' END, CASE WHEN customs_office = 'AFRICA' THEN 'listed office' END, CASE WHEN n = 1 THEN
    'one shot' END,
    CASE WHEN hs_code LIKE '804%' AND amount / qty < 1000 THEN 'cheap luxury' END) AS flags FROM records r JOIN m USING (hs_code)
    JOIN c ON c.company_id = r.company_id AND c.y = year(r.date) JOIN companies k ON k.company_id = r.company_id) SELECT
    pk, flags FROM f WHERE flags <> ''""",
)
def rsk11(t):
    x, price = t("records").withColumn("y", F.year("date")), F.col("amount") / F.col("qty")
    m = O.exact_quantiles(x, price, (0.5,), by=("hs_code",)).select("hs_code", F.col("q")[0].alias("med"))
    c = x.groupBy("company_id", "y").agg(rows().alias("n")).join(t("companies").select("company_id", "registration_date"), "company_id")
    h = rules.hits([
        ("dumping", price < 0.65 * F.col("med"), 0.9), ("young firm", F.datediff("date", "registration_date") < 30,
            0.95), ("listed office", F.col("customs_office") == "AFRICA", 0.75),
        ("one shot", F.col("n") == 1, 0.9), ("cheap luxury", F.startswith(F.col("hs_code"), F.lit("804")) & (price < 1000), 0.75),
    ])
    return x.join(m, "hs_code").join(c, ["company_id", "y"]).withColumn("h", h).filter(F.size("h") > 0).select("pk", F.array_join("h.rule", ",").alias("flags"))


@query(
    "rsk12_insight_texts",
    f"""WITH {_ALERTS}, z AS (SELECT avg(amount) AS m, stddev_pop(amount) AS d, max(amount) AS most FROM records), l AS (SELECT
    company_name, round(sum(amount), 2) AS s FROM records GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT 'top z ' || printf('%.3f', (most - m) / d) AS text FROM z UNION ALL SELECT 'critical ' || count(*) FROM a WHERE
    confidence >= 0.95 UNION ALL SELECT 'leader ' || company_name FROM l""",
)
def rsk12(t):
    x = t("records")
    z = x.agg(((F.max("amount") - F.avg("amount")) / F.stddev_pop("amount")).alias("z")).select(F.format_string("top z %.3f", "z").alias("text"))
    critical = record_alerts(t).agg(F.count_if(F.col("confidence") >= 0.95).alias("n")).select(F.concat(F.lit("critical "), "n"))
    leader = x.groupBy("company_name").agg(r(F.sum("amount"), 2).alias("s")).orderBy(F.desc("s"),
        "company_name").limit(1).select(F.concat(F.lit("leader "), "company_name"))
    return z.union(critical).union(leader)


_CUT = "TIMESTAMP '2024-01-20'"
_FRAUD = f"""p AS (SELECT user_id, avg(amount) AS m, stddev_pop(amount) AS d, list_distinct(list(location)) AS places, list_distinct(list(hour(ts)))
    AS hours FROM transactions WHERE ts < {_CUT} GROUP BY 1),
    h AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 3599 SECONDS
    PRECEDING AND CURRENT ROW) AS in_hour FROM transactions),
    x AS (SELECT h.*, p.m, p.d, p.places, p.hours FROM h LEFT JOIN p USING (user_id) WHERE ts >= {_CUT}),
    f AS (SELECT *, list_filter([CASE WHEN amount > 10000 THEN 'large amount' END, CASE WHEN NOT list_contains(places, location)
    THEN 'new place' END, CASE WHEN in_hour > 5 THEN 'often' END, CASE WHEN amount > 5000 AND CAST(round(amount) AS BIGINT)
    % 1000 = 0 THEN 'round amount' END,
    CASE WHEN hour(ts) BETWEEN 2 AND 5 THEN 'at night' END, CASE WHEN amount > 3 * m THEN 'far over mean' END], lambda v: v IS NOT NULL) AS hit FROM x),
    g AS (SELECT *, coalesce(list_avg(list_transform(hit, lambda v: CASE WHEN v IN ('often', 'far over mean') THEN 0.9 WHEN
    v = 'round amount' THEN 0.3 ELSE 0.6 END)), 0) AS rule_score,
    CASE WHEN m IS NULL THEN 0.5 ELSE (coalesce(abs(amount - m) / greatest(d, 1) > 3, false)::INT + (NOT list_contains(places,
    location))::INT + (NOT list_contains(hours, hour(ts)))::INT + (in_hour > 6)::INT) / 4.0 END AS behaviour FROM f)"""
_NETWORK = """e AS (SELECT DISTINCT user_id, merchant FROM transactions), nodes AS (SELECT count(DISTINCT user_id) + count(DISTINCT merchant) - 1 AS n FROM e),
    w AS (SELECT user_id, merchant, ((count(*) OVER (PARTITION BY user_id)) * 1.0 / n > 0.8)::INT AS a, ((count(*) OVER (PARTITION
    BY merchant)) * 1.0 / n < 0.1)::INT AS b FROM e, nodes), net AS (SELECT user_id, merchant, (a + b + 1) / 3.0 AS network
    FROM w)"""


def fraud_table(t):
    """Transactions from the cut on, with the profiles of the time before."""
    cut = F.expr("TIMESTAMP '2024-01-20 00:00:00'")
    x = t("transactions")
    return K.last_hour(x).filter(F.col("ts") >= cut).join(K.profiles(x.filter(F.col("ts") < cut)), "user_id", "left")


@query(
    "rsk13_fraud_rules",
    f"""WITH {_FRAUD} SELECT transaction_id, array_to_string(hit, ',') AS rules, round(rule_score, 6)::DOUBLE AS score FROM g WHERE
    len(hit) > 0""",
)
def rsk13(t):
    names, score = K.rule_score(K.fraud_rules())
    return fraud_table(t).select("transaction_id", names.alias("rules"), r(score).alias("score")).filter("rules <> ''")


@query("rsk14_behaviour_score", f"WITH {_FRAUD} SELECT transaction_id, behaviour::DOUBLE AS score FROM g")
def rsk14(t):
    return fraud_table(t).select("transaction_id", K.behaviour_score().alias("score"))


@query("rsk15_network_score", f"WITH {_NETWORK} SELECT user_id, merchant, round(network, 6)::DOUBLE AS score FROM net")
def rsk15(t):
    return K.network_scores(t("transactions")).withColumn("score", r(F.col("score")))


def own_methods(t):
    """Recent transactions with the scores that need no model: rules, behaviour and network."""
    _, rule = K.rule_score(K.fraud_rules())
    x = fraud_table(t).join(K.network_scores(t("transactions")).withColumnRenamed("score", "network"), ["user_id", "merchant"])
    return x.select("transaction_id", rule.alias("rules"), K.behaviour_score().alias("behaviour"), "network")


def with_alert(x, methods):
    score = r(K.ensemble({m: F.col(m) for m in methods}), 5)
    return x.select("transaction_id", score.alias("score"), A.tier(score, (0.6000001, "critical"), (0.5000001, "high"), otherwise="none").alias("alert"))


@query(
    "rsk16_rule_ensemble",
    f"""WITH {_FRAUD}, {_NETWORK}, s AS (SELECT transaction_id, round((rule_score + behaviour + network) / 3, 5) AS score FROM g JOIN net USING (user_id, merchant))
    SELECT transaction_id, score::DOUBLE AS score, CASE WHEN score > 0.6 THEN 'critical' WHEN score > 0.5 THEN 'high' ELSE 'none' END AS alert FROM s""",
)
def rsk16b(t):
    """The methods that need no model, weighed alike."""
    return with_alert(own_methods(t), ("rules", "behaviour", "network"))


@query("rsk16_fraud_ensemble")
def rsk16(t):
    """All seven methods: models learn from the transactions before the cut and judge those after it."""
    columns = ["amount", "location", "hour"]
    x = t("transactions").select("transaction_id", "amount", F.col("location").cast("double").alias("location"), F.hour("ts").cast("double").alias("hour"),
        (F.col("merchant") == "error").cast("int").alias("label"), (F.col("ts") >= F.expr("TIMESTAMP '2024-01-20 00:00:00'")).alias("new"))
    learned = M.fraud_probabilities(x.filter("new"), "transaction_id", columns, "label", x.filter("NOT new")).drop("label")
    alone = M.isolation_scores(x, "transaction_id", columns).withColumnRenamed("score", "isolation")
    joined = own_methods(t).join(learned, "transaction_id").join(alone, "transaction_id")
    return with_alert(joined, K.FRAUD_WEIGHTS)


@query(
    "rsk18_pattern_scan",
    """WITH l AS (SELECT * FROM transactions WHERE ts > (SELECT max(ts) FROM transactions) - INTERVAL 1 DAY), c AS (SELECT count(*) AS n FROM l),
    p AS (SELECT 'amount' AS pattern, CASE WHEN amount > 30000 THEN 'large' WHEN amount > 5000 THEN 'usual' ELSE 'small'
    END AS value FROM l UNION ALL SELECT 'place', CAST(location AS VARCHAR) FROM l UNION ALL SELECT 'hour', CAST(hour(ts)
    AS VARCHAR) FROM l)
    SELECT pattern, value, count(*) AS n, round(count(*) * 1.0 / any_value(c.n), 6)::DOUBLE AS share FROM p, c WHERE c.n >= 50 GROUP BY 1, 2""",
)
def rsk18(t):
    x = A.with_figures(t("transactions"), F.max("ts").alias("last")).filter(F.col("ts") > F.col("last") - F.expr("INTERVAL 1 DAY"))
    size = A.tier(F.col("amount"), (30000.0000001, "large"), (5000.0000001, "usual"), otherwise="small")
    pairs = [("amount", size), ("place", F.col("location").cast("string")), ("hour", F.hour("ts").cast("string"))]
    p = x.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), v.alias("value")) for n,
        v in pairs])).alias("p")).select("p.*").groupBy("pattern", "value").agg(rows().alias("n"))
    return p.join(F.broadcast(x.agg(rows().alias("all")))).filter("all >= 50").select("pattern", "value", "n", r(F.col("n") / F.col("all")).alias("share"))


_LEVELS = """q AS (SELECT company_id, least(1.0, sum(amount) / 5e7) AS score FROM records GROUP BY 1), v AS (SELECT company_id, score, CASE WHEN round(score, 6) >= 0.8 THEN 'critical' WHEN round(score, 6) >= 0.6 THEN 'high' WHEN round(score, 6) >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM q)"""


def company_levels(t):
    score = r(F.least(F.lit(1.0), F.sum("amount") / 5e7))
    return t("records").groupBy("company_id").agg(score.alias("score")).withColumn("level", A.tier(F.col("score"),
        (0.8, "critical"), (0.6, "high"), (0.3, "medium"), otherwise="low"))


@query(
    "rsk21_risk_alerts",
    f"""WITH {_LEVELS} SELECT company_id, round(score, 6) AS score, level FROM v WHERE level = 'critical' OR (level = 'high' AND
    round(score, 6) >= 0.7) OR company_id % 50 = 0 AND level <> 'low'""",
)
def rsk21(t):
    return company_levels(t).filter("level = 'critical' OR (level = 'high' AND score >= 0.7) OR company_id % 50 = 0 AND level <> 'low'")


@query(
    "rsk23_risk_report",
    f"""WITH {_ALERTS}, y AS (SELECT company_id, year(date) AS year, round(sum(amount), 4) AS s FROM records GROUP BY 1,
    2), t AS (SELECT company_id, arg_max(s, year) AS latest, round(regr_slope(s, year), 2) AS slope FROM y GROUP BY 1),
    b AS (SELECT company_id, count(*) FILTER (WHERE rule = 'bulk') AS bulk, count(*) FILTER (WHERE rule = 'large') AS large,
    count(*) FILTER (WHERE rule = 'cheap') AS cheap FROM a GROUP BY 1),
    l AS (SELECT company_id, string_agg(pk, ',' ORDER BY date DESC, pk, rule) AS last_alerts FROM (SELECT * FROM a QUALIFY
    row_number() OVER (PARTITION BY company_id ORDER BY date DESC, pk, rule) <= 5) GROUP BY 1)
    SELECT company_id, latest, CASE WHEN slope > 0 THEN 'rising' WHEN slope < 0 THEN 'falling' ELSE 'stable' END AS trend,
    coalesce(bulk, 0) AS bulk, coalesce(large, 0) AS large, coalesce(cheap, 0) AS cheap, last_alerts FROM t LEFT JOIN b USING
    (company_id) LEFT JOIN l USING (company_id)""",
)
def rsk23(t):
    y = t("records").groupBy("company_id", F.year("date").alias("year")).agg(r(F.sum("amount"), 4).alias("s"))
    trend = y.groupBy("company_id").agg(F.max_by("s", "year").alias("latest"), r(F.regr_slope("s", "year"), 2).alias("slope"))
    a, kinds = record_alerts(t), ("bulk", "large", "cheap")
    b = a.groupBy("company_id").agg(*[F.count_if(F.col("rule") == k).alias(k) for k in kinds])
    w = Window.partitionBy("company_id").orderBy(F.desc("date"), "pk", "rule")
    last = a.withColumn("k",
        F.row_number().over(w)).filter("k <= 5").groupBy("company_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "pk")))["pk"],
        ",").alias("last_alerts"))
    j = trend.join(b, "company_id", "left").join(last, "company_id", "left")
    return j.select("company_id", "latest", F.when(F.col("slope") > 0, "rising").when(F.col("slope") < 0,
        "falling").otherwise("stable").alias("trend"), *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds], "last_alerts")


@query(
    "str10_user_history",
    """SELECT user_id, count(*) AS kept, round(avg(amount), 6) AS mean FROM (SELECT * FROM transactions QUALIFY row_number() OVER
    (PARTITION BY user_id ORDER BY ts DESC, transaction_id DESC) <= 1000) GROUP BY 1""",
)
def str10(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("transaction_id")))
    return t("transactions").withColumn("k", k).filter("k <= 1000").groupBy("user_id").agg(rows().alias("kept"), r(F.avg("amount")).alias("mean"))


@query("udf01_rule_table", f"WITH {_ALERTS} SELECT rule, count(*) AS n, round(sum(confidence), 4)::DOUBLE AS weight FROM a GROUP BY 1")
def udf01(t):
    return record_alerts(t).groupBy("rule").agg(rows().alias("n"), r(F.sum("confidence"), 4).alias("weight"))


@query(
    "udf03_custom_aggregates",
    """WITH s AS (SELECT country_code, company_id, sum(amount) AS v FROM records GROUP BY 1, 2), k AS (SELECT *, row_number()
    OVER (PARTITION BY country_code ORDER BY v, company_id) AS i, count(*) OVER (PARTITION BY country_code) AS n, sum(v)
    OVER (PARTITION BY country_code) AS total FROM s)
    SELECT country_code, round(sum((2 * i - n - 1) * v) / max(n * total), 6)::DOUBLE AS gini, round(sum(v / log2(n - i +
    2)), 2)::DOUBLE AS dcg FROM k GROUP BY 1""",
)
def udf03(t):
    s = t("records").groupBy("country_code", "company_id").agg(F.sum("amount").alias("v"))
    w = Window.partitionBy("country_code")
    k = s.withColumns({"i": F.row_number().over(w.orderBy("v", "company_id")), "n": rows().over(w), "total": F.sum("v").over(w)})
    return k.groupBy("country_code").agg(r(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("v")) / F.max(F.col("n") * F.col("total"))).alias("gini"),
        r(F.sum(F.col("v") / F.log2(F.col("n") - F.col("i") + 2)), 2).alias("dcg"))
