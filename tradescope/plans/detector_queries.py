"""Queries of outlier detectors, forecasts, overall quality and request signatures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.operators import joins
from tradescope.operators import neighbours as NB
from tradescope.operators import ordered as O
from tradescope.operators import peaks as P
from tradescope.operators import overlaps as V
from tradescope.operators import aggregates as A
from tradescope.operators import forecasts as C
from tradescope.operators import quality as Q
from tradescope.operators import rules
from tradescope.registry import query


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    return F.round(c, digits)


_EV = "e AS (SELECT event_id, value, hour(ts) AS hour FROM events)"
_FIG = "f AS (SELECT avg(value) AS m, stddev_samp(value) AS d, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"


@query("out02_z_or_iqr", f"WITH {_FIG} SELECT event_id FROM events, f WHERE abs(value - m) > 3 * d OR value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def out02(t):
    return Q.outliers(t("events").select("event_id", "value"), ["value"]).select("event_id")


@query("out04_series_detector")
def out04(t):
    """Peaks, valleys and jumps of each item's prices: by distance 5 and a prominence of one deviation; steps of over two deviations of the steps."""
    x = t("interactions").select("event_id", "item_id", "ts", "price", (-F.col("price")).alias("down"))
    order = ["ts", "event_id"]
    peak, valley = (P.find_peaks(x, ["item_id"], order, c).select("event_id", F.lit(k).alias("kind")) for c, k in (("price", "peak"), ("down", "valley")))
    o = Window.partitionBy("item_id").orderBy(*order)
    step = x.withColumn("step", F.abs(F.col("price") - F.lag("price").over(o)))
    jump = joins.map_back(step, "item_id", (F.avg("step") + 2 * F.stddev_pop("step")).alias("cut")).filter("step > cut").select("event_id", F.lit("jump").alias("kind"))
    kinds = peak.unionByName(valley).unionByName(jump).groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return kinds


@query("out06_local_density")
def out06(t):
    x = t("events").select("event_id", "value", F.hour("ts").alias("hour"))
    return NB.local_outlier_factors(x, "event_id", ["value", "hour"]).withColumn("score", r(F.col("score"), 5))


@query(
    "out09_weighted_ensemble",
    f"""WITH {_FIG}, u AS (SELECT user_id, avg(value) AS um, stddev_pop(value) AS ud, count(*) AS n FROM events GROUP BY
    1), h AS (SELECT hour(ts) AS h, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM events GROUP BY 1),
    x AS (SELECT event_id, (abs(value - m) > 3 * d)::INT AS z, (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INT
    AS iqr, CASE WHEN n >= 10 THEN (abs(value - um) > 2 * ud)::INT END AS own, (share < 0.041)::INT AS rare FROM events JOIN
    u USING (user_id) JOIN h ON h = hour(ts), f)
    SELECT event_id, round((0.25 * z + 0.20 * iqr + 0.15 * rare + coalesce(0.20 * own, 0)) / (0.60 + CASE WHEN own IS NULL
    THEN 0 ELSE 0.2 END), 6)::DOUBLE AS score FROM x""",
)
def out09(t):
    x, v = t("events"), F.col("value")
    f = x.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d")).join(F.broadcast(O.exact_quantiles(x, "value", (0.25, 0.75))))
    u = x.groupBy("user_id").agg(F.avg("value").alias("um"), F.stddev_pop("value").alias("ud"), rows().alias("n"))
    h = x.groupBy(F.hour("ts").alias("h")).agg(rows().alias("c"))
    h = A.with_figures(h, F.sum("c").alias("all")).select("h", (F.col("c") / F.col("all")).alias("share"))
    j = x.join(F.broadcast(f)).join(u, "user_id").join(F.broadcast(h), F.hour("ts") == F.col("h"))  # 24 rows
    width = 1.5 * (F.col("q")[1] - F.col("q")[0])
    flag = lambda c: c.cast("int").cast("double")
    parts = [(flag(F.abs(v - F.col("m")) > 3 * F.col("d")), 0.25), (flag((v < F.col("q")[0] - width) | (v > F.col("q")[1] + width)),
        0.20), (flag(F.col("share") < 0.041), 0.15), (F.when(F.col("n") >= 10, flag(F.abs(v - F.col("um")) > 2 * F.col("ud"))),
        0.20)]
    return j.select("event_id", r(rules.weighted(parts)).alias("score"))


@query(
    "out10_text_clusters",
    r"""WITH x AS (SELECT event_id, regexp_replace(regexp_replace(line, '^.{19} - ', ''), '[0-9]+', '#', 'g') AS message, regexp_matches(line,
    '(?i)exception|timeout') AS rule FROM logs), m AS (SELECT message, count(*) AS copies, bool_or(rule) AS rule, row_number() OVER (ORDER BY message) AS id FROM x GROUP BY 1),
    w AS (SELECT id, unnest(regexp_extract_all(lower(message), '[a-z]+')) AS term FROM m), tf AS (SELECT id, term, count(*) AS n FROM w GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1), v AS (SELECT id, term, n * ln((SELECT count(*) FROM m) * 1.0 / d) AS x FROM tf JOIN df USING (term)),
    l AS (SELECT id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1), u AS (SELECT id, term, x / l AS x FROM v JOIN l USING (id) WHERE l > 0),
    near AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.term = b.term GROUP BY 1, 2 HAVING a.id = b.id OR sum(a.x * b.x) >= 0.5
    UNION SELECT id, id FROM m),
    c AS (SELECT a AS id, sum(copies) AS n FROM near JOIN m ON m.id = b GROUP BY 1), core AS (SELECT id FROM c WHERE n >= 5),
    kind AS (SELECT m.id, m.message, CASE WHEN m.id IN (SELECT id FROM core) THEN 'core' WHEN EXISTS (SELECT 1 FROM near JOIN core ON core.id = near.b WHERE
    near.a = m.id) THEN 'border' ELSE 'noise' END AS kind FROM m)
    SELECT event_id, kind, rule FROM x JOIN kind USING (message) WHERE kind = 'noise' OR rule""",
)
def out10(t):
    """Lines whose message is noise among TF-IDF neighbours, and lines that a rule names. Equal messages are one point with a number."""
    message = F.regexp_replace(F.regexp_replace("line", "^.{19} - ", ""), "[0-9]+", "#")
    x = t("logs").select("event_id", message.alias("message"), F.col("line").rlike("(?i)exception|timeout").alias("rule"))
    points = x.groupBy("message").agg(rows().alias("copies")).withColumn("id", F.monotonically_increasing_id())
    kinds = V.text_clusters(points, "message", least=0.5, neighbours=5).select("message", "kind")
    return x.join(joins.checked_broadcast(kinds), "message").filter("kind = 'noise' OR rule").select("event_id", "kind", "rule")


@query(
    "out11_feature_builder",
    """WITH c AS (SELECT company_id, count(*) AS freq, avg(amount) AS mean FROM records GROUP BY 1) SELECT pk, round(ln(1
    + amount), 6) AS value_log, round(ln(1 + qty), 6) AS qty_log, month(date) AS month, isodow(date) AS weekday, date_diff('day',
    registration_date, date) AS age_days, round(amount / mean, 6) AS ratio, freq, r.country_code IN ('NB', 'ND') AS high_risk
    FROM records r JOIN companies USING (company_id) JOIN c USING (company_id)""",
)
def out11(t):
    x = t("records")
    c = x.groupBy("company_id").agg(rows().alias("freq"), F.avg("amount").alias("mean")).join(t("companies").select("company_id",
        "registration_date"), "company_id")
    j = x.join(c, "company_id")
    return j.select(
        "pk", r(F.log1p("amount")).alias("value_log"), r(F.log1p("qty")).alias("qty_log"), F.month("date").alias("month"),
            (F.weekday("date") + 1).alias("weekday"), F.datediff("date", "registration_date").alias("age_days"),
        r(F.col("amount") / F.col("mean")).alias("ratio"), "freq", F.col("country_code").isin("NB", "ND").alias("high_risk"),
    )


#: Dimensions of quality with least scores (fixed values).
LEAST = {"completeness": 0.99, "uniqueness": 0.99, "validity": 0.9, "consistency": 0.95, "accuracy": 0.9, "timeliness": 0.5}
_DIMS = """x AS (SELECT l.*, o_orderdate, o_orderkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS same FROM
    lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT avg((l_partkey IS NOT NULL AND l_suppkey IS NOT
    NULL AND l_shipdate IS NOT NULL)::INT) AS completeness, avg((same = 1)::INT) AS uniqueness,
    avg((l_quantity BETWEEN 1 AND 45)::INT) AS validity, avg((o_orderkey IS NOT NULL)::INT) AS consistency, avg((l_extendedprice
    / l_quantity BETWEEN 850 AND 2500)::INT) AS accuracy, avg((l_shipdate >= TIMESTAMP '1998-01-01')::INT) AS timeliness
    FROM x)"""


@query(
    "dq15_overall",
    f"WITH {_DIMS}, d AS (SELECT unnest([{', '.join(f'{chr(39)}{k}{chr(39)}' for k in LEAST)}]) AS dimension, unnest([{', '.join(LEAST)}]) AS score, unnest([{', '.join(map(str, LEAST.values()))}]) AS least FROM g) SELECT dimension, round(score, 6)::DOUBLE AS score, round(avg(score) OVER (), 6)::DOUBLE AS overall, CASE WHEN score < least THEN 'improve ' || dimension ELSE 'keep' END AS recommendation FROM d",
)
def dq15(t):
    x = t("lineitem").join(t("orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    single = F.count(F.lit(1))
    same = x.groupBy("l_orderkey", "l_linenumber").agg(single.alias("n")).agg((F.count_if(F.col("n") == 1) / F.sum("n")).alias("uniqueness"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    given = F.col("l_partkey").isNotNull() & F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull()
    g = x.agg(
        share(given).alias("completeness"), share(F.col("l_quantity").between(1, 45)).alias("validity"),
            share(F.col("o_orderkey").isNotNull()).alias("consistency"), share((F.col("l_extendedprice") / F.col("l_quantity")).between(850,
            2500)).alias("accuracy"),
        share(F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")).alias("timeliness"),
    )
    one = g.join(F.broadcast(same))
    d = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("score"), F.lit(v).alias("least")) for k,
        v in LEAST.items()])).alias("d"), (sum((F.col(k) for k in LEAST), F.lit(0.0)) / len(LEAST)).alias("o"))
    return d.select("d.dimension", r(F.col("d.score")).alias("score"), r(F.col("o")).alias("overall"),
        F.when(F.col("d.score") < F.col("d.least"), F.concat(F.lit("improve "), "d.dimension")).otherwise("keep").alias("recommendation"))


#: What injected requests hold, and the names of scanners (fixed values).
INJECTIONS = {"sql": r"union\s+select|or\s+1\s*=\s*1|drop\s+table|--\s", "script": r"<script|javascript:|onerror\s*="}
SCANNERS = "sqlmap|nikto|nmap|masscan|burp|acunetix"
_REQUESTS = "q AS (SELECT page_id, url || CASE WHEN page_id % 17 = 0 THEN '&id=1 OR 1=1' WHEN page_id % 19 = 0 THEN '&x=<script>a</script>' WHEN page_id % 23 = 0 THEN '; DROP TABLE t' ELSE '' END AS request, CASE WHEN page_id % 13 = 0 THEN 'sqlmap/1.7' WHEN page_id % 29 = 0 THEN 'Nikto' ELSE 'browser' END AS agent FROM pages)"


def requests(t):
    """Requests for pages, some of them tampered with, with their user agents."""
    i = F.col("page_id")
    tail = F.when(i % 17 == 0, "&id=1 OR 1=1").when(i % 19 == 0, "&x=<script>a</script>").when(i % 23 == 0, "; DROP TABLE t").otherwise("")
    return t("pages").select("page_id", F.concat("url", tail).alias("request"), F.when(i % 13 == 0, "sqlmap/1.7").when(i % 29 == 0,
        "Nikto").otherwise("browser").alias("agent"))


@query(
    "sec01_injection_patterns",
    f"""WITH {_REQUESTS} SELECT page_id, CASE WHEN regexp_matches(request, '(?i){INJECTIONS['sql']}') THEN 'sql' ELSE 'script' END
    AS kind FROM q WHERE regexp_matches(request, '(?i){INJECTIONS['sql']}|{INJECTIONS['script']}')""",
)
def sec01(t):
    kind = F.when(F.col("request").rlike(f"(?i){INJECTIONS['sql']}"), "sql").when(F.col("request").rlike(f"(?i){INJECTIONS['script']}"), "script")
    return requests(t).select("page_id", kind.alias("kind")).filter("kind IS NOT NULL")


@query(
    "sec05_scanner_signatures",
    f"""WITH {_REQUESTS} SELECT page_id, regexp_matches(agent, '(?i){SCANNERS}') AS scanner, regexp_matches(request, '(?i)select|drop|insert|1=1')
    AS sql_words FROM q WHERE regexp_matches(agent, '(?i){SCANNERS}') OR regexp_matches(request, '(?i)select|drop|insert|1=1')""",
)
def sec05(t):
    x = requests(t).select("page_id", F.col("agent").rlike(f"(?i){SCANNERS}").alias("scanner"), F.col("request").rlike("(?i)select|drop|insert|1=1").alias("sql_words"))
    return x.filter("scanner OR sql_words")


def monthly(t):
    """Amount of each company and month."""
    return t("records").groupBy("company_id", F.trunc("date", "month").alias("month")).agg(F.round(F.sum("amount"), 4).alias("amount"))


@query("fcs02_boosted_forecast")
def fcs02(t):
    return C.boosted_forecast(monthly(t), "company_id", "month", "amount")


@query("fcs06_price_ensemble")
def fcs06(t):
    return C.price_ensemble(monthly(t), "company_id", "month", "amount")


@query(
    "fcs03_ensemble_forecast",
    """WITH m AS (SELECT company_id, CAST(date_trunc('month', date) AS DATE) AS month, round(sum(amount), 4) AS amount FROM
    records GROUP BY 1, 2), f AS (SELECT *, lag(amount, 12) OVER o AS yearly, avg(amount) OVER (PARTITION BY company_id ORDER
    BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent, stddev_pop(amount) OVER (PARTITION BY company_id ORDER
    BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS d FROM m WINDOW o AS (PARTITION BY company_id ORDER BY month))
    SELECT company_id, month, round(0.6 * yearly + 0.4 * recent, 4) AS forecast, round(least(yearly, recent) - 1.96 * d,
    3) AS low, round(greatest(yearly, recent) + 1.96 * d, 3) AS high FROM f WHERE yearly IS NOT NULL""",
)
def fcs03(t):
    """A seasonal forecast (a year ago) and a recent mean (three months), blended."""
    w = Window.partitionBy("company_id").orderBy("month")
    f = monthly(t).withColumns({"yearly": F.lag("amount", 12).over(w), "recent": F.avg("amount").over(w.rowsBetween(-3,
        -1)), "d": F.stddev_pop("amount").over(w.rowsBetween(-12, -1))}).filter("yearly IS NOT NULL")
    b = C.blend(F.col("yearly"), F.col("recent"), F.col("d"))
    return f.select("company_id", "month", r(b["forecast"], 4).alias("forecast"), r(b["low"], 3).alias("low"), r(b["high"], 3).alias("high"))


@query(
    "fcs09_market_risk_flags",
    """WITH m AS (SELECT hs_code, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS s, avg(amount / qty) AS
    price, count(*) AS n FROM records GROUP BY 1, 2), p AS (SELECT *, s / lag(s) OVER w - 1 AS ret, price / lag(price) OVER
    w - 1 AS up FROM m WINDOW w AS (PARTITION BY hs_code ORDER BY month)),
    g AS (SELECT hs_code, 100 * stddev_samp(ret) AS vol, 100 * avg(up) AS inflation, 100.0 * count(*) FILTER (WHERE n < 5)
    / count(*) AS idle, avg((ret > 0)::INT) AS mood FROM p WHERE ret IS NOT NULL GROUP BY 1)
    SELECT hs_code, CASE WHEN vol > 30 THEN 'high' WHEN vol > 20 THEN 'medium' ELSE 'low' END AS volatility, idle > 5 AS
    unemployment, inflation > 3 AS inflation, mood < 0.3 AS mood FROM g""",
)
def fcs09(t):
    w = Window.partitionBy("hs_code").orderBy("month")
    m = t("records").groupBy("hs_code", F.trunc("date", "month").alias("month")).agg(F.sum("amount").alias("s"),
        F.avg(F.col("amount") / F.col("qty")).alias("price"), rows().alias("n"))
    p = m.withColumns({"ret": F.col("s") / F.lag("s").over(w) - 1, "up": F.col("price") / F.lag("price").over(w) - 1}).filter("ret IS NOT NULL")
    g = p.groupBy("hs_code").agg((100 * F.stddev_samp("ret")).alias("vol"), (100 * F.avg("up")).alias("i"),
        (100.0 * F.count_if(F.col("n") < 5) / rows()).alias("idle"), F.avg((F.col("ret") > 0).cast("int")).alias("m"))
    return g.select("hs_code", F.when(F.col("vol") > 30, "high").when(F.col("vol") > 20, "medium").otherwise("low").alias("volatility"),
        (F.col("idle") > 5).alias("unemployment"), (F.col("i") > 3).alias("inflation"), (F.col("m") < 0.3).alias("mood"))
