"""Queries of data quality, outliers, model monitoring, security and governance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators import ordered as O
from tradescope.operators import aggregates as A
from tradescope.operators import quality as Q
from tradescope.operators import windows as W
from tradescope.operators import joins
from tradescope.operators.rules import signatures
from tradescope.registry import query

COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    return F.round(c, digits)


def rules():
    return {"range": F.col("l_quantity").between(1, 45), "categorical": F.col("l_returnflag").isin("A", "N"), "conditional": (F.col("l_linestatus") != "F") | (F.col("l_discount") < 0.09)}


_BAD = {"range": "NOT l_quantity BETWEEN 1 AND 45", "categorical": "l_returnflag NOT IN ('A', 'N')", "conditional": "NOT (l_linestatus <> 'F' OR l_discount < 0.09)"}
_VALIDATION = " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {v}) AS failed, count(*) AS total FROM lineitem" for k, v in _BAD.items())


@query("dq01_dq03_dq06_checks", _VALIDATION)
def dq01(t):
    return Q.validation(t("lineitem"), "l_orderkey", rules())


@query(
    "dq02_format_check",
    """SELECT count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS bad_names, count(*) FILTER (WHERE NOT
    regexp_matches(c_mktsegment, '^[A-Z]+$')) AS bad_segments FROM customer""",
)
def dq02(t):
    return t("customer").agg(F.count_if(~F.col("c_name").rlike("^Customer#[0-9]{9}$")).alias("bad_names"), F.count_if(~F.col("c_mktsegment").rlike("^[A-Z]+$")).alias("bad_segments"))


@query("dq04_uniqueness_check", "SELECT count(*) AS duplicates FROM (SELECT 1 FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1)")
def dq04(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(rows().alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))


@query(
    "dq05_dq10_completeness",
    """SELECT round(avg(CASE WHEN l_quantity > 45 THEN 0 ELSE 1 END), 6) AS quantity, 1.0::DOUBLE AS price, avg(CASE WHEN l_quantity
    > 45 THEN 0 ELSE 1 END) < 0.95 AS failed, round((avg(CASE WHEN l_quantity > 45 THEN 0 ELSE 1 END) + 1) / 2, 6) AS dimension
    FROM lineitem""",
)
def dq05(t):
    d = t("lineitem").select(F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("q"), "l_extendedprice")
    known = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    return d.agg(r(known("q")).alias("quantity"), known("l_extendedprice").alias("price"), (known("q") < 0.95).alias("failed"),
        r((known("q") + known("l_extendedprice")) / 2).alias("dimension"))


@query("dq07_referential_integrity", "SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def dq07(t):
    return t("orders").join(t("customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey")),
        "o_custkey", "left_anti").agg(rows().alias("orphans"))


@query(
    "dq08_validation_score",
    f"""SELECT round(greatest(0, 1 - avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END) - avg(e)), 4)::DOUBLE AS score FROM (SELECT
    {' + '.join(f'CASE WHEN {v} THEN 1 ELSE 0 END' for v in _BAD.values())}
    AS e FROM lineitem WHERE l_quantity < 46)""",
)
def dq08(t):
    return Q.validation_score(t("lineitem").filter("l_quantity < 46"), rules())


@query(
    "dq09_accuracy",
    """WITH q AS (SELECT quantile_cont(s_acctbal, 0.25) AS a, quantile_cont(s_acctbal, 0.75) AS b FROM supplier) SELECT round(1
    - (count(*) FILTER (WHERE s_acctbal < 0) + count(*) FILTER (WHERE s_acctbal < a - 1.5 * (b - a) OR s_acctbal > b + 1.5
    * (b - a)) + count(*) FILTER (WHERE lower(s_name) IN ('n/a', 'unknown', 'test'))) / (3.0 * count(*)), 6)::DOUBLE AS accuracy
    FROM supplier, q""",
)
def dq09(t):
    s = t("supplier").join(F.broadcast(O.quantile_figures(t("supplier"), "s_acctbal", a=0.25, b=0.75)))
    issues = F.count_if(F.col("s_acctbal") < 0) + F.count_if(F.expr("s_acctbal < a - 1.5 * (b - a) OR s_acctbal > b + 1.5 * (b - a)")) + F.count_if(F.lower("s_name").isin("n/a",
        "unknown", "test"))
    return s.agg(r(1 - issues / (3.0 * rows())).alias("accuracy"))


@query(
    "dq11_consistency",
    """SELECT round(((stddev_samp(l_quantity) <= 10 * avg(l_quantity))::INT + (stddev_samp(l_discount) <= 10 * avg(l_discount))::INT)
    / 2.0, 6)::DOUBLE AS consistency FROM lineitem""",
)
def dq11(t):
    ok = lambda c: (F.stddev_samp(c) <= 10 * F.avg(c)).cast("int")
    return t("lineitem").agg(r((ok("l_quantity") + ok("l_discount")) / 2.0).alias("consistency"))


@query(
    "dq12_timeliness",
    """SELECT CASE WHEN max(o_orderdate) < TIMESTAMP '2002-01-01' - INTERVAL 30 DAYS THEN 0.8 ELSE 1.0 END::DOUBLE AS timeliness
    FROM orders""",
)
def dq12(t):
    return t("orders").agg(F.when(F.max("o_orderdate") < F.expr("TIMESTAMP_NTZ '2002-01-01 00:00:00' - INTERVAL 30 DAYS"),
        0.8).otherwise(1.0).alias("timeliness"))


@query("dq13_validity", "SELECT round(avg(CASE WHEN l_quantity > 48 OR l_quantity < 2 THEN 0.0 ELSE 1.0 END), 6)::DOUBLE AS validity FROM lineitem")
def dq13(t):
    x = F.when(F.col("l_quantity") > 48, F.lit(float("nan"))).when(F.col("l_quantity") < 2, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    return t("lineitem").select(x.alias("x")).agg(r(F.avg(F.when(F.isnan("x") | (F.abs("x") == float("inf")), 0.0).otherwise(1.0))).alias("validity"))


@query(
    "dq14_uniqueness_dimension",
    """SELECT round((count(DISTINCT p_brand) + count(DISTINCT p_name) + count(DISTINCT p_size)) / (3.0 * count(*)), 6)::DOUBLE AS
    uniqueness FROM part""",
)
def dq14(t):
    return t("part").agg(r((F.count_distinct("p_brand") + F.count_distinct("p_name") + F.count_distinct("p_size")) / (3.0 * rows())).alias("uniqueness"))


def _profile(c):
    return f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, round(min({c}), 4) AS low, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation FROM lineitem"


@query("dq16_numeric_profile", " UNION ALL ".join(map(_profile, COLUMNS)))
def dq16(t):
    return Q.numeric_profile(t("lineitem"), COLUMNS)


@query(
    "dq17_text_profile",
    """WITH l AS (SELECT round(avg(length(c_mktsegment)), 6) AS mean, min(length(c_mktsegment)) AS low, max(length(c_mktsegment))
    AS high FROM customer) SELECT c_mktsegment AS value, count(*) AS n, any_value(mean) AS mean, any_value(low) AS low, any_value(high)
    AS high FROM customer, l GROUP BY 1 ORDER BY n DESC, value LIMIT 5""",
)
def dq17(t):
    c = t("customer")
    figures = c.agg(r(F.avg(F.length("c_mktsegment"))).alias("mean"), F.min(F.length("c_mktsegment")).cast("long").alias("low"),
        F.max(F.length("c_mktsegment")).cast("long").alias("high"))
    top = c.groupBy(F.col("c_mktsegment").alias("value")).agg(rows().alias("n")).orderBy(F.desc("n"), "value").limit(5)
    return top.join(F.broadcast(figures))


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("dq18_dataset_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, round(count({c}) * 1.0 / count(*), 6)::DOUBLE AS completeness FROM orders" for c in _ORDER_COLUMNS))
def dq18(t):
    one = t("orders").agg(rows().alias("total"), *[F.struct(F.count(c).alias("known"), F.count_distinct(c).alias("distinct_values")).alias(c) for c in _ORDER_COLUMNS])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["known"].alias("known"), F.col(c)["distinct_values"].alias("distinct_values")) for c in _ORDER_COLUMNS])
    x = one.select("total", F.explode(parts).alias("p"))
    return x.select("p.column", "total", (F.col("total") - F.col("p.known")).alias("nulls"), "p.distinct_values",
        F.round(F.col("p.known") / F.col("total"), 6).alias("completeness"))


@query("dq19_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i,
    a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]))
def dq19(t):
    return Q.correlations(t("lineitem"), COLUMNS)


@query("dq20_skew_kurtosis", "SELECT round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis FROM events")
def dq20(t):
    return t("events").agg(r(S.adjusted_skew(F.col("value"))).alias("skew"), r(S.adjusted_kurtosis(F.col("value"))).alias("kurtosis"))


@query(
    "dq21_insights",
    """SELECT 'p_type' AS \"column\", 'few distinct values' AS insight FROM part HAVING count(DISTINCT p_type) < 20 AND count(DISTINCT
    p_type) < 0.05 * count(*)""",
)
def dq21(t):
    names = ("p_name", "p_type", "p_retailprice")
    one = t("part").agg(rows().alias("n"), *[F.count_distinct(c).alias(c) for c in names])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
        F.col(c).alias("d")) for c in names])).alias("x")).filter("x.d < 20 AND x.d < 0.05 * n").select("x.column", F.lit("few distinct values").alias("insight"))


@query("dq22_rule_batch", f"SELECT count(*) FILTER (WHERE failed = 0) AS passed, count(*) FILTER (WHERE failed > 0) AS failed FROM ({_VALIDATION})")
def dq22(t):
    return Q.validation(t("lineitem"), "l_orderkey", rules()).agg(F.count_if(F.col("failed") == 0).alias("passed"),
        F.count_if(F.col("failed") > 0).alias("failed"))


@query(
    "dq23_quality_report",
    """WITH m AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, avg(CASE WHEN value < 300 THEN 1.0 ELSE 0.0 END)::DOUBLE
    AS score FROM events GROUP BY 1, 2) SELECT source, round(arg_max(score, day), 6) AS latest, round(min(score), 6) AS low,
    round(max(score), 6) AS high, round(avg(score), 6) AS mean FROM m GROUP BY 1""",
)
def dq23(t):
    m = t("events").groupBy(F.col("event_type").alias("source"),
        F.col("ts").cast("date").alias("day")).agg(F.avg(F.when(F.col("value") < 300, 1.0).otherwise(0.0)).alias("score"))
    return m.groupBy("source").agg(r(F.max_by("score", "day")).alias("latest"), r(F.min("score")).alias("low"),
        r(F.max("score")).alias("high"), r(F.avg("score")).alias("mean"))


@query("dq24_validation_run", f"SELECT count(*) FILTER (WHERE {' OR '.join(f'({v})' for v in _BAD.values())}) AS invalid, count(*) AS total FROM lineitem")
def dq24(t):
    return t("lineitem").select(F.size(Q.row_errors(rules())).alias("e")).agg(F.count_if(F.col("e") > 0).alias("invalid"), rows().alias("total"))


@query(
    "out01_global_z",
    """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events WHERE value > 0) SELECT event_id, round((value - m)
    / d, 6) AS z FROM events, s WHERE abs((value - m) / d) > 3""",
)
def out01(t):
    e = A.with_figures(t("events").filter("value > 0"), F.avg("value").alias("m"), F.stddev_pop("value").alias("d")).withColumn("z",
        (F.col("value") - F.col("m")) / F.col("d"))
    return e.filter("abs(z) > 3").select("event_id", r(F.col("z")).alias("z"))


_ODD = " OR ".join(f"abs({c} - (SELECT avg({c}) FROM lineitem)) > 3 * (SELECT stddev_samp({c}) FROM lineitem) OR {c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem) OR {c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)" for c in ("l_extendedprice",
    "l_quantity"))


@query(
    "out03_per_stream_z",
    """SELECT event_id FROM events QUALIFY abs(value - avg(value) OVER (PARTITION BY event_type)) > 3 * stddev_pop(value) OVER (PARTITION
    BY event_type)""",
)
def out03(t):
    x = joins.map_back(t("events"), "event_type", F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return x.filter(F.abs(F.col("value") - F.col("m")) > 3 * F.col("d")).select("event_id")


@query(
    "out12_standard_scaling",
    """SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS scaled
    FROM events""",
)
def out12(t):
    e = A.with_figures(t("events"), F.avg("value").alias("m"), F.stddev_samp("value").alias("d"))
    return e.select("event_id", r((F.col("value") - F.col("m")) / F.col("d")).alias("scaled"))


@query(
    "out13_run_summary",
    """SELECT event_type AS method, count(*) FILTER (WHERE value > 200) AS flagged, count(*) AS total, round(count(*) FILTER (WHERE
    value > 200) * 1.0 / count(*), 6)::DOUBLE AS ratio FROM events GROUP BY 1""",
)
def out13(t):
    hit = F.count_if(F.col("value") > 200)
    return t("events").groupBy(F.col("event_type").alias("method")).agg(hit.alias("flagged"), rows().alias("total"), r(hit / rows()).alias("ratio"))


@query(
    "mon01_classification_metrics",
    """WITH c AS (SELECT quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
    k AS (SELECT v, count(*) FILTER (WHERE y = v) AS support, count(*) FILTER (WHERE p = v) AS predicted, count(*) FILTER
    (WHERE y = v AND p = v) AS hit FROM c, (VALUES (0), (1)) x(v) GROUP BY 1) SELECT round((SELECT avg(CASE WHEN y = p THEN
    1.0 ELSE 0.0 END) FROM c), 6)::DOUBLE AS accuracy, round(sum(support * coalesce(hit * 1.0 / nullif(predicted, 0), 0))
    / sum(support), 6)::DOUBLE AS precision_w, round(sum(support * coalesce(hit * 1.0 / nullif(support, 0), 0)) / sum(support),
    6)::DOUBLE AS recall_w FROM k""",
)
def mon01(t):
    c = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"),
        (F.col("n_chars") > 800).cast("int").alias("p"))
    k = c.select("y", "p", F.explode(F.array(F.lit(0),
        F.lit(1))).alias("v")).groupBy("v").agg(F.count_if(F.col("y") == F.col("v")).alias("s"), F.count_if(F.col("p") == F.col("v")).alias("q"),
        F.count_if((F.col("y") == F.col("v")) & (F.col("p") == F.col("v"))).alias("h"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return k.agg(r(F.sum("h") / F.sum("s")).alias("accuracy"), r(F.sum(F.col("s") * ratio("h", "q")) / F.sum("s")).alias("precision_w"),
        r(F.sum(F.col("s") * ratio("h", "s")) / F.sum("s")).alias("recall_w"))


@query(
    "mon03_two_sample_ks",
    """WITH x AS (SELECT value, event_type = 'error' AS a FROM events WHERE event_type IN ('error', 'view')), c AS (SELECT value,
    sum(a::INT) OVER (ORDER BY value) * 1.0 / sum(a::INT) OVER () AS f, sum(1 - a::INT) OVER (ORDER BY value) * 1.0 / sum(1
    - a::INT) OVER () AS g FROM x), d AS (SELECT max(abs(f - g)) AS d FROM c), n AS (SELECT sum(a::INT)::DOUBLE AS na, sum(1 - a::INT)::DOUBLE AS nb FROM x),
    z AS (SELECT d, d * sqrt(na * nb / (na + nb)) AS z FROM d, n)
    SELECT round(d, 6)::DOUBLE AS d, round(CASE WHEN z < 0.1 THEN 1 ELSE greatest(least((SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * z * z))
    FROM range(1, 101) t(k)), 1), 0) END, 6)::DOUBLE AS p FROM z""",
)
def mon03(t):
    """Values of errors against those of views."""
    found = O.two_sample_ks(t("events"), "value", F.col("event_type") == "error", F.col("event_type") == "view")
    return found.select(r(F.col("d")).alias("d"), r(F.col("p")).alias("p"))


_SCORES = "scores AS (SELECT event_type AS model, CAST(ts AS DATE) AS day, avg(CASE WHEN value < 250 THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM events GROUP BY 1, 2)"


def scores(t):
    return t("events").groupBy(F.col("event_type").alias("model"),
        F.col("ts").cast("date").alias("day")).agg(F.avg(F.when(F.col("value") < 250, 1.0).otherwise(0.0)).alias("accuracy"))


@query(
    "mon02_relative_drift",
    f"""WITH {_SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day) AS i FROM scores) SELECT model, round(arg_max(accuracy,
    day) / (sum(accuracy * i) / sum(i)) - 1, 6) AS change, abs(arg_max(accuracy, day) / (sum(accuracy * i) / sum(i)) - 1)
    > 0.1 AS drift FROM k GROUP BY 1""",
)
def mon02(t):
    k = scores(t).withColumn("i", F.row_number().over(W.ordered(["model"], ["day"])))
    change = F.max_by("accuracy", "day") / (F.sum(F.col("accuracy") * F.col("i")) / F.sum("i")) - 1
    return k.groupBy("model").agg(r(change).alias("change"), (F.abs(change) > 0.1).alias("drift"))


@query(
    "mon05_metric_trends",
    f"""WITH {_SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day) AS i FROM scores) SELECT model, round(regr_slope(accuracy,
    i), 6) AS slope, round(stddev_samp(accuracy) / avg(accuracy), 6) AS cv, CASE WHEN regr_slope(accuracy, i) > 0.001 THEN
    'improving' WHEN regr_slope(accuracy, i) < -0.001 THEN 'declining' ELSE 'stable' END AS trend FROM k GROUP BY 1""",
)
def mon05(t):
    k = scores(t).withColumn("i", F.row_number().over(W.ordered(["model"], ["day"])))
    s = F.regr_slope("accuracy", "i")
    return k.groupBy("model").agg(r(s).alias("slope"), r(F.stddev_samp("accuracy") / F.avg("accuracy")).alias("cv"),
        F.when(s > 0.001, "improving").when(s < -0.001, "declining").otherwise("stable").alias("trend"))


@query(
    "mon06_label_encoding",
    """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label, row_number() OVER (ORDER BY c_custkey) <= floor(0.8 * count(*) OVER ()) AS training
    FROM customer""",
)
def mon06(t):
    """Labels as places in their order, and the first four fifths of rows by key for training."""
    codes = t("customer").select("c_mktsegment").distinct().withColumn("label", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)  # a row per label
    x = t("customer").join(joins.checked_broadcast(codes), "c_mktsegment").select("c_custkey", "label")
    placed = O.running_sums(x, ["c_custkey"], [])
    return A.with_figures(placed, rows().alias("all")).select("c_custkey", "label", (F.col("place") <= F.floor(0.8 * F.col("all"))).alias("training"))


@query(
    "mon07_model_summary",
    f"""WITH {_SCORES} SELECT model, round(arg_max(accuracy, day), 6) AS latest, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day
    DESC) FILTER (WHERE k <= 5) AS last_days FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day DESC) AS
    k FROM scores) GROUP BY 1""",
)
def mon07(t):
    days = F.slice(F.sort_array(F.collect_list(F.col("day").cast("string")), asc=False), 1, 5)
    return scores(t).groupBy("model").agg(r(F.max_by("accuracy", "day")).alias("latest"), F.array_join(days, ",").alias("last_days"))


_SQLI = r"(union +select|or +1 *= *1|drop +table|--|<script|javascript:)"


@query(
    "sec02_event_level",
    """SELECT event_id, CASE WHEN event_type = 'purchase' AND event_id % 5 = 4 THEN 'high' WHEN value > 300 THEN 'medium' ELSE 'low'
    END AS level FROM events""",
)
def sec02(t):
    return t("events").select("event_id", F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 4),
        "high").when(F.col("value") > 300, "medium").otherwise("low").alias("level"))


@query(
    "sec04_signatures",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) // 10 ORDER BY ts, event_id) = 1 AS fresh,
    count(*) OVER (PARTITION BY user_id, date_trunc('minute', ts)) AS rpm FROM events),
    d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS failed, max(rpm) AS rpm, bool_or(fresh) AS fresh FROM x GROUP BY 1, 2),
    h AS (SELECT user_id, day, unnest(['brute_force', 'unusual_traffic', 'suspicious_login']) AS rule, unnest(['high', 'medium', 'medium']) AS severity,
    unnest([failed > 1, rpm > 1, fresh]) AS hit FROM d) SELECT user_id, day, rule, severity, 0.9::DOUBLE AS confidence FROM h WHERE hit""",
)
def sec04(t):
    """Signatures by user and day; the limits are low, as the tables have few attempts."""
    place = F.floor(F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int") / 10)
    first = t("events").groupBy("user_id", place.alias("place")).agg(F.min(F.struct("ts", "event_id")).alias("at")).select("user_id", F.col("at.ts").cast("date").alias("day")).distinct()
    minutes = t("events").groupBy("user_id", F.date_trunc("minute", "ts").alias("m")).agg(rows().alias("rpm"), F.count_if(F.col("event_type") == "error").alias("failed"))
    days = minutes.groupBy("user_id", F.col("m").cast("date").alias("day")).agg(F.sum("failed").alias("failed"), F.max("rpm").alias("rpm"))
    d = days.join(first.withColumn("fresh", F.lit(True)), ["user_id", "day"], "left")
    return signatures(d, ["user_id", "day"], F.col("failed"), F.col("rpm"), F.col("fresh"), attempts=1, per_minute=1)


@query("sec06_trust_level", "SELECT event_id, CASE WHEN '10.0.' || user_id % 200 LIKE '10.0.1%' THEN 'internal' ELSE 'partner' END AS trust FROM events")
def sec06(t):
    ip = F.concat(F.lit("10.0."), F.col("user_id") % 200)
    return t("events").select("event_id", F.when(ip.startswith("10.0.1"), "internal").otherwise("partner").alias("trust"))


@query("sec07_access_matrix", "SELECT event_id, event_type IN ('view', 'click') OR user_id % 3 = 0 AS allowed FROM events")
def sec07(t):
    granted = t("region").filter("r_regionkey < 2").select(F.element_at(F.array(F.lit("view"), F.lit("click")),
        F.col("r_regionkey") + 1).alias("event_type"), F.lit(True).alias("open"))
    return t("events").join(joins.checked_broadcast(granted), "event_type", "left").select("event_id", (F.coalesce("open",
        F.lit(False)) | (F.col("user_id") % 3 == 0)).alias("allowed"))


@query("sec09_recommendations", "SELECT event_type, CASE WHEN count(*) > 2500 THEN 'limit rates' ELSE 'watch' END AS advice FROM events GROUP BY 1")
def sec09(t):
    return t("events").groupBy("event_type").agg(F.when(rows() > 2500, "limit rates").otherwise("watch").alias("advice"))


@query(
    "gov01_pii_masking",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 8, '0') ELSE substr(lpad(CAST(s_suppkey
    AS VARCHAR), 8, '0'), 1, 2) || '******' END AS edrpou, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE split_part(s_name,
    '#', 1) || ' *** ' || split_part(s_name, '#', 2) END AS name FROM supplier""",
)
def gov01(t):
    code, pro = F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.col("s_suppkey") % 3 == 0
    name = F.concat(F.split_part("s_name", F.lit("#"), F.lit(1)), F.lit(" *** "), F.split_part("s_name", F.lit("#"), F.lit(2)))
    return t("supplier").select("s_suppkey", F.when(pro, code).otherwise(F.concat(F.substring(code, 1, 2),
        F.lit("******"))).alias("edrpou"), F.when(pro, F.col("s_name")).otherwise(name).alias("name"))


@query("gov02_access_gate", "SELECT count(*) AS visible FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def gov02(t):
    return t("customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).agg(rows().alias("visible"))


@query(
    "gov03_tiering",
    """SELECT CASE WHEN d < 14 THEN 'hot' WHEN d < 90 THEN 'warm' WHEN d < 2920 THEN 'cold' ELSE 'delete' END AS tier, count(*)
    AS n FROM (SELECT date_diff('day', date, DATE '2001-11-05') AS d FROM records) GROUP BY 1""",
)
def gov03(t):
    d = F.datediff(F.to_date(F.lit("2001-11-05")), F.col("date"))
    return t("records").groupBy(F.when(d < 14, "hot").when(d < 90, "warm").when(d < 2920, "cold").otherwise("delete").alias("tier")).agg(rows().alias("n"))


@query("gov04_retention_inventory", "SELECT p_partkey, p_size * 60 AS retention_days FROM part WHERE p_size * 60 > 2555")
def gov04(t):
    return t("part").select("p_partkey", (F.col("p_size") * 60).alias("retention_days")).filter("retention_days > 2555")


@query("gov05_key_uniqueness", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def gov05(t):
    return t("part").groupBy("p_name").agg(rows().alias("n")).filter("n > 1")
