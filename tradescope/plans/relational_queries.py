"""Queries of filters, joins, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators import ordered as O
from tradescope.operators import counts as K
from tradescope.operators import filters, joins
from tradescope.registry import query


@query(
    "q_top_companies",
    """SELECT company_name, round(sum(amount), 4) AS total, count(*) AS n FROM records WHERE hs_code LIKE '80%' AND year(date) =
    1997 GROUP BY company_name ORDER BY total DESC, company_name LIMIT 10""",
)
def q_top_companies(t):
    found = filters.where(t("records"), hs_prefix="80", year=1997)
    return found.groupBy("company_name").agg(F.round(F.sum("amount"), 4).alias("total"),
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("total"), "company_name").limit(10)


_RAW = "SELECT pk, CASE WHEN n % 50 = 0 THEN 'x1' ELSE ' ' || hs_code || ' ' END AS hs_code, CASE WHEN n % 70 = 0 THEN NULL ELSE date END AS date, CASE WHEN n % 90 = 0 THEN -1.0 ELSE qty END AS qty, CASE WHEN n % 110 = 0 THEN 'N1' ELSE country_code END AS country_code FROM (SELECT *, order_id + line_number AS n FROM records)"


def raw_records(t):
    """Records as text, some of them broken."""
    r = t("records").withColumn("n", F.col("order_id") + F.col("line_number"))
    bad = lambda k, value, good: F.when(F.col("n") % k == 0, value).otherwise(good)
    return r.select("pk", bad(50, F.lit("x1"), F.concat(F.lit(" "), F.col("hs_code"), F.lit(" "))).alias("hs_code"),
        bad(70, F.lit(None), F.col("date").cast("string")).alias("date"), F.lit(None).cast("string").alias("amount"), bad(90,
        F.lit("-1"), F.col("qty").cast("string")).alias("qty"), bad(110, F.lit("n1"), F.lower("country_code")).alias("country_code"),
        "company_name")


@query("flt01_typed_records", f"SELECT pk, trim(hs_code) AS hs_code, date, 0.0::DOUBLE AS amount, qty, country_code FROM ({_RAW})")
def flt01(t):
    return filters.typed_records(raw_records(t)).drop("company_name")


@query(
    "flt02_record_validity",
    f"""SELECT pk, concat_ws(',', CASE WHEN trim(hs_code) = 'x1' THEN 'hs_code' END, CASE WHEN date IS NULL THEN 'date' END, CASE
    WHEN qty < 0 THEN 'qty' END, CASE WHEN country_code = 'N1' THEN 'country_code' END) AS errors FROM ({_RAW}) WHERE trim(hs_code)
    = 'x1' OR date IS NULL OR qty < 0 OR country_code = 'N1'""",
)
def flt02(t):
    typed = filters.typed_records(raw_records(t)).withColumn("e", filters.record_errors())
    return typed.filter(F.size("e") > 0).select("pk", F.array_join("e", ",").alias("errors"))


@query(
    "flt03_conditional_where",
    """SELECT pk, round(amount, 4) AS amount FROM records WHERE hs_code LIKE '801%' AND year(date) = 1998 AND country_code = 'NA'
    AND amount >= 1000""",
)
def flt03(t):
    return filters.where(t("records"), hs_prefix="801", year=1998, country="NA", amount_min=1000.0).select("pk", F.round("amount", 4).alias("amount"))


@query(
    "flt04_search_request",
    """SELECT pk, date, count(*) OVER () AS total FROM records WHERE amount >= 20000 AND (company_name ILIKE '%0000001%' OR hs_code
    ILIKE '%0000001%' OR customs_office ILIKE '%0000001%') AND date >= DATE '1996-01-01' ORDER BY date DESC, pk LIMIT 20
    OFFSET 10""",
)
def flt04(t):
    found = filters.where(t("records"), amount_min=20000.0, text="0000001", date_from="1996-01-01")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc("date"), "pk").offset(10).limit(20).join(F.broadcast(total)).select("pk", "date", "total")


@query(
    "flt05_scan_window",
    """SELECT pk, company_id FROM records WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' AND hs_code LIKE '80%' AND
    amount >= 500""",
)
def flt05(t):
    return filters.where(t("records"), hs_prefix="80", date_from="1997-03-01", date_to="1997-06-30", amount_min=500.0).select("pk", "company_id")


@query(
    "flt06_query_text_to_filters",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(8000 + o_orderkey % 50 AS VARCHAR) END AS hs_prefix, year(o_orderdate)
    AS year, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS amount_min FROM orders""",
)
def flt06(t):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Imports "), F.when(k % 3 == 0, F.concat(F.lit("of code "), 8000 + k % 50)).otherwise(""),
        F.lit(" in "), F.year("o_orderdate"), F.when(k % 2 == 0, F.concat(F.lit(" over "), k % 1000)).otherwise(""))
    return t("orders").select("o_orderkey", filters.parse_query_text(text).alias("f")).select("o_orderkey", "f.hs_prefix", "f.year", "f.amount_min")


@query("flt07_semantic_predicate", "SELECT item_id, regexp_matches(lower(text), 'similar|like|about|than') AS semantic FROM benchmark")
def flt07(t):
    return t("benchmark").select("item_id", F.lower("text").rlike("similar|like|about|than").alias("semantic"))


@query(
    "flt08_bool_search",
    """SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)') AND lang = 'en' AND n_chars
    BETWEEN 500 AND 3000 AND source LIKE 'src1%' ORDER BY doc_id DESC LIMIT 100""",
)
def flt08(t):
    return t("documents").filter(F.lower("text").rlike("(^|[^a-z])the([^a-z]|$)") & (F.col("lang") == "en") & F.col("n_chars").between(500,
        3000) & F.col("source").startswith("src1")).orderBy(F.desc("doc_id")).limit(100).select("doc_id", "source")


@query("flt09_equality_map", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id = 7")
def flt09(t):
    return filters.equal_to(t("events"), {"event_type": "error", "user_id": 7}).select("event_id")


@query(
    "flt10_sql_rule_violations",
    """SELECT count(*) FILTER (WHERE NOT l_quantity > 10) AS low_quantity, count(*) FILTER (WHERE NOT l_discount <= 0.05) AS high_discount
    FROM lineitem""",
)
def flt10(t):
    return t("lineitem").agg(filters.violations(t("lineitem"), "l_quantity > 10").alias("low_quantity"), filters.violations(t("lineitem"),
        "l_discount <= 0.05").alias("high_discount"))


@query(
    "flt11_expression_rule",
    """SELECT l_returnflag, count(*) FILTER (WHERE NOT (l_tax < l_discount OR l_quantity * 2 > 60)) AS violations FROM lineitem
    GROUP BY 1""",
)
def flt11(t):
    return t("lineitem").groupBy("l_returnflag").agg(filters.violations(t("lineitem"), "l_tax < l_discount OR l_quantity * 2 > 60").alias("violations"))


@query(
    "flt12_recommendation_filters",
    """SELECT DISTINCT item_id, category FROM interactions WHERE category IN (1, 3, 5) AND price BETWEEN 50 AND 200 AND rating >=
    2 AND item_id NOT IN (SELECT item_id FROM interactions WHERE user_id = 3)""",
)
def flt12(t):
    i = t("interactions")
    found = i.filter(F.col("category").isin(1, 3, 5) & F.col("price").between(50, 200) & (F.col("rating") >= 2))
    return joins.in_list(found, "item_id", i.filter("user_id = 3").select("item_id"), negate=True).select("item_id", "category").distinct()


@query("flt13_retention", "SELECT event_type, ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS AS archived, count(*) AS n FROM events GROUP BY 1, 2")
def flt13(t):
    return filters.retention(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2024-01-31 00:00:00",
        7).groupBy("event_type", "archived").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt14_relative_ranges",
    """SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAYS) AS week, count(*) FILTER (WHERE ts
    > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR) AS hour, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 12:00:00'
    - INTERVAL 15 MINUTES) AS quarter FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def flt14(t):
    e, at = t("events").withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-20 12:00:00"
    n = lambda name: F.count_if(F.expr(f"ts > TIMESTAMP '{at}' - {filters.interval_of(name)}"))
    return filters.within(e, "ts", at, "last_7_days").agg(n("last_7_days").alias("week"), n("1h").alias("hour"), n("15m").alias("quarter"))


@query(
    "flt16_graph_update",
    """WITH e AS (SELECT src, dst, weight FROM edges UNION SELECT company_id, company_id + 1, 1 FROM companies WHERE company_id
    % 5 = 0), n AS (SELECT company_id AS id FROM companies WHERE company_id % 10 <> 3) SELECT src, dst, max(weight) AS weight
    FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.src
    = e.src AND x.dst = e.dst AND e.weight = 1 AND x.weight <> 1) GROUP BY src, dst""",
)
def flt16(t):
    nodes = t("companies").select(F.col("company_id").alias("id"))
    more = t("companies").filter("company_id % 5 = 0").select(F.col("company_id").alias("src"), (F.col("company_id") + 1).alias("dst"),
        F.lit(1).cast("long").alias("weight"))
    more = more.join(t("edges").select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight")
    return filters.update_graph(nodes, t("edges"), nodes.limit(0), more, nodes.filter("id % 10 = 3"))[1]


@query("jn01_inner_equi", "SELECT pk, c.company_name, registration_date FROM records r JOIN companies c USING (company_id) WHERE amount > 40000")
def jn01(t):
    return t("records").filter("amount > 40000").select("pk", "company_id").join(t("companies"), "company_id").select("pk", "company_name", "registration_date")


@query("jn02_partner_pairs", "SELECT src AS a, dst AS b, weight AS shared FROM edges WHERE weight >= 3")
def jn02(t):
    return t("edges").filter("weight >= 3").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("shared"))


@query("jn05_left_anti", "SELECT pk FROM records WHERE order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def jn05(t):
    return joins.in_list(t("records").select("pk", "order_id"), "order_id", t("orders").filter("o_orderstatus = 'F'").select("o_orderkey"),
        negate=True).select("pk")


_LISTS = "SELECT company_id AS pk, 1.0 AS score, 'table' AS source FROM companies WHERE company_id % 2 = 0 UNION ALL SELECT company_id, company_id % 10 / 10.0 * 1.2, 'vector' FROM companies WHERE company_id % 3 = 0 UNION ALL SELECT company_id, least(company_id % 20 / 10.0, 1.0) * 0.8, 'text' FROM companies WHERE company_id % 5 = 0"


def ranked_lists(t):
    c, i = t("companies"), F.col("company_id")
    one = lambda k, score, name: c.filter(i % k == 0).select(i.alias("pk"), score.cast("double").alias("score"), F.lit(name).alias("source"))
    return one(2, F.lit(1.0), "table"), one(3, i % 10 / 10.0 * 1.2, "vector"), one(5, F.least(i % 20 / 10.0, F.lit(1.0)) * 0.8, "text")


@query(
    "jn06_multi_source_merge",
    f"""SELECT pk, round(max(score)::DOUBLE, 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ({_LISTS})
    GROUP BY pk""",
)
def jn06(t):
    return joins.merge_ranked(*ranked_lists(t)).withColumn("score", F.round("score", 6))


@query("jn07_date_join", "SELECT a.date, a.amount AS actual, b.amount AS forecast FROM daily a JOIN daily b ON a.date = b.date + INTERVAL 7 DAYS")
def jn07(t):
    d = t("daily")
    return d.select("date", F.col("amount").alias("actual")).join(d.select(F.date_add("date", 7).alias("date"), F.col("amount").alias("forecast")), "date")


@query(
    "jn08_group_stats_map_back",
    """SELECT pk, round(avg(amount) OVER (PARTITION BY hs_code), 4) AS hs_mean, count(*) OVER (PARTITION BY company_id) AS company_n
    FROM records""",
)
def jn08(t):
    x = joins.map_back(t("records"), "hs_code", F.round(F.avg("amount"), 4).alias("hs_mean"))
    return joins.map_back(x, "company_id", F.count(F.lit(1)).alias("company_n")).select("pk", "hs_mean", "company_n")


@query("jn10_threat_lookup", "SELECT event_id, user_id % 200 AS net FROM events WHERE user_id % 200 IN (3, 17, 44)")
def jn10(t):
    feed = t("nation").filter("n_nationkey IN (3, 17)").select(F.col("n_nationkey").cast("long").alias("net")).union(t("nation").filter("n_nationkey = 4").select((F.col("n_nationkey") * 11).cast("long")))
    return t("events").select("event_id", (F.col("user_id") % 200).alias("net")).join(F.broadcast(feed), "net").select("event_id", "net")


@query("jn11_block_list", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def jn11(t):
    return joins.in_list(t("events").select("event_id", "user_id"), "user_id", t("customer").filter("c_acctbal < 0").select("c_custkey")).select("event_id")


@query(
    "jn12_label_links",
    """SELECT DISTINCT a.n_nationkey AS src, b.n_nationkey AS dst FROM (SELECT n_name, n_regionkey FROM nation) r JOIN nation a
    ON a.n_name = r.n_name JOIN nation b ON b.n_regionkey = r.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
)
def jn12(t):
    n = t("nation")
    relations = n.select(F.col("n_name").alias("from_text"), "n_regionkey").join(n.select(F.col("n_name").alias("to_text"),
        "n_regionkey"), "n_regionkey").select("from_text", "to_text")
    ids = lambda text, name: n.select(F.col("n_name").alias(text), F.col("n_nationkey").alias(name))
    return relations.join(ids("from_text", "src"), "from_text").join(ids("to_text", "dst"), "to_text").filter("src <> dst").select("src", "dst").distinct()


_BOTH = "both_ways AS (SELECT src AS node, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"


@query(
    "jn13_common_neighbours",
    f"""WITH {_BOTH} SELECT a.node AS a, b.node AS b, count(*) AS shared FROM both_ways a JOIN both_ways b ON a.other = b.other AND
    a.node < b.node GROUP BY 1, 2""",
)
def jn13(t):
    return joins.common_neighbours(t("edges"))


@query("jn14_ground_truth", "SELECT d.doc_id, coalesce(l.quality, 0) AS relevance FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def jn14(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("relevance"))


@query(
    "jn15_store_consistency",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'missing_right' WHEN o_orderkey % 89 = 0 THEN 'mismatch' ELSE 'ok'
    END AS status FROM orders""",
)
def jn15(t):
    left = t("orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderstatus", "o_custkey"), 256).alias("digest"))
    right = t("orders").filter("o_orderkey % 97 <> 0").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderstatus",
        F.when(F.col("o_orderkey") % 89 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))), 256).alias("digest"))
    return joins.consistency(left, right, "o_orderkey", "digest")


@query(
    "jn17_preferred_category",
    """WITH liked AS (SELECT DISTINCT user_id, category FROM interactions WHERE rating >= 4) SELECT event_id, CASE WHEN l.user_id
    IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM interactions i LEFT JOIN liked l ON l.user_id = i.user_id AND
    l.category = i.category""",
)
def jn17(t):
    i = t("interactions")
    liked = i.filter("rating >= 4").select("user_id", "category", F.lit(True).alias("liked")).distinct()
    return i.join(liked, ["user_id", "category"], "left").select("event_id", F.when(F.col("liked"), 0.7).otherwise(0.5).alias("score"))


@query(
    "jn18_unlinked_pairs",
    f"""WITH {_BOTH} SELECT a.node AS a, b.node AS b, count(*) AS shared FROM both_ways a JOIN both_ways b ON a.other = b.other AND
    a.node < b.node WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.node AND e.dst = b.node) GROUP BY 1, 2 HAVING
    count(*) >= 2""",
)
def jn18(t):
    return joins.common_neighbours(t("edges"), 2, linked=False)


@query(
    "jn19_endpoint_semi_join",
    """SELECT src, dst, weight FROM edges WHERE src IN (SELECT company_id FROM companies WHERE balance > 0) AND dst IN (SELECT company_id
    FROM companies WHERE balance > 0)""",
)
def jn19(t):
    good = t("companies").filter("balance > 0").select("company_id")
    return joins.in_list(joins.in_list(t("edges"), "src", good), "dst", good).select("src", "dst", "weight")


@query("srt01_latest_rows", "SELECT pk, date FROM records WHERE hs_code LIKE '801%' ORDER BY date DESC, pk LIMIT 1000")
def srt01(t):
    return filters.where(t("records"), hs_prefix="801").orderBy(F.desc("date"), "pk").limit(1000).select("pk", "date")


@query(
    "srt02_severity_order",
    """SELECT event_id, severity FROM (SELECT event_id, CASE WHEN value / 500 >= 0.95 THEN 'critical' WHEN value / 500 >= 0.9 THEN
    'high' WHEN value / 500 >= 0.75 THEN 'medium' ELSE 'low' END AS severity FROM events) ORDER BY CASE severity WHEN 'critical'
    THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, event_id LIMIT 50""",
)
def srt02(t):
    e = t("events").select("event_id", S.severity(F.col("value") / 500).alias("severity"))
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    return e.orderBy(rank.desc(), "event_id").limit(50)


@query("srt03_pagination", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100")
def srt03(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(25).select("o_orderkey", "o_totalprice")


@query(
    "srt04_top_terms_per_document",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), c AS (SELECT
    doc_id, term, count(*) AS n FROM w GROUP BY 1, 2) SELECT doc_id, term, n FROM c QUALIFY row_number() OVER (PARTITION
    BY doc_id ORDER BY n DESC, term) <= 10""",
)
def srt04(t):
    c = K.postings(K.term_lists(t("documents"), "doc_id", S.tokens(F.col("text"))), "doc_id")
    return K.best_terms(c.select("doc_id", "term", F.col("n").alias("score")), "doc_id", 10).withColumnRenamed("score", "n")


@query("srt06_hashed_sample", "SELECT p_partkey FROM part ORDER BY sha256('7:' || p_partkey), p_partkey LIMIT 100")
def srt06(t):
    return t("part").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("p_partkey")), 256), "p_partkey").limit(100).select("p_partkey")


@query(
    "srt07_top_z",
    """WITH s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS d FROM records) SELECT pk, round((amount - m) / d, 6) AS z FROM
    records, s ORDER BY abs((amount - m) / d) DESC, pk LIMIT 50""",
)
def srt07(t):
    r = t("records")
    s = r.agg(F.avg("amount").alias("m"), F.stddev_pop("amount").alias("d"))
    z = (F.col("amount") - F.col("m")) / F.col("d")
    return r.join(F.broadcast(s)).withColumn("z", z).orderBy(F.abs("z").desc(), "pk").limit(50).select("pk", F.round("z", 6).alias("z"))


@query(
    "srt08_key_factors",
    """SELECT s_nationkey AS dimension, s_suppkey AS factor, s_acctbal FROM supplier WHERE s_acctbal > 1000 QUALIFY row_number()
    OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= 3""",
)
def srt08(t):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return t("supplier").filter("s_acctbal > 1000").withColumn("r",
        F.row_number().over(w)).filter("r <= 3").select(F.col("s_nationkey").alias("dimension"), F.col("s_suppkey").alias("factor"),
        "s_acctbal")


@query(
    "srt09_priority_queue",
    """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
    END AS place FROM orders ORDER BY place, o_orderkey LIMIT 200""",
)
def srt09(t):
    needed = t("orders").filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit(0).alias("promoted"))
    return t("orders").join(needed, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", F.coalesce("promoted",
        F.substring("o_orderpriority", 1, 1).cast("int")).alias("place")).orderBy("place", "o_orderkey").limit(200)


@query(
    "set01_hash_dedup_keep_first",
    """SELECT business_hash, min(pk) AS pk, count(*) - 1 AS duplicates FROM (SELECT pk, substr(sha256(concat_ws('|', hs_code, company_name,
    year(date))), 1, 16) AS business_hash FROM records) GROUP BY 1""",
)
def set01(t):
    r = t("records").select("pk", S.short_hash(F.concat_ws("|", "hs_code", "company_name", F.year("date"))).alias("business_hash"))
    return r.groupBy("business_hash").agg(F.min("pk").alias("pk"), (F.count(F.lit(1)) - 1).alias("duplicates"))


@query("set02_alert_dedup", "SELECT DISTINCT order_id, company_id, hs_code FROM records")
def set02(t):
    return t("records").select("order_id", "company_id", "hs_code").dropDuplicates()


@query(
    "set03_union_of_detectors",
    """SELECT pk, 'round' AS rule, 0.6::DOUBLE AS confidence FROM records WHERE qty % 10 = 0 AND amount > 60000 UNION ALL SELECT
    pk, 'large', 0.75 FROM records WHERE amount > 80000 UNION ALL SELECT pk, 'office', 0.9 FROM records WHERE customs_office
    = 'ASIA' AND amount > 70000""",
)
def set03(t):
    r = t("records")
    rule = lambda cond, name, c: F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(c).alias("confidence")))
    found = F.array_compact(F.array(rule((F.col("qty") % 10 == 0) & (F.col("amount") > 60000), "round", 0.6), rule(F.col("amount") > 80000,
        "large", 0.75), rule((F.col("customs_office") == "ASIA") & (F.col("amount") > 70000), "office", 0.9)))
    return r.select("pk", F.explode(found).alias("f")).select("pk", "f.*")


@query(
    "set04_union_of_sources",
    """SELECT 'event' AS source, event_id AS id, event_type AS kind, NULL::VARCHAR AS lang FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'document', doc_id, NULL, lang FROM documents""",
)
def set04(t):
    a = t("events").filter("event_type = 'error'").select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return a.unionByName(t("documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), "lang"), allowMissingColumns=True)


@query(
    "set05_union_of_outliers",
    """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS
    b FROM events) SELECT event_id FROM events, s WHERE abs(value - m) > 3 * d OR value < a - 1.5 * (b - a) OR value > b
    + 1.5 * (b - a)""",
)
def set05(t):
    e = t("events")
    s = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d")).join(F.broadcast(O.quantile_figures(e, "value", a=0.25, b=0.75)))
    return e.join(F.broadcast(s)).filter("abs(value - m) > 3 * d OR value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)").select("event_id")


@query("set06_entity_dedup", "SELECT upper(substr(c_mktsegment, 1, 4)) || '-' || c_nationkey AS canonical_key, count(*) AS n FROM customer GROUP BY 1")
def set06(t):
    return t("customer").select(F.concat_ws("-", F.upper(F.substring("c_mktsegment", 1, 4)), "c_nationkey").alias("canonical_key")).groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n"))


@query("set07_key_differences", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set07(t):
    return t("customer").select("c_custkey").subtract(t("orders").filter("o_orderstatus = 'O'").select("o_custkey"))


@query("set08_duplicate_groups", "SELECT pk, order_id, line_number FROM records QUALIFY count(*) OVER (PARTITION BY order_id, line_number) > 1")
def set08(t):
    n = F.count(F.lit(1)).over(Window.partitionBy("order_id", "line_number"))
    return t("records").withColumn("n", n).filter("n > 1").select("pk", "order_id", "line_number")
