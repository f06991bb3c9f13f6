"""Queries of risk scoring, retrieval, recommendation and text analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators import ordered as O
from tradescope.operators import aggregates as A
from tradescope.operators import counts as K
from tradescope.operators import dimensions as D
from tradescope.operators import joins
from tradescope.operators import overlaps as V
from tradescope.operators import recommend as R
from tradescope.registry import query


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    return F.round(c, digits)


# risk


@query("rsk01_round_values", "SELECT event_id FROM events WHERE CAST(value * 100 AS BIGINT) % 1000 = 0 AND value >= 100")
def rsk01(t):
    return t("events").filter((F.round(F.col("value") * 100).cast("long") % 1000 == 0) & (F.col("value") >= 100)).select("event_id")


@query(
    "rsk04_new_company_high_value",
    """WITH q AS (SELECT quantile_cont(amount, 0.9) AS q FROM records) SELECT pk FROM records JOIN companies USING (company_id),
    q WHERE date_diff('day', registration_date, date) < 365 AND amount > q""",
)
def rsk04(t):
    x = t("records").join(F.broadcast(O.quantile_figures(t("records"), "amount", q=0.9))).filter("amount > q")
    return x.join(t("companies").select("company_id", "registration_date"), "company_id").filter(F.datediff("date", "registration_date") < 365).select("pk")


@query(
    "rsk06_timing",
    """WITH m AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, epoch_ms(h)
    // 1000 AS at, n FROM m WHERE n > 1 AND n > (SELECT quantile_cont(n, 0.95) FROM m)""",
)
def rsk06(t):
    m = t("events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(rows().alias("n"))
    return A.with_figures(m, F.percentile("n", 0.95).alias("q")).filter("n > 1 AND n > q").select("user_id", F.unix_timestamp("h").alias("at"), "n")


@query(
    "rsk08_company_risk",
    """WITH a AS (SELECT company_id, count(*) AS alerts FROM records WHERE amount > 90000 GROUP BY 1), d AS (SELECT company_id,
    count(*) AS n FROM records GROUP BY 1) SELECT company_id, least(100, 10 * coalesce(alerts, 0) + n / 10.0)::DOUBLE AS
    score, CASE WHEN least(100, 10 * coalesce(alerts, 0) + n / 10.0) >= 70 THEN 'high' WHEN least(100, 10 * coalesce(alerts,
    0) + n / 10.0) >= 40 THEN 'medium' ELSE 'low' END AS level FROM d LEFT JOIN a USING (company_id)""",
)
def rsk08(t):
    g = t("records").groupBy("company_id").agg(F.count_if(F.col("amount") > 90000).alias("a"), rows().alias("n"))
    s = F.least(F.lit(100.0), 10 * F.col("a") + F.col("n") / 10.0)
    return g.select("company_id", s.alias("score"), A.tier(s, (70, "high"), (40, "medium"), otherwise="low").alias("level"))


_FACTORS = """g AS (SELECT company_id, balance, nation_id, sum(amount) AS total, avg(amount) AS mean, stddev_samp(amount) AS sd, sum(qty) AS qty, count(*) FILTER (WHERE amount > 90000) AS large,
    count(DISTINCT hs_code) AS products FROM companies JOIN records USING (company_id) GROUP BY 1, 2, 3),
    f AS (SELECT company_id AS e, 'liquidity_ratio' AS factor, balance / 5000 AS v, NULL AS rating FROM g UNION ALL SELECT company_id, 'debt_to_equity', qty / 50000, NULL FROM g
    UNION ALL SELECT company_id, 'cash_flow_volatility', sd / mean / 2, NULL FROM g
    UNION ALL SELECT company_id, 'credit_rating', NULL, ['AAA', 'bb', 'CCC', 'X'][nation_id % 4 + 1] FROM g UNION ALL SELECT company_id, 'audit_findings', large / 3.0, NULL FROM g
    UNION ALL SELECT company_id, 'regulatory_fines', total / 100, NULL FROM g UNION ALL SELECT company_id, 'customer_satisfaction', nation_id % 5, NULL FROM g
    UNION ALL SELECT company_id, 'media_mentions', products, NULL FROM g UNION ALL SELECT company_id, 'market_share', least(1, total / 5e7), NULL FROM g
    UNION ALL SELECT company_id, 'unheard_of', 1, NULL FROM g),
    i AS (SELECT e, factor, CASE factor WHEN 'liquidity_ratio' THEN greatest(0, least(1, 2 - v)) WHEN 'debt_to_equity' THEN least(1, v / 2) WHEN 'cash_flow_volatility' THEN least(1, v * 2)
    WHEN 'credit_rating' THEN CASE upper(rating) WHEN 'AAA' THEN 0 WHEN 'BB' THEN 0.6 WHEN 'CCC' THEN 1 ELSE 0.5 END WHEN 'audit_findings' THEN least(1, v / 10) WHEN 'regulatory_fines' THEN least(1, v / 1e6)
    WHEN 'customer_satisfaction' THEN 1 - v / 5.0 WHEN 'media_mentions' THEN least(1, v / 50.0) WHEN 'market_share' THEN 1 - v END AS risk,
    CASE factor WHEN 'liquidity_ratio' THEN 0.15 WHEN 'debt_to_equity' THEN 0.2 WHEN 'cash_flow_volatility' THEN 0.1 WHEN 'credit_rating' THEN 0.2 WHEN 'audit_findings' THEN 0.3
    WHEN 'regulatory_fines' THEN 0.25 WHEN 'customer_satisfaction' THEN 0.25 WHEN 'media_mentions' THEN 0.2 WHEN 'market_share' THEN 0.2 END AS weight FROM f WHERE factor <> 'unheard_of'),
    w AS (SELECT e, factor, risk, risk * weight AS impact FROM i), p AS (PIVOT w ON factor IN ('liquidity_ratio', 'debt_to_equity', 'cash_flow_volatility', 'credit_rating', 'audit_findings',
    'regulatory_fines', 'customer_satisfaction', 'media_mentions', 'market_share') USING sum(impact) GROUP BY e),
    d AS (SELECT e, 'financial' AS dimension, liquidity_ratio + debt_to_equity + 0.15 + cash_flow_volatility + credit_rating AS score FROM p
    UNION ALL SELECT e, 'operational', 0.25 + 0.2 FROM p UNION ALL SELECT e, 'compliance', audit_findings + regulatory_fines + 0.1 FROM p
    UNION ALL SELECT e, 'reputational', customer_satisfaction + media_mentions + 0.2 + 0.15 FROM p UNION ALL SELECT e, 'strategic', market_share + 0.2 + 0.15 * 3 FROM p)"""


def company_factors(t):
    """Ten figures of each company as risk factors, one of them without a rule; nine of the 28 that have one."""
    g = t("companies").join(t("records"), "company_id").groupBy("company_id", "balance", "nation_id").agg(F.sum("amount").alias("total"), F.avg("amount").alias("mean"),
        F.stddev_samp("amount").alias("sd"), F.sum("qty").alias("qty"), F.count_if(F.col("amount") > 90000).alias("large"), F.count_distinct("hs_code").alias("products"))
    none = F.lit(None).cast("string")
    given = {
        "liquidity_ratio": F.col("balance") / 5000, "debt_to_equity": F.col("qty") / 50000, "cash_flow_volatility": F.col("sd") / F.col("mean") / 2, "credit_rating": F.lit(None),
        "audit_findings": F.col("large") / 3.0, "regulatory_fines": F.col("total") / 100, "customer_satisfaction": F.col("nation_id") % 5, "media_mentions": F.col("products"),
        "market_share": F.least(F.lit(1.0), F.col("total") / 5e7), "unheard_of": F.lit(1.0),
    }
    rating = F.get(F.array(*[F.lit(x) for x in ("AAA", "bb", "CCC", "X")]), (F.col("nation_id") % 4).cast("int"))
    rows_ = [F.struct(F.lit(k).alias("factor"), v.cast("double").alias("value"), (rating if k == "credit_rating" else none).alias("rating")) for k, v in given.items()]
    return g.select(F.col("company_id").alias("entity_id"), F.explode(F.array(*rows_)).alias("f")).select("entity_id", "f.*")


@query("rsk19_dimension_risks", f"WITH {_FACTORS} SELECT e AS entity_id, dimension, round(score, 6)::DOUBLE AS score FROM d")
def rsk19(t):
    return D.dimension_risks(company_factors(t)).withColumn("score", r(F.col("score")))


@query(
    "rsk19_rsk20_risk_levels",
    f"""WITH {_FACTORS}, o AS (SELECT e, sum(score * CASE dimension WHEN 'financial' THEN 0.25 WHEN 'reputational' THEN 0.15 ELSE 0.2 END) AS s FROM d GROUP BY 1)
    SELECT e AS entity_id, round(s, 6)::DOUBLE AS score, CASE WHEN s < 0 THEN 'critical' WHEN s < 0.3 THEN 'low' WHEN s < 0.6 THEN 'medium' WHEN s < 0.8 THEN 'high' ELSE 'critical' END AS level FROM o""",
)
def rsk20(t):
    return D.overall_risk(D.dimension_risks(company_factors(t))).withColumn("score", r(F.col("score")))


@query("rsk22_factor_importance", f"WITH {_FACTORS} SELECT e AS entity_id, factor, round(risk, 6)::DOUBLE AS risk, round(impact, 6)::DOUBLE AS impact FROM w")
def rsk22(t):
    return D.factor_importance(company_factors(t)).select("entity_id", "factor", r(F.col("risk")).alias("risk"), r(F.col("impact")).alias("impact"))


@query(
    "rsk25_before_after",
    """WITH x AS (SELECT event_type, avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (WHERE ts >=
    TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1) SELECT event_type, round(b - a, 6) AS change, CASE WHEN abs(b -
    a) / a > 0.05 THEN 'high' ELSE 'low' END AS severity FROM x""",
)
def rsk25(t):
    early = F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    x = t("events").groupBy("event_type").agg(F.avg(F.when(early, F.col("value"))).alias("a"), F.avg(F.when(~early, F.col("value"))).alias("b"))
    return x.select("event_type", r(F.col("b") - F.col("a")).alias("change"), F.when(F.abs(F.col("b") - F.col("a")) / F.col("a") > 0.05,
        "high").otherwise("low").alias("severity"))


@query(
    "rsk26_auto_resolution",
    """SELECT user_id, CASE WHEN max(value) > 400 AND arg_max(value, (ts, event_id)) < 100 THEN 'resolved' ELSE 'active' END AS
    status FROM events GROUP BY 1""",
)
def rsk26(t):
    return t("events").groupBy("user_id").agg(F.when((F.max("value") > 400) & (F.max_by("value", F.struct("ts",
        "event_id")) < 100), "resolved").otherwise("active").alias("status"))


# text


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(
    "txt01_text_statistics",
    f"""SELECT doc_id, length(text) AS chars, len({_TOK}) AS words, round(len(list_distinct({_TOK})) * 1.0 / nullif(len({_TOK}),
    0), 6)::DOUBLE AS diversity FROM documents""",
)
def txt01(t):
    d = t("documents").select("doc_id", F.length("text").cast("long").alias("chars"), S.tokens(F.col("text")).alias("w"))
    n = F.size("w")
    return d.select("doc_id", "chars", n.cast("long").alias("words"), r(F.size(F.array_distinct("w")) / F.nullif(n, F.lit(0))).alias("diversity"))


_TFIDF = f"w AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1)"


def token_index(t):
    """Postings: doc_id, term, n."""
    return K.postings(K.term_lists(t("documents"), "doc_id", S.tokens(F.col("text"))), "doc_id").select("doc_id", "term", "n")


@query(
    "txt12_keywords_tfidf",
    f"""WITH {_TFIDF} SELECT doc_id, term, round(n * ln((SELECT count(*) FROM documents) * 1.0 / d), 6)::DOUBLE AS score FROM tf
    JOIN df USING (term) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(n * ln((SELECT count(*) FROM documents)
    * 1.0 / d), 6) DESC, term) <= 5""",
)
def txt12(t):
    tf = token_index(t)
    df = tf.groupBy("term").agg(rows().alias("d"))
    j = tf.join(joins.checked_broadcast(df, V.BROADCAST_TERMS), "term").join(F.broadcast(t("documents").agg(rows().alias("docs"))))
    return K.best_terms(j.withColumn("score", r(F.col("n") * F.log(F.col("docs") / F.col("d")))), "doc_id", 5)


@query("txt20_log_parse", "SELECT event_id, split_part(line, ' - ', 2) AS level, substr(line, 1, 19) AS at FROM logs")
def txt20(t):
    line = r"^([0-9-]{10} [0-9:]{8}) - ([A-Z]+) - (.*)$"
    return t("logs").select("event_id", F.coalesce(F.nullif(F.regexp_extract("line", line, 2), F.lit("")), F.lit("UNKNOWN")).alias("level"),
        F.regexp_extract("line", line, 1).alias("at"))


@query(
    "txt21_log_fields",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'error' THEN 'TimeoutError' ELSE '' END AS error_type,
    CAST(event_id % 997 AS BIGINT) AS ms, CASE WHEN event_type = 'error' THEN 504 ELSE 200 END AS status FROM events""",
)
def txt21(t):
    f = lambda p: F.regexp_extract("line", p, 1)
    return t("logs").select("event_id", f("user_id=([0-9]+)").alias("user_id"), f("([A-Z][A-Za-z]+Error)").alias("error_type"),
        f("took ([0-9]+)ms").cast("long").alias("ms"), f("with ([0-9]{3})").cast("int").alias("status"))


# retrieval


@query("ret01_search_text", "SELECT pk, concat_ws(' ', company_name, hs_code, customs_office, country_code) AS full_text FROM records")
def ret01(t):
    return t("records").select("pk", F.concat_ws(" ", "company_name", "hs_code", "customs_office", "country_code").alias("full_text"))


@query("ret02_token_index", f"WITH {_TFIDF} SELECT doc_id, term, n FROM tf WHERE term NOT IN ('the', 'of', 'and')")
def ret02(t):
    return token_index(t).filter(~F.col("term").isin("the", "of", "and"))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


_RANKED = "ranked AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY n_chars DESC, d.doc_id) AS rank, coalesce(quality, 0) AS rel FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def ranked(t):
    j = t("documents").select("doc_id", "source", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", "source", F.coalesce("quality", F.lit(0)).alias("rel"),
        F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


@query(
    "ret09_precision_recall",
    f"""WITH {_RANKED} SELECT source, round(sum(rel) FILTER (WHERE rank <= 5) / 5.0, 6)::DOUBLE AS p5, round(sum(rel) FILTER (WHERE
    rank <= 10) / 10.0, 6)::DOUBLE AS p10, round(sum(rel) FILTER (WHERE rank <= 10) * 1.0 / nullif(sum(rel), 0), 6)::DOUBLE
    AS r10 FROM ranked GROUP BY 1""",
)
def ret09(t):
    top = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")))
    return ranked(t).groupBy("source").agg(r(top(5) / 5.0).alias("p5"), r(top(10) / 10.0).alias("p10"), r(top(10) / F.nullif(F.sum("rel"),
        F.lit(0))).alias("r10"))


@query(
    "ret10_mrr_map_ndcg",
    f"""WITH {_RANKED}, c AS (SELECT *, sum(rel) OVER (PARTITION BY source ORDER BY rank) AS hits, row_number() OVER (PARTITION BY
    source ORDER BY rel DESC, rank) AS ideal FROM ranked) SELECT source, round(max(rel * 1.0 / rank), 6)::DOUBLE AS mrr,
    round(avg(1.0 / rank) FILTER (WHERE rel = 1), 6)::DOUBLE AS mean_rr_all, round(avg(hits * 1.0 / rank) FILTER (WHERE rel
    = 1), 6)::DOUBLE AS ap_found, round(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(ideal + 1)), 0), 6)::DOUBLE AS
    ndcg FROM c GROUP BY 1""",
)
def ret10(t):
    w = Window.partitionBy("source")
    c = ranked(t).withColumns({"hits": F.sum("rel").over(w.orderBy("rank")), "ideal": F.row_number().over(w.orderBy(F.desc("rel"), "rank"))})
    hit = lambda x: F.when(F.col("rel") == 1, x)
    gain = lambda p: F.sum(F.col("rel") / F.log2(F.col(p) + 1))
    return c.groupBy("source").agg(r(F.max(F.col("rel") / F.col("rank"))).alias("mrr"),
        r(F.avg(hit(1.0 / F.col("rank")))).alias("mean_rr_all"), r(F.avg(hit(F.col("hits") / F.col("rank")))).alias("ap_found"),
        r(gain("rank") / F.nullif(gain("ideal"), F.lit(0.0))).alias("ndcg"))


# recommendation


@query(
    "rec03_item_similarity",
    """WITH x AS (SELECT DISTINCT user_id, item_id FROM interactions WHERE rating >= 2), n AS (SELECT item_id, count(*) AS n FROM
    x GROUP BY 1) SELECT a.item_id AS a, b.item_id AS b, round(count(*) / sqrt(any_value(na.n) * any_value(nb.n)), 6) AS
    similarity FROM x a JOIN x b ON a.user_id = b.user_id AND a.item_id < b.item_id JOIN n na ON na.item_id = a.item_id JOIN
    n nb ON nb.item_id = b.item_id GROUP BY 1, 2 HAVING count(*) >= 4""",
)
def rec03(t):
    liked = t("interactions").filter("rating >= 2").select("user_id", "item_id").distinct()
    n = liked.groupBy("item_id").agg(rows().alias("n"))
    pairs = joins.partner_pairs(liked, "user_id", "item_id", least=4)
    j = pairs.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", r(F.col("shared") / F.sqrt(F.col("na") * F.col("nb"))).alias("similarity"))


@query("rec06_popularity", "SELECT item_id, count(*) AS n FROM interactions WHERE rating >= 3 GROUP BY 1 ORDER BY n DESC, item_id LIMIT 20")
def rec06(t):
    return t("interactions").filter("rating >= 3").groupBy("item_id").agg(rows().alias("n")).orderBy(F.desc("n"), "item_id").limit(20)


@query(
    "rec08_explanations",
    """SELECT item_id, CASE WHEN avg(rating) >= 2 THEN 'rated well' WHEN count(*) > 100 THEN 'popular' ELSE 'new' END AS reason
    FROM interactions GROUP BY 1""",
)
def rec08(t):
    return t("interactions").groupBy("item_id").agg(F.when(F.avg("rating") >= 2, "rated well").when(rows() > 100, "popular").otherwise("new").alias("reason"))


@query(
    "rec10_rec11_feed",
    """WITH u AS (SELECT user_id, category, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) AS base, avg(rating) / 3 AS engagement FROM interactions GROUP BY 1, 2),
    x AS (SELECT i.user_id, event_id, i.category, base, engagement, CASE event_type WHEN 'error' THEN 1.5 WHEN 'purchase' THEN 1.3 WHEN 'view' THEN 0.7 ELSE 1 END AS priority,
    CASE WHEN i.user_id % 4 = 0 THEN 0.5 WHEN item_id % 9 = 0 THEN 0.3 WHEN item_id % 9 IN (i.user_id % 9, (i.user_id + 1) % 9) THEN 1 ELSE 0.4 END AS company,
    CASE WHEN i.user_id % 3 = 0 AND contains(event_type, 'err') THEN 0.1 WHEN contains(event_type, 'purchase') THEN 0.9 WHEN contains(event_type, 'sign') THEN 0.8 ELSE 0.5 END AS topic,
    CASE WHEN hour(ts) BETWEEN 8 AND 20 THEN 0.8 ELSE 0.4 END AS time, CASE i.user_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END AS volume
    FROM interactions i JOIN u ON u.user_id = i.user_id AND u.category = i.category),
    s AS (SELECT *, round(0.3 * base + 0.25 * engagement + 0.2 * priority + 0.15 * company + 0.05 * topic + 0.05 * time, 9) AS score, floor(20 * volume) AS size FROM x),
    c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, event_id) <= greatest(2, floor(size / 5)))
    SELECT user_id, event_id, round(score, 6)::DOUBLE AS score FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) <= size""",
)
def rec10(t):
    """Feeds of 20 items at normal volume; what the tables lack (companies, topics, volumes) is made from ids."""
    i = t("interactions")
    own = i.groupBy("user_id", "category").agg(rows().alias("n"), (F.avg("rating") / 3).alias("engagement"))
    own = own.join(i.groupBy("user_id").agg(rows().alias("all")), "user_id").withColumn("base", F.col("n") / F.col("all")).drop("n", "all")
    x, user, item = i.join(own, ["user_id", "category"]), F.col("user_id"), F.col("item_id")
    no_names, no_topics = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    priority = F.when(F.col("event_type") == "error", "urgent").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "view", "low")
    company = R.company_relevance(F.when(item % 9 == 0, no_names).otherwise(F.array((item % 9).cast("long"))),
        F.when(user % 4 == 0, no_names).otherwise(F.array((user % 9).cast("long"), ((user + 1) % 9).cast("long"))))
    topic = R.topic_relevance(F.col("event_type"), F.array(*map(F.lit, ("Purchase", "chase", "sign"))), F.when(user % 3 == 0, F.array(F.lit("err"))).otherwise(no_topics))
    time = F.when(F.hour("ts").between(8, 20), 0.8).otherwise(0.4)
    score = r(R.feed_score(F.col("base"), F.col("engagement"), priority, company, topic, time), 9)
    volume = F.element_at(F.array(*map(F.lit, ("minimal", "normal", "extensive"))), (user % 3 + 1).cast("int"))
    feed = R.feed_selection(x.select("user_id", "event_id", "category", score.alias("score"), volume.alias("volume")), "user_id", "category", "score", "event_id", "volume", 20)
    return feed.select("user_id", "event_id", r(F.col("score")).alias("score"))

