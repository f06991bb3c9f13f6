"""Queries of retrieval: the benchmark's texts, or the rows whose id is divisible by 100, ask all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators import overlaps as V
from tradescope.operators import retrieval as R
from tradescope.registry import query


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    """Rounded as SQL rounds a double: the digits are scaled first, so a last bit below a half stays below it."""
    return F.round(c * 10.0**digits, 0) / 10.0**digits


_TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"
_WORDS = _TOK.format(x="text")
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def title(text):
    """The first line of a text."""
    return F.split(text, "\n")[0]


_BM25 = f"""p AS (SELECT doc_id, unnest(list_concat({_TOK.format(x="coalesce(text, '')")}, {_TOK.format(x="split_part(coalesce(text, ''), chr(10), 1)")}))
    AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS n FROM p GROUP BY 1, 2), l AS (SELECT doc_id, sum(n) AS l FROM tf GROUP BY 1),
    a AS (SELECT avg(l) AS a, count(*) AS c FROM l), df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1),
    q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, sum(ln(1 + (c - d + 0.5) / (d + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / a))) AS
    score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN l USING (doc_id), a GROUP BY 1, 2)"""


def dealt(rows):
    """Rows on as many tasks as there are cores; a table of few row groups is moved for that, others stay where they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def asked_terms(t):
    return t("benchmark").select("item_id", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("term"))


def text_scores(t):
    postings = R.field_terms(t("documents").select("doc_id", "text"), "doc_id", [(F.col("text"), 1), (title(F.col("text")), 1)])
    return R.bm25(postings, "doc_id", asked_terms(t), "item_id")


@query(
    "ret03_srt05_bm25_top_documents",
    f"""WITH {_BM25} SELECT item_id, doc_id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER
    BY round(score, 5) DESC, doc_id) <= 10""",
)
def ret03(t):
    return R.best(text_scores(t), "item_id", "doc_id", 10)


@query(
    "ret04_vector_top_k",
    f"""SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings
    q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.label = v.label WHERE q.vec_id % 100 = 0) WHERE score >= 0.1 QUALIFY
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
)
def ret04(t):
    e = t("embeddings")
    return R.vector_search(e.filter("vec_id % 100 = 0"), e, least=0.1, k=5, kind=F.col("label")).withColumn("score", r(F.col("score")))


@query(
    "jn16_vector_threshold",
    f"""SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
    WHERE q.vec_id % 100 = 0 AND {_COS} >= 0.3""",
)
def jn16(t):
    e = t("embeddings")
    return R.vector_search(e.filter("vec_id % 100 = 0"), e, least=0.3).withColumn("score", r(F.col("score")))


@query(
    "ret05_hybrid_merge",
    f"""WITH {_BM25}, e AS (SELECT 'document ' || doc_id AS pk, 1.0 AS score FROM documents WHERE source = (SELECT min(source) FROM documents) AND n_chars > 5000),
    v AS (SELECT 'vector ' || v.vec_id AS pk, 1.2 * max({_COS}) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE
    q.vec_id % 100 = 0 AND {_COS} >= 0.3 GROUP BY 1),
    x AS (SELECT 'document ' || doc_id AS pk, least(max(score) / 10.0, 1.0) * 0.8 AS score FROM s WHERE item_id % 10 = 0 GROUP BY 1)
    SELECT pk, round(max(score), 6) AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM v UNION ALL SELECT * FROM x) GROUP
    BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
)
def ret05(t):
    d, e = t("documents"), t("embeddings")
    least = d.agg(F.min("source").alias("least"))
    exact = d.join(F.broadcast(least), F.col("source") == F.col("least")).filter("n_chars > 5000").select(F.concat(F.lit("document "), F.col("doc_id")).alias("pk"))
    near = R.vector_search(e.filter("vec_id % 100 = 0"), e, least=0.3).groupBy(F.concat(F.lit("vector "), F.col("vec_id")).alias("pk")).agg(F.max("score").alias("score"))
    text = text_scores(t).filter("item_id % 10 = 0").groupBy(F.concat(F.lit("document "), F.col("doc_id")).alias("pk")).agg(F.max("score").alias("score"))
    return R.hybrid(exact, near, text)


_SETS = f"q AS (SELECT item_id, list_distinct({_WORDS}) AS q FROM benchmark WHERE item_id % 10 = 0), d AS (SELECT doc_id, list_distinct({_WORDS}) AS w FROM documents)"


def word_sets(t):
    """Every tenth text of the benchmark, and all documents, as sets of words."""
    q = t("benchmark").filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.array_distinct(S.tokens(F.col("text"))).alias("q"))
    return q, dealt(t("documents").select(F.col("doc_id").alias("id"), "text")).select("id", S.tokens(F.col("text")).alias("w"))


def shared_of_all():
    """Shared terms over those of both; null where neither has one."""
    return F.col("shared") / F.nullif(F.col("n_terms") + F.size(F.array_distinct("q")) - F.col("shared"), F.lit(0))


@query(
    "ret06_lexical_overlap",
    f"""WITH {_SETS} SELECT item_id, doc_id, round(len(list_intersect(w, q)) * 1.0 / nullif(len(w) + len(q) - len(list_intersect(w,
    q)), 0), 6)::DOUBLE AS overlap FROM d, q WHERE list_has_any(w, q)""",
)
def ret06(t):
    q, d = word_sets(t)
    return V.all_sharing(q, d).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), r(shared_of_all()).alias("overlap"))


@query(
    "scl21_token_jaccard",
    f"""WITH x AS (SELECT item_id, list_distinct({_WORDS}) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w,
    b.w)) * 1.0 / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 9)::DOUBLE AS similarity FROM x a JOIN
    x b ON a.item_id <> b.item_id WHERE a.item_id % 10 = 0""",
)
def scl21(t):
    x = t("benchmark").select("item_id", F.array_distinct(S.tokens(F.col("text"))).alias("w"))
    a = R.checked_broadcast(x.filter("item_id % 10 = 0").select(F.col("item_id").alias("a"), F.col("w").alias("aw")), 10_000)
    shared = F.size(F.array_intersect("aw", "w"))
    both = F.nullif(F.size("aw") + F.size("w") - shared, F.lit(0))
    return x.join(a, F.col("item_id") != F.col("a")).select("a", F.col("item_id").alias("b"), r(shared / both, 9).alias("similarity"))


_PART = "epoch_ms(date_trunc('day', TIMESTAMP '2024-01-01')) // 1000"
_CONTEXT = f"""{_SETS.replace("SELECT item_id, list_distinct", "SELECT item_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS qn, list_distinct").replace("SELECT doc_id, list_distinct", "SELECT doc_id, n_chars, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS n, doc_id % 40 AS days, list_distinct")},
    f AS (SELECT item_id, doc_id, n_chars, len(list_intersect(q, w)) * 1.0 / nullif(len(q), 0) AS k, len(list_intersect(qn,
    n)) * 1.0 / nullif(len(qn), 0) AS e, CASE WHEN days < 35 THEN greatest(0, 1 - days / 30.0) END AS c,
    len(list_intersect(w, q)) * 1.0 / nullif(len(w) + len(q) - len(list_intersect(w, q)), 0) AS lex FROM d, q WHERE list_has_any(w, q)),
    x AS (SELECT *, list_avg(list_filter([k, e, c], lambda v: v IS NOT NULL)) AS context FROM f)"""


def context_table(t):
    """Documents that share a word with a query."""
    names = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]{3,}"), F.lit(0)))
    q = t("benchmark").filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), names(F.col("text")).alias("qn"), F.array_distinct(S.tokens(F.col("text"))).alias("q"))
    d = dealt(t("documents").select("doc_id", "n_chars", "text")).select(F.col("doc_id").alias("id"), "n_chars", names(F.col("text")).alias("n"), S.tokens(F.col("text")).alias("w"),
        F.expr("CASE WHEN doc_id % 40 < 35 THEN doc_id % 40 END").alias("days"))
    j = V.all_sharing(q, d, ("qn", "n")).withColumnsRenamed({"query_id": "item_id", "id": "doc_id"})
    share = lambda shared, asked: F.col(shared) / F.nullif(F.size(F.array_distinct(asked)), F.lit(0))
    j = j.withColumns({"k": share("shared", "q"), "e": share("also_shared", "qn"), "lex": shared_of_all()})
    return j.withColumn("context", R.context_of_shares(F.col("k"), F.col("e"), F.col("days")))


@query("ret07_context_relevance", f"WITH {_CONTEXT} SELECT item_id, doc_id, round(context, 6)::DOUBLE AS context FROM x")
def ret07(t):
    return context_table(t).select("item_id", "doc_id", r(F.col("context")).alias("context"))


_REL = f"{_CONTEXT}, y AS (SELECT *, 0.4 * coalesce(k, 0) + 0.3 * coalesce(lex, 0) + 0.2 * coalesce(context, 0) + 0.1 * least(n_chars / 2000.0, 1) AS score, 1 - list_stddev_pop(list_filter([k, lex, context], lambda v: v IS NOT NULL)) AS confidence FROM x)"


def relevance_table(t):
    score = R.relevance(F.col("lex"), F.col("k"), F.col("context"), F.least(F.col("n_chars") / 2000.0, F.lit(1.0)))
    return context_table(t).withColumns({"score": score, "confidence": R.agreement(F.col("k"), F.col("lex"), F.col("context"))})


@query(
    "ret08_relevance_score",
    f"""WITH {_REL} SELECT item_id, doc_id, round(score, 6)::DOUBLE AS score, CASE WHEN round(score, 6) >= 0.8 THEN 'high' WHEN round(score,
    6) >= 0.6 THEN 'medium' ELSE 'low' END AS level, round(confidence, 5)::DOUBLE AS confidence FROM y""",
)
def ret08(t):
    s = r(F.col("score"))
    return relevance_table(t).select("item_id", "doc_id", s.alias("score"), R.relevance_level(s).alias("level"), r(F.col("confidence"), 5).alias("confidence"))


@query(
    "flt15_relevance_threshold",
    f"""WITH {_REL} SELECT item_id, count(*) AS n, max(round(score, 6))::DOUBLE AS best FROM y WHERE round(score, 6) >= 0.35 GROUP
    BY 1""",
)
def flt15(t):
    kept = relevance_table(t).withColumn("score", r(F.col("score"))).filter("score >= 0.35")
    return kept.groupBy("item_id").agg(rows().alias("n"), F.max("score").alias("best"))


@query(
    "ret11_knowledge_search",
    f"""WITH q AS (SELECT item_id, list_distinct({_WORDS}) AS q, lower(split_part(text, ' ', 1)) AS head FROM benchmark WHERE item_id % 10 = 0),
    d AS (SELECT doc_id, lower(text) AS body, lower(split_part(text, chr(10), 1)) AS title, list_distinct({_WORDS}) AS w FROM documents),
    s AS (SELECT item_id, doc_id, len(list_intersect(w, q)) + 2 * contains(title, head)::INT + contains(body, head)::INT
    AS score FROM d, q WHERE list_has_any(w, q))
    SELECT item_id, doc_id, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5""",
)
def ret11(t):
    q = t("benchmark").filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.array_distinct(S.tokens(F.col("text"))).alias("q"),
        F.lower(F.split("text", " ")[0]).alias("head"))
    d = t("documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("body"), F.lower(title(F.col("text"))).alias("title"),
        F.array_distinct(S.tokens(F.col("text"))).alias("w"))
    hit = lambda field: F.contains(F.col(field), F.col("head")).cast("int")
    found = V.best_sharing(q, d, 5, lambda shared: (shared + 2 * hit("title") + hit("body")).cast("long"), bonus=3)
    return R.best(found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score"), "item_id", "doc_id", 5, 0)


@query(
    "ret12_tuning",
    f"""WITH {_BM25}, m AS (SELECT item_id, avg(score) AS mean, stddev_pop(score) AS sd, count(*) AS n FROM s GROUP BY 1)
    SELECT item_id, round(mean + sd, 5) AS threshold, CASE WHEN sd / mean > 0.5 THEN 0.5 WHEN n > 100 THEN 0.35 ELSE 0.3 END::DOUBLE AS text_weight FROM m""",
)
def ret12(t):
    m = text_scores(t).groupBy("item_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), rows().alias("n"))
    weight = F.when(F.col("sd") / F.col("mean") > 0.5, 0.5).when(F.col("n") > 100, 0.35).otherwise(0.3)
    return m.select("item_id", r(F.col("mean") + F.col("sd"), 5).alias("threshold"), weight.alias("text_weight"))


@query(
    "ret13_sentence_answer",
    f"""WITH q AS (SELECT item_id, list_distinct({_WORDS}) AS q FROM benchmark WHERE item_id % 10 = 0),
    z AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1),
    'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS s FROM documents),
    w AS (SELECT doc_id, s, list_distinct({_TOK.format(x="s")}) AS w FROM z),
    h AS (SELECT item_id, doc_id, s, len(list_intersect(w, q)) AS hits, len(q) AS n FROM w, q WHERE list_has_any(w, q))
    SELECT item_id, hits::BIGINT AS hits, doc_id, s AS answer, round(hits * 1.0 / n, 6)::DOUBLE AS confidence FROM h QUALIFY
    row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id DESC, s DESC) = 1""",
)
def ret13(t):
    q, _ = word_sets(t)
    s = t("documents").select("doc_id", F.posexplode(S.sentences(F.col("text"))).alias("i", "s"))
    s = s.select(F.struct("doc_id", "i").alias("id"), "doc_id", "s", F.array_distinct(S.tokens(F.col("s"))).alias("w"))
    found = V.best_sharing(q, s, 1, lambda shared: shared.cast("long"))
    top = found.groupBy("query_id").agg(F.max(F.struct("score", "doc_id", "s", F.size("q").alias("n"))).alias("t"))
    return top.select(F.col("query_id").alias("item_id"), F.col("t.score").alias("hits"), "t.doc_id", F.col("t.s").alias("answer"), r(F.col("t.score") / F.col("t.n")).alias("confidence"))


@query(
    "ret14_late_fusion",
    """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
    m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2)
    SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 5) AS similarity, round(sqrt(sum(((a.v
    + b.v) / 2) * ((a.v + b.v) / 2))), 5) AS fused_length FROM m a JOIN m b ON a.label < b.label AND a.i = b.i GROUP BY 1,
    2""",
)
def ret14(t):
    m = t("embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    a, b = m.select(F.col("label").alias("a"), "i", F.col("v").alias("x")), m.select(F.col("label").alias("b"), "i", F.col("v").alias("y"))
    j, dot = a.join(b, "i").filter("a < b"), lambda u, v: F.sum(u * v)
    x, y = F.col("x"), F.col("y")
    return j.groupBy("a", "b").agg(r(dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)), 5).alias("similarity"), r(F.sqrt(dot((x + y) / 2,
        (x + y) / 2)), 5).alias("fused_length"))


@query(
    "txt25_tfidf_similarity",
    f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM
    w GROUP BY 1, 2), df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1),
    v AS (SELECT doc_id, term, n * ln((SELECT count(*) FROM documents) * 1.0 / d) AS x FROM tf JOIN df USING (term)), l AS
    (SELECT doc_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1),
    s AS (SELECT a.doc_id AS query_id, b.doc_id, sum(a.x * b.x) / any_value(la.l) / any_value(lb.l) AS similarity FROM v
    a JOIN v b ON a.term = b.term AND a.doc_id <> b.doc_id JOIN l la ON la.doc_id = a.doc_id JOIN l lb ON lb.doc_id = b.doc_id
    WHERE a.doc_id % 100 = 0 AND a.x > 0 AND b.x > 0 GROUP BY 1, 2)
    SELECT query_id, doc_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.2""",
)
def txt25(t):
    docs = dealt(t("documents").select(F.col("doc_id").alias("id"), "text")).select("id", S.tokens(F.col("text")).alias("w"))
    found = V.cosine_search(docs, F.col("id") % 100 == 0, 0.2)
    return found.select("query_id", F.col("id").alias("doc_id"), r(F.col("similarity")).alias("similarity"))
