"""Queries of text analytics over all documents and messages, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators import counts as K
from tradescope.operators import texts as T
from tradescope.registry import query


def rows():
    return F.count(F.lit(1))


def r(c, digits=6):
    return F.round(c, digits)


_T = "coalesce(text, '')"
_TOK = rf"regexp_extract_all(lower({_T}), '[\p{{L}}\p{{N}}]+')"
_WS = rf"list_filter(regexp_split_to_array(lower({_T}), '\s+'), lambda x: x <> '')"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace({_T}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
#: The sentiment lexicon with the rude words of the test texts.
LEXICON = T.SENTIMENT | {"idiot": -2, "stupid": -1, "trash": -1, "worthless": -2, "pathetic": -2, "clown": -1, "the": 1, "anon": -1}
def _hits(w, lexicon=None):
    return f"list_filter({w}, lambda x: x IN ({_quoted(lexicon or LEXICON)}))"


def _score(w, lexicon=None):
    values = "MAP {" + ", ".join(f"'{k}': {float(v)}" for k, v in (lexicon or LEXICON).items()) + "}"
    return f"coalesce(list_sum(list_transform({_hits(w, lexicon)}, lambda x: {values}[x])) / nullif(len({_hits(w, lexicon)}), 0), 0)"


def _in(w, names):
    return f"len(list_filter({w}, lambda x: x IN ({_quoted(names)})))"


@query(
    "txt02_linguistic_features",
    f"""WITH x AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, len(w) - {_in("w", T.STOPS)} AS content, {_in("w", T.STOPS)}
    AS stops, len(list_filter(w, lambda x: x LIKE '%ing')) AS ing, len(list_filter(w, lambda x: x LIKE '%ed')) AS ed,
    len(list_filter(w, lambda x: x LIKE '%ly')) AS ly, len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) AS numeric FROM x""",
)
def txt02(t):
    return t("documents").select("doc_id", *[c.alias(n) for n, c in T.linguistic(F.coalesce("text", F.lit(""))).items()])


_SYL = "list_sum(list_transform(w, lambda x: CASE WHEN len(regexp_extract_all(x, '[aeiouy]+')) - (x LIKE '%e')::INT = 0 THEN 1 ELSE len(regexp_extract_all(x, '[aeiouy]+')) - (x LIKE '%e')::INT END))"
_READ = f"x AS (SELECT doc_id, {_TOK} AS w, len({_SENT}) AS s FROM documents), y AS (SELECT doc_id, len(w) AS n, greatest(s, 1) AS s, coalesce({_SYL}, 0) AS y FROM x), f AS (SELECT *, greatest(0, least(100, 206.835 - 1.015 * n / s - 84.6 * y / nullif(n, 0)))::DOUBLE AS ease FROM y)"


@query(
    "txt03_readability",
    f"""WITH {_READ} SELECT doc_id, round(ease, 6) AS flesch, round(0.39 * n / s + 11.8 * y / n - 15.59 + 1e-9, 3)::DOUBLE AS grade, CASE
    WHEN ease > 60 THEN 'easy' WHEN ease > 30 THEN 'standard' ELSE 'difficult' END AS level FROM f WHERE n > 0""",
)
def txt03(t):
    x = t("documents").select("doc_id", F.size(S.tokens(F.col("text"))).alias("n"), F.size(S.sentences(F.col("text"))).alias("s"),
        T.text_syllables(F.col("text")).alias("y")).filter("n > 0")
    f = T.readability(F.col("n"), F.col("s"), F.col("y"))
    ease = F.round(f["flesch"] * 1e6, 0) / 1e6  # scaled first, as SQL rounds a double
    return x.select("doc_id", ease.alias("flesch"), r(f["grade"] + 1e-9, 3).alias("grade"), f["level"].alias("level"))


@query("txt04_syllables", f"WITH x AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, coalesce({_SYL}, 0)::BIGINT AS syllables FROM x")
def txt04(t):
    return t("documents").select("doc_id", T.text_syllables(F.coalesce("text", F.lit(""))).alias("syllables"))


_SENTIMENT = f"x AS (SELECT doc_id, {_WS} AS w FROM documents), s AS (SELECT doc_id, len({_hits('w')}) AS matched, {_score('w')} AS score FROM x)"


def sentiment(t):
    found = T.lexicon_sentiment(F.col("w"), LEXICON)
    return t("documents").select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", *[c.alias(n) for n, c in found.items()])


@query(
    "txt05_lexicon_sentiment",
    f"""WITH {_SENTIMENT} SELECT doc_id, matched, round(score, 6)::DOUBLE AS score, CASE WHEN score / 2 > 0.1 THEN 'positive' WHEN
    score / 2 < -0.1 THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN matched = 0 THEN 0.5 ELSE least(0.9, 0.3
    + 0.6 * abs(score)) END, 6)::DOUBLE AS confidence FROM s""",
)
def txt05(t):
    return sentiment(t).select("doc_id", "matched", r(F.col("score")).alias("score"), "label", r(F.col("confidence")).alias("confidence"))


_EMOTIONS = {**T.EMOTIONS, "anger": (*T.EMOTIONS["anger"], "idiot", "stupid", "clown"), "disgust": (*T.EMOTIONS["disgust"],
    "trash", "disgusting", "scum"), "trust": (*T.EMOTIONS["trust"], "that"), "fear": (*T.EMOTIONS["fear"], "was")}
_EMO = "[" + ", ".join(f"{{'s': -least(1.0, 10.0 * {_in('w', v)} / nullif(len(w), 0)), 'e': '{k}'}}" for k, v in _EMOTIONS.items()) + "]"


@query(
    "txt08_emotion_lexicon",
    f"""WITH x AS (SELECT doc_id, {_WS} AS w FROM documents), e AS (SELECT doc_id, {_EMO} AS e FROM x) SELECT doc_id, array_to_string(list_transform(list_sort(list_filter(e,
    lambda v: v.s < 0))[1:3], lambda v: v.e), ',') AS top, coalesce(round(-list_min(list_transform(e, lambda v: v.s)), 6),
    0)::DOUBLE AS intensity FROM e""",
)
def txt08(t):
    e = t("documents").select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", T.emotion_scores(F.col("w"), _EMOTIONS).alias("e"))
    return e.select("doc_id", T.top_emotions(F.col("e")).alias("top"), r(F.array_max("e")["score"]).alias("intensity"))


@query("txt26_semantic_categories",
    "WITH x AS (SELECT doc_id, " + _WS + " AS w FROM documents) SELECT doc_id, " + ", ".join(f"{_in('w', v)} AS {k}" for k,
    v in {**T.CATEGORIES, "abusive": ("idiot", "stupid", "trash", "scum")}.items()) + " FROM x")
def txt26(t):
    x = t("documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return x.select("doc_id", *[T.count_in(F.col("w"), v).alias(k) for k, v in {**T.CATEGORIES, "abusive": ("idiot", "stupid", "trash", "scum")}.items()])


@query(
    "txt06_txt07_message_sentiment",
    f"""WITH x AS (SELECT conv_id, turn, lower({_T}) AS t FROM conversations), c AS (SELECT *, {" + ".join(f"contains(t, '{w}')::INT" for w in (*T.SUPPORT["positive"], "the"))}
    AS p, {" + ".join(f"contains(t, '{w}')::INT" for w in (*T.SUPPORT["negative"], "was"))} AS m FROM x)
    SELECT conv_id, turn, round(coalesce((p - m) * 1.0 / nullif(p + m, 0), 0), 6)::DOUBLE AS score, round((coalesce((p -
    m) * 1.0 / nullif(p + m, 0), 0) + 1) / 2, 6)::DOUBLE AS scaled FROM c""",
)
def txt07(t):
    low = F.lower(F.coalesce("text", F.lit("")))
    n = lambda names: sum((F.contains(low, F.lit(x)).cast("int") for x in names), F.lit(0))
    p, m = n((*T.SUPPORT["positive"], "the")), n((*T.SUPPORT["negative"], "was"))
    score = T.share(p - m, p + m)
    return t("conversations").select("conv_id", "turn", r(score).alias("score"), r((score + 1) / 2).alias("scaled"))


@query(
    "txt09_sentiment_features",
    f"""WITH x AS (SELECT doc_id, {_T} AS text, {_WS} AS w, len({_SENT}) AS sentences FROM documents) SELECT doc_id, length(text)
    AS chars, len(w) AS words, sentences, round(coalesce(list_sum(list_transform(w, lambda x: length(x))) * 1.0 / nullif(len(w),
    0), 0), 6)::DOUBLE AS mean_word,
    length(text) - length(replace(text, '!', '')) AS exclamations, length(text) - length(replace(text, '?', '')) AS questions, length(text) - length(replace(text, ',', '')) AS commas, length(text) - length(replace(text, '.', '')) AS dots, (length(text) - length(replace(text, '...', ''))) // 3 AS ellipses,
    round(coalesce(len(regexp_extract_all(text, '[A-Z]')) * 1.0 / nullif(length(text), 0), 0), 6)::DOUBLE AS upper_share, round(coalesce(len(regexp_extract_all(text, '[0-9]')) * 1.0 / nullif(length(text), 0), 0), 6)::DOUBLE AS digit_share,
    {_in("w", [k for k, v in T.SENTIMENT.items() if v > 0])} AS positive, {_in("w", [k for k, v in T.SENTIMENT.items() if v < 0])}
    AS negative, {_in("w", ("not", "no", "never", "none"))} AS negations FROM x""",
)
def txt09(t):
    f = T.sentiment_features(F.col("text"))
    return t("documents").select("doc_id", *[(r(c) if n.endswith("_share") or n == "mean_word" else c).alias(n) for n, c in f.items()])


_ASPECTS = ("river", "tion", "kunft", "the ", "que ")


@query(
    "txt10_aspect_sentiment",
    f"""WITH z AS (SELECT doc_id, lower(unnest({_SENT})) AS s FROM documents), a AS (SELECT doc_id, s, unnest([{_quoted(_ASPECTS)}])
    AS aspect FROM z), h AS (SELECT doc_id, aspect, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+') AS w FROM a WHERE contains(s,
    aspect)) SELECT doc_id, aspect, count(*) AS sentences, round(avg({_score('w', T.SENTIMENT)}), 6)::DOUBLE AS score FROM
    h GROUP BY 1, 2""",
)
def txt10(t):
    return T.aspects(t("documents"), "doc_id", "text", _ASPECTS).withColumn("score", r(F.col("score")))


@query(
    "txt11_language_indicators",
    f"""WITH x AS (SELECT doc_id, {_T} AS t, {_TOK} AS w FROM documents) SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '[Ё-ԯ]'))
    > 0.3 * len(regexp_extract_all(t, '[\\x00-\\x7f]')) THEN CASE WHEN regexp_matches(lower(t), '[їє]') THEN 'uk' ELSE 'ru'
    END ELSE 'en' END AS script, {_in('w', ('the', 'of', 'and', 'to'))} AS en, {_in('w', ('der', 'die', 'und', 'den'))} AS
    de, {_in('w', ('и', 'в', 'не', 'на'))} AS ru, {_in('w', ('і', 'та', 'що', 'не'))} AS uk FROM x""",
)
def txt11(t):
    w = S.tokens(F.coalesce("text", F.lit("")))
    groups = {"en": ("the", "of", "and", "to"), "de": ("der", "die", "und", "den"), "ru": ("и", "в", "не", "на"), "uk": ("і", "та", "що", "не")}
    return t("documents").select("doc_id", T.script_language(F.col("text")).alias("script"), *[T.count_in(w, v).alias(k) for k, v in groups.items()])


_ENT = r"""list_transform(list_distinct(list_filter(regexp_extract_all({t}, '[0-9]+'), lambda v: length(v) BETWEEN 8 AND 10)), lambda v: {{'kind': 'edrpou', 'value': v}}) || list_transform(list_distinct(list_filter(regexp_extract_all({t}, '[0-9]+'), lambda v: length(v) BETWEEN 4 AND 10)), lambda v: {{'kind': 'hs', 'value': v}})
    || list_transform(list_distinct(list_filter(regexp_extract_all({t}, '\p{{L}}+'), lambda v: regexp_matches(v, '^[A-Z][a-z]{{3,}}$'))), lambda v: {{'kind': 'name', 'value': v}})"""


@query(
    "txt13_udf02_regex_entities",
    f"""WITH x AS (SELECT doc_id, unnest({_ENT.format(t=_T)}) AS e FROM documents) SELECT e.kind AS kind, e.value AS value, count(*)
    AS n, CASE e.kind WHEN 'edrpou' THEN 0.9 WHEN 'hs' THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM x GROUP BY 1, 2""",
)
def txt13(t):
    e = t("documents").select("doc_id", F.explode(T.entities(F.coalesce("text", F.lit("")))).alias("e")).select("e.*")
    return e.groupBy("kind", "value", "confidence").agg(rows().alias("n"))


@query("txt14_rake")
def txt14(t):
    return T.rake(t("documents"), "doc_id", "text")


@query(
    "txt15_position_keywords",
    f"""WITH w AS (SELECT doc_id, unnest({_TOK}) AS term, unnest(range(0, len({_TOK}))) AS i FROM documents), p AS (SELECT doc_id,
    term, max(1.0 / (i + 1)) AS place, count(*) AS n FROM w GROUP BY 1, 2), m AS (SELECT doc_id, max(n) AS most FROM p GROUP
    BY 1) SELECT doc_id, term, round((place + n * 1.0 / most) / 2, 6)::DOUBLE AS score FROM p JOIN m USING (doc_id) QUALIFY
    row_number() OVER (PARTITION BY doc_id ORDER BY round((place + n * 1.0 / most) / 2, 6) DESC, term) <= 5""",
)
def txt15(t):
    lists = K.term_lists(t("documents"), "doc_id", S.tokens(F.coalesce("text", F.lit(""))))
    most = F.array_max(F.transform("terms", lambda x: x["n"]))
    p = lists.withColumn("most", most).select("doc_id", "most", F.explode("terms").alias("x"))  # the most once a document
    score = F.round((1.0 / (F.col("x.first") + 1) + F.col("x.n") / F.col("most")) / 2, 6)
    return K.best_terms(p.select("doc_id", "x.term", score.alias("score")), "doc_id", 5)


@query(
    "txt16_leading_sentences",
    rf"""WITH z AS (SELECT doc_id, unnest({_SENT}) AS s, unnest(range(0, len({_SENT}))) AS i FROM documents), w AS (SELECT
    *, regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+') AS w FROM z), e AS (SELECT doc_id, i, unnest(w) AS word FROM w),
    c AS (SELECT doc_id, word, count(*) AS n FROM e GROUP BY 1, 2),
    f AS (SELECT doc_id, count(*) AS sentences, sum(len(w)) AS words FROM w GROUP BY 1), q AS (SELECT doc_id, i, avg(n) AS
    n FROM e JOIN c USING (doc_id, word) GROUP BY 1, 2),
    k AS (SELECT doc_id, i, s, round(0.4 * (1.0 - i / sentences) + 0.3 * least(len(w) / 20.0, 1.0) + 0.3 * coalesce(q.n /
    words, 0), 9) AS score FROM w JOIN f USING (doc_id) LEFT JOIN q USING (doc_id, i))
    SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS summary FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY
    doc_id ORDER BY score DESC, i) <= 3) GROUP BY 1""",
)
def txt16(t):
    return T.summaries(t("documents"), "doc_id", "text")


@query(
    "txt18_cohesion",
    rf"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS s, unnest(range(0, len({_SENT}))) AS i FROM documents), w AS (SELECT doc_id,
    i, list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) AS w FROM s) SELECT a.doc_id, round(avg(coalesce(len(list_intersect(a.w,
    b.w)) * 1.0 / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 0)), 6)::DOUBLE AS cohesion FROM w a JOIN
    w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 GROUP BY 1""",
)
def txt18(t):
    w = t("documents").select("doc_id", F.transform(S.sentences(F.coalesce("text", F.lit(""))), lambda s: F.array_distinct(S.tokens(s))).alias("w")).filter("size(w) > 1")
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), S.jaccard)
    return w.select("doc_id", r(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.size("w") - 1)).alias("cohesion"))


@query(
    "txt19_style",
    rf"""WITH x AS (SELECT doc_id, {_T} AS text, lower({_T}) AS low, {_TOK} AS w, {_WS} AS v, {_SENT} AS s FROM documents),
    k AS (SELECT *, list_transform(s, lambda z: len(regexp_extract_all(lower(z), '[\p{{L}}\p{{N}}]+'))) AS l FROM x)
    SELECT doc_id, round(coalesce(len(list_distinct(w)) / nullif(sqrt(2.0 * len(w)), 0), 0), 6)::DOUBLE AS richness, round(coalesce(list_stddev_pop(l)
    / nullif(list_avg(l), 0), 0), 5)::DOUBLE AS variety, array_to_string(list_sort(list_distinct(list_filter(v, lambda z:
    z IN ({_quoted(T.MARKERS)})))), ',') AS markers,
    len(list_filter(s, lambda z: z LIKE '%?')) AS questions, len(list_filter(s, lambda z: z LIKE '%!')) AS exclamations,
    coalesce(nullif(concat_ws(',', CASE WHEN contains(text, '?') THEN 'questioning' END, CASE WHEN contains(low, 'please')
    OR contains(low, 'could you') OR contains(low, 'would you') THEN 'requesting' END,
    CASE WHEN contains(low, 'thank') OR contains(low, 'appreciate') THEN 'thanking' END, CASE WHEN contains(text, '!') THEN
    'exclaiming' END), ''), 'stating') AS acts FROM k""",
)
def txt19(t):
    f = T.style(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", r(f["richness"]).alias("richness"), r(f["variety"], 5).alias("variety"),
        "text").select("doc_id", "richness", "variety", *[T.style(F.coalesce("text", F.lit("")))[n].alias(n) for n in ("markers",
        "questions", "exclamations", "acts")])


#: Intents with words that the test messages have.
_INTENTS = (("technical_issue", ("error", "bug", "crash", "fail", "broken", "whing")), ("how_to_question", ("how to",
    "how do", "guide", "tutorial", "erthe")), ("billing_inquiry", ("billing", "payment", "cost", "price", "tionth")),
    ("feature_request", ("feature", "enhancement", "request", "onth")))
_INTENT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({_T}), {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{name}'" for name,
    parts in _INTENTS) + " ELSE 'general_inquiry' END"


@query("txt22_intent", f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations")
def txt22(t):
    return t("conversations").select("conv_id", "turn", T.intent(F.coalesce("text", F.lit("")), _INTENTS).alias("intent"))


_P, _M = (" + ".join(f"contains(lower({_T}), '{w}')::INT" for w in T.SUPPORT[k]) for k in ("positive", "negative"))


@query(
    "txt23_escalation",
    f"""SELECT conv_id, turn, length({_T}) / 100.0 > 8 OR {_INTENT} = 'technical_issue' OR turn % 5 < 2 OR coalesce((({_P}) - ({_M}))
    * 1.0 / nullif(({_P}) + ({_M}), 0), 0) < -0.5 AS escalates FROM conversations""",
)
def txt23(t):
    text = F.coalesce("text", F.lit(""))
    s = T.support_sentiment(text)
    up = T.escalates(T.intent(text, _INTENTS), s["label"], s["score"], F.col("turn") % 5, F.length(text) / 100.0)
    return t("conversations").select("conv_id", "turn", up.alias("escalates"))


@query(
    "txt24_text_pipeline",
    f"""SELECT doc_id, array_to_string(list_filter({_TOK.replace(_T, 'trim(regexp_replace(regexp_replace(lower(' + _T + '), ' + chr(39) + '[!-/:-@[-`{-~]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '))')}, lambda x: x NOT IN ({_quoted(T.STOPS)})), ' ') AS text FROM documents""",
)
def txt24(t):
    return t("documents").select("doc_id", T.pipeline(F.coalesce("text", F.lit("")), ["normalise", "tokenise", "drop_stops", "join"]).alias("text"))


@query(
    "txt27_complexity",
    f"""SELECT doc_id, round(least(10, length({_T}) / 1000.0 + (length({_T}) - length(replace({_T}, ',', ''))) * 0.05 + {_in(_TOK, ('compare', 'why', 'trend', 'that', 'which'))}
    * 0.2), 6)::DOUBLE AS complexity FROM documents""",
)
def txt27(t):
    text = F.coalesce("text", F.lit(""))
    score = F.length(text) / 1000.0 + S.occurrences(text, ",") * 0.05 + T.count_in(S.tokens(text), ("compare", "why", "trend", "that", "which")) * 0.2
    return t("documents").select("doc_id", r(F.least(F.lit(10.0), score)).alias("complexity"))


@query(
    "txt28_corpus_sentiment",
    f"""WITH {_SENTIMENT} SELECT round(avg(score), 6)::DOUBLE AS mean, round(stddev_pop(score), 6)::DOUBLE AS deviation, count(*)
    FILTER (WHERE score > 0.1) AS positive, count(*) FILTER (WHERE score < -0.1) AS negative, count(*) FILTER (WHERE abs(score)
    <= 0.1) AS neutral FROM s""",
)
def txt28(t):
    s = F.col("score")
    return sentiment(t).agg(r(F.avg(s)).alias("mean"), r(F.stddev_pop(s)).alias("deviation"), F.count_if(s > 0.1).alias("positive"),
        F.count_if(s < -0.1).alias("negative"), F.count_if(F.abs(s) <= 0.1).alias("neutral"))


@query(
    "txt29_capitalised_entities",
    f"""SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all({_T}, '[A-Za-z]+'), lambda x: length(x) > 3 AND regexp_matches(x,
    '^[A-Z]')))) AS entities FROM documents""",
)
def txt29(t):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    return t("documents").select("doc_id", F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 3) & x.rlike("^[A-Z]")))).alias("entities"))


@query(
    "txt30_document_bundle",
    f"""WITH {_READ}, s AS (SELECT doc_id, len({_hits(_WS)}) AS matched, {_score(_WS)} AS score, length({_T}) AS chars, len(list_distinct(list_filter(regexp_extract_all({_T},
    '[A-Za-z]+'), lambda x: length(x) > 3 AND regexp_matches(x, '^[A-Z]')))) AS entities FROM documents)
    SELECT doc_id, chars, n AS words, round(ease, 5) AS flesch, round(score, 6)::DOUBLE AS sentiment, entities FROM s JOIN f USING (doc_id)""",
)
def txt30(t):
    text = F.coalesce("text", F.lit(""))
    capitals = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: (F.length(x) > 3) & x.rlike("^[A-Z]")))
    x = t("documents").select("doc_id", F.length(text).cast("long").alias("chars"), F.size(S.tokens(text)).cast("long").alias("words"),
        F.size(S.sentences(text)).alias("s"), T.text_syllables(text).alias("y"), T.words(text).alias("w"), F.size(capitals).cast("long").alias("entities"))
    ease = T.readability(F.col("words"), F.col("s"), F.col("y"))["flesch"]
    return x.select("doc_id", "chars", "words", r(F.when(F.col("words") > 0, ease), 5).alias("flesch"), r(T.lexicon_sentiment(F.col("w"),
        LEXICON)["score"]).alias("sentiment"), "entities")
