"""Text analytics as Columns: statistics, lexicons, keywords, style, summaries. Word lists are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.functions import scalars as S

# Word lists and weights that results depend on (fixed values).
SENTIMENT = {
    "good": 1, "great": 2, "excellent": 2, "amazing": 2, "wonderful": 2, "fantastic": 2, "love": 2, "like": 1, "best": 1,
        "awesome": 2, "perfect": 2, "brilliant": 2, "outstanding": 2, "superb": 2,
    "bad": -1, "terrible": -2, "awful": -2, "hate": -2, "worst": -1, "horrible": -2, "disappointing": -1, "poor": -1,
}
EMOTIONS = {
    "joy": ("happy", "joy", "delight", "pleasure", "excited", "wonderful", "amazing", "great"),
    "sadness": ("sad", "unhappy", "depressed", "sorry", "disappointed", "miserable", "gloomy"),
    "anger": ("angry", "furious", "mad", "annoyed", "irritated", "frustrated", "hate"),
    "fear": ("fear", "afraid", "scared", "terrified", "anxious", "worried", "nervous"),
    "surprise": ("surprise", "amazed", "astonished", "shocked", "unexpected", "wow"),
    "disgust": ("disgust", "disgusted", "repulsive", "gross", "nasty", "awful"),
    "trust": ("trust", "reliable", "honest", "faithful", "confident", "believe"),
    "anticipation": ("hope", "expect", "wait", "anticipate", "look forward", "excited"),
}
CATEGORIES = {
    "positive": ("good", "great", "excellent", "amazing", "wonderful"), "negative": ("bad", "terrible", "awful", "hate", "worst"),
    "technical": ("system", "data", "analysis", "processing", "algorithm"), "business": ("company", "market", "sales", "revenue", "profit"),
}
INTENTS = (
    ("technical_issue", ("error", "bug", "crash", "fail", "broken")), ("how_to_question", ("how to", "how do", "guide", "tutorial")),
    ("billing_inquiry", ("billing", "payment", "cost", "price")), ("feature_request", ("feature", "enhancement", "request")),
)
SUPPORT = {"positive": ("good", "great", "excellent", "thanks", "helpful", "appreciate"), "negative": ("bad", "terrible",
    "awful", "frustrated", "angry", "hate", "worst")}
SUPPORT_EMOTIONS = {"anger": ("frustrated", "angry"), "fear": ("worried", "concerned")}
MARKERS = "however therefore moreover furthermore consequently nevertheless accordingly similarly likewise instead although though despite because since as and but or so then after before while".split()
REQUESTS, THANKS, IMPERATIVES = ("please", "could you", "would you"), ("thank", "thanks", "appreciate"), ("please", "do", "can you", "will you")
STOPS = ("the", "of", "and", "to", "in", "a", "is", "der", "die", "und", "le", "la", "et", "de", "el", "los", "que", "en")


def words(text: Column) -> Column:
    """White-space words in small letters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def count_in(w: Column, names: Sequence[str]) -> Column:
    """How many elements of ``w`` are among the names."""
    return F.size(F.filter(w, lambda x: x.isin(*names))).cast("long")


def holds_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether a text holds one of the parts."""
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is nothing."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def linguistic(text: Column) -> dict[str, Column]:
    """Counts of words: content (no stop word), stop words, in -ing, -ed and -ly, and numbers."""
    w, n = S.tokens(text), lambda f: F.size(F.filter(S.tokens(text), f)).cast("long")
    ends = lambda e: n(lambda x: F.endswith(x, F.lit(e)))
    return {"content": F.size(w).cast("long") - count_in(w, STOPS), "stops": count_in(w, STOPS), "ing": ends("ing"),
        "ed": ends("ed"), "ly": ends("ly"), "numeric": n(lambda x: x.rlike("^[0-9]+$"))}


def syllables(word: Column) -> Column:
    """Groups of vowels, less a last e; 1 where that leaves none."""
    n = F.size(F.regexp_extract_all(word, F.lit("[aeiouy]+"), F.lit(0))) - F.endswith(word, F.lit("e")).cast("int")
    return F.when(n == 0, 1).otherwise(n)


def text_syllables(text: Column) -> Column:
    """Syllables of all words of a text."""
    return F.aggregate(F.transform(S.tokens(text), syllables), F.lit(0), lambda t, x: t + x).cast("long")


def readability(n_words: Column, n_sentences: Column, n_syllables: Column) -> dict[str, Column]:
    """Flesch reading ease from 0 to 100, school grade, and level: easy over 60, standard over 30, else difficult."""
    s, n = F.greatest(n_sentences, F.lit(1)), F.nullif(n_words, F.lit(0))
    times = lambda weight, x: x * round(weight * 1000) / 1000.0  # noqa: E731 - rounded once, as a product of decimals is
    ease = S.clamp(206.835 - times(1.015, n_words) / s - times(84.6, n_syllables) / n, 0.0, 100.0)
    grade = times(0.39, n_words) / s + times(11.8, n_syllables) / n - 15.59
    return {"flesch": ease, "grade": grade, "level": F.when(ease > 60, "easy").when(ease > 30,
        "standard").otherwise("difficult")}


def lexicon_sentiment(w: Column, lexicon: Mapping[str, float] = SENTIMENT) -> dict[str, Column]:
    """score (mean weight of matched words, 0 without), matched, label by bands of .1 of half the score, confidence."""
    weight = F.create_map(*[F.lit(x) for k, v in lexicon.items() for x in (k, float(v))])
    hit = F.filter(w, lambda x: x.isin(*lexicon))
    n, total = F.size(hit), F.aggregate(F.transform(hit, lambda x: weight[x]), F.lit(0.0), lambda t, x: t + x)
    score = share(total, n)
    return {"matched": n.cast("long"), "score": score, "label": F.when(score / 2 > 0.1, "positive").when(score / 2 < -0.1,
        "negative").otherwise("neutral"), "confidence": F.when(n == 0, 0.5).otherwise(F.least(F.lit(0.9), 0.3 + 0.6 * F.abs(score)))}


def emotion_scores(w: Column, lexicon: Mapping[str, Sequence[str]] = EMOTIONS) -> Column:
    """Array of (score, emotion), score being ten times the share of an emotion's words, 1 at most."""
    one = lambda name, names: F.struct(F.least(F.lit(1.0), 10.0 * share(count_in(w, names), F.size(w))).alias("score"),
        F.lit(name).alias("emotion"))
    return F.array(*[one(n, v) for n, v in lexicon.items()])


def top_emotions(scores: Column, k: int = 3) -> Column:
    """The k emotions of the largest positive score, ties by name, as a string."""
    order = F.array_sort(F.transform(F.filter(scores, lambda s: s["score"] > 0), lambda s: F.struct((-s["score"]).alias("s"), s["emotion"].alias("e"))))
    return F.array_join(F.transform(F.slice(order, 1, k), lambda s: s["e"]), ",")


def script_language(text: Column) -> Column:
    """uk or ru where over .3 Cyrillic letters stand for a Latin one (uk by its own letters), else en."""
    count = lambda p: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)))
    own = F.lower(F.coalesce(text, F.lit(""))).rlike("[їє]")
    return F.when(count("[Ё-ԯ]") > 0.3 * count("[\\x00-\\x7f]"), F.when(own, "uk").otherwise("ru")).otherwise("en")


def intent(text: Column, groups=INTENTS) -> Column:
    """The first group with a part in the text, else general_inquiry."""
    found, low = None, F.lower(text)
    for name, parts in groups:
        found = F.when(holds_any(low, parts), name) if found is None else found.when(holds_any(low, parts), name)
    return found.otherwise("general_inquiry")


def support_sentiment(text: Column) -> dict[str, Column]:
    """score: positive less negative words over both, by which parts the text holds; label at .2; emotions."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = lambda names: sum((F.contains(low, F.lit(x)).cast("int") for x in names), F.lit(0))
    p, m = n(SUPPORT["positive"]), n(SUPPORT["negative"])
    score = share(p - m, p + m)
    emotions = F.array_join(F.array_compact(F.array(*[F.when(holds_any(low, v), F.lit(k)) for k, v in SUPPORT_EMOTIONS.items()])), ",")
    return {"score": score, "label": F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral"), "emotions": emotions}


def escalates(found_intent: Column, label: Column, score: Column, best_answer: Column, complexity: Column) -> Column:
    """Whether a case goes up: hard, very negative, without a good answer, or urgent."""
    return (complexity > 8) | ((label == "negative") & (score < -0.5)) | (F.coalesce(best_answer, F.lit(0)) < 2) | (found_intent == "technical_issue")


def sentiment_features(text: Column) -> dict[str, Column]:
    """Fourteen plain features of a text for a sentiment model."""
    w = words(text)
    n = lambda part: S.occurrences(F.coalesce(text, F.lit("")), part)
    chars = F.length(F.coalesce(text, F.lit("")))
    upper = chars - F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Z]", ""))
    good, bad = [k for k, v in SENTIMENT.items() if v > 0], [k for k, v in SENTIMENT.items() if v < 0]
    return {
        "chars": chars.cast("long"), "words": F.size(w).cast("long"), "sentences": F.size(S.sentences(F.coalesce(text,
            F.lit("")))).cast("long"), "mean_word": share(F.aggregate(w, F.lit(0), lambda t, x: t + F.length(x)), F.size(w)),
        "exclamations": n("!"), "questions": n("?"), "commas": n(","), "dots": n("."), "ellipses": n("..."), "upper_share": share(upper,
            chars), "digit_share": share(chars - F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]", "")), chars),
        "positive": count_in(w, good), "negative": count_in(w, bad), "negations": count_in(w, ("not", "no", "never", "none")),
    }


def sentence_kind(s: Column) -> Column:
    """interrogative, exclamatory, imperative or declarative."""
    low, starts = F.lower(F.trim(s)), F.lit(False)
    for part in IMPERATIVES:
        starts = starts | F.startswith(low, F.lit(part))
    return F.when(F.endswith(low, F.lit("?")), "interrogative").when(F.endswith(low, F.lit("!")), "exclamatory").when(starts,
        "imperative").otherwise("declarative")


def speech_acts(text: Column) -> Column:
    """questioning, requesting, thanking, exclaiming as the text shows them, else stating."""
    low = F.lower(text)
    acts = F.array_join(F.array_compact(F.array(F.when(F.contains(text, F.lit("?")), "questioning"), F.when(holds_any(low,
        REQUESTS), "requesting"), F.when(holds_any(low, THANKS), "thanking"), F.when(F.contains(text, F.lit("!")), "exclaiming"))),
        ",")
    return F.when(acts == "", "stating").otherwise(acts)


def style(text: Column) -> dict[str, Column]:
    """Corrected type-token ratio, markers, kinds of sentences, variety of lengths and speech acts."""
    w, s = S.tokens(text), S.sentences(text)
    kinds = F.transform(s, sentence_kind)
    lengths = F.transform(s, lambda x: F.size(S.tokens(x)).cast("double"))
    mean = share(F.aggregate(lengths, F.lit(0.0), lambda t, x: t + x), F.size(lengths))
    spread = F.sqrt(F.greatest(share(F.aggregate(lengths, F.lit(0.0), lambda t, x: t + x * x), F.size(lengths)) - mean * mean, F.lit(0.0)))
    of = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long")
    markers = F.array_join(F.array_sort(F.array_intersect(words(text), F.array(*map(F.lit, MARKERS)))), ",")
    return {"richness": share(F.size(F.array_distinct(w)), F.sqrt(2.0 * F.size(w))), "variety": share(spread, mean),
        "markers": markers, "questions": of("interrogative"), "exclamations": of("exclamatory"), "statements": of("declarative"),
        "orders": of("imperative"), "acts": speech_acts(text)}


def rake(docs: DataFrame, key: str, text: str, longest: int = 3, k: int = 10) -> DataFrame:
    """(key, phrase, score): runs of up to ``longest`` words between stop words and punctuation, by degree over frequency.

    A word's degree is the number of words of the phrases it stands in; a phrase scores the sum of
    its words. Each document's ``k`` best phrases come, ties by phrase.
    """
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", " | "),
        rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(STOPS)})(?![\p{{L}}\p{{N}}])", "|")
    runs = F.transform(F.split(marked, r"\|"), lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    phrases = docs.select(key, F.explode(F.filter(runs, lambda p: (F.size(p) > 0) & (F.size(p) <= longest))).alias("p"))
    scored = phrases.select(key, F.size("p").alias("n"), F.explode("p").alias("w")).groupBy(key, "w").agg((F.sum("n") / F.count(F.lit(1))).alias("s"))
    distinct = phrases.select(key, F.array_join("p", " ").alias("phrase"), F.explode(F.col("p")).alias("w")).distinct()
    found = distinct.join(scored, [key, "w"]).groupBy(key, "phrase").agg(F.round(F.sum("s"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "phrase"))
    return found.withColumn("k", rank).filter(F.col("k") <= k).drop("k")


def aspects(docs: DataFrame, key: str, text: str, names: Sequence[str]) -> DataFrame:
    """(key, aspect, sentences, score): mean lexicon score of the sentences that hold an aspect."""
    s = docs.select(key, F.explode(S.sentences(F.col(text))).alias("s")).withColumn("low", F.lower("s"))
    hit = s.select(key, "low", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(a)), F.lit(a)) for a in names]))).alias("aspect"))
    return hit.groupBy(key, "aspect").agg(F.count(F.lit(1)).alias("sentences"), F.avg(lexicon_sentiment(S.tokens(F.col("low")))["score"]).alias("score"))


def summaries(docs: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """(key, summary): the k best sentences of each text in their order.

    A sentence scores .4 for standing early, .3 for length up to 20 words and .3 for the mean
    share that its words have of the text; ties go to the earlier one.
    """
    s = docs.select(key, F.posexplode(S.sentences(F.col(text))).alias("i", "s")).withColumn("w", S.tokens(F.col("s")))
    each = s.select(key, "i", F.explode("w").alias("word"))
    counts = each.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    figures = s.groupBy(key).agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.size("w")).alias("words"))
    frequent = each.join(counts, [key, "word"]).groupBy(key, "i").agg(F.avg("n").alias("n"))
    j = s.join(figures, key).join(frequent, [key, "i"], "left")
    score = 0.4 * (1.0 - F.col("i") / F.col("sentences")) + 0.3 * F.least(F.size("w") / 20.0,
        F.lit(1.0)) + 0.3 * F.coalesce(F.col("n") / F.col("words"), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "i"))
    best = j.select(key, "i", "s", F.round(score, 9).alias("score")).withColumn("k", rank).filter(F.col("k") <= k)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ").alias("summary"))


def entities(text: Column) -> Column:
    """Array of (kind, value, confidence): edrpou (8 to 10 digits) .9, hs (4 to 10 digits) .8, name (capitalised, over 3 letters) .6; each once."""
    found = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    made = lambda values, kind, c: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"),
        F.lit(c).alias("confidence")))
    digits = lambda low, high: rf"(?<![0-9])[0-9]{{{low},{high}}}(?![0-9])"
    return F.concat(made(found(digits(8, 10)), "edrpou", 0.9), made(found(digits(4, 10)), "hs", 0.8),
        made(found(r"(?<![\p{L}])[A-Z][a-z]{3,}(?![\p{L}])"), "name", 0.6))


#: Operations of a text pipeline by name: text Column in, Column out.
OPERATIONS = {
    "normalise": S.normalise,
    "tokenise": lambda c: S.tokens(c),
    "drop_stops": lambda c: F.filter(c, lambda w: ~w.isin(*STOPS)),
    "distinct": F.array_distinct,
    "join": lambda c: F.array_join(c, " "),
}


def pipeline(text: Column, steps: Sequence[str]) -> Column:
    """Apply operations of OPERATIONS one after the other."""
    for step in steps:
        text = OPERATIONS[step](text)
    return text
