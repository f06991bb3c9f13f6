"""Quality rules: base counts, then divergence from language references.

SQL functions only. A document's histogram of character classes and of common words is compared
by Jensen-Shannon distance with the mean histogram of its language; references are sums over all
documents. Nothing but the reference sums is shuffled. Expressions that are used more than once
in a lambda are bound by a one-element array first, as Spark would otherwise compute them again
for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ensure_checkpoint_dir

#: Common words of four languages (fixed values).
COMMON = ("the", "of", "and", "to", "der", "die", "und", "den", "le", "la", "les", "et", "el", "los", "que", "en")
#: Character classes; what is in none of them is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", "[ \\t-\\r]+", "[#*$%&|<>=_~^@{}\\[\\]/\\\\+]+")
#: References of so many languages at most are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_LANGUAGES = 10_000


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than a blank and 9 to 13."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Number of word positions inside 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes, put in order with their places; places of windows with
    an equal neighbour are then put in order, and each covers up to the next, three at most.
    """

    def places(windows: Column) -> Column:
        near = lambda i, h: F.coalesce(F.get(windows, i)["h"] == h, F.lit(False))
        return F.sort_array(F.transform(F.filter(windows, lambda w, i: near(i - 1, w["h"]) | near(i + 1, w["h"])), lambda w: w["p"]))

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(index, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))

    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x,
        F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return bind(bind(windows(words), places), covered).cast("long")


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def counts_of(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each document, with its two histograms; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    length = F.length(text)
    counts = docs.select("doc_id", "lang", F.struct(
        bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat"),
            common_words(w).alias("common"))).alias("w"),
        F.array(*[(length - F.length(F.regexp_replace(text, c, ""))).cast("double") for c in CLASSES]).alias("classes"),
        length.alias("length"),
        (length - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
    ).alias("c"))
    return counts.select(
        "doc_id", "lang", F.col("c.w.n").alias("n_words"), (F.col("c.length") - F.col("c.classes")[3]).cast("long").alias("word_chars"),
            F.col("c.n_symbols").alias("n_symbols"), F.col("c.n_dup_lines").alias("n_dup_lines"), F.col("c.w.repeat").alias("n_repeat_words"),
        F.concat("c.classes", F.array(F.col("c.length") - total(F.col("c.classes")))).alias("chars"), F.col("c.w.common").alias("common"),
    )


def equals(value: str) -> Callable[[Column], Column]:
    """A predicate for filter()."""
    return lambda x: x == value


def common_words(words: Column) -> Column:
    """How often each common word stands by itself in small letters, and the number of other words."""
    counted = bind(F.filter(words, lambda w: w.isin(*COMMON)), lambda h: F.concat(F.array(*[F.size(F.filter(h,
        equals(c))).cast("double") for c in COMMON]), F.array(-F.size(h).cast("double"))))
    return F.transform(counted, lambda v, i: F.when(i < len(COMMON), v).otherwise(F.size(words) + v))


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; null if one is empty."""

    def part(x: Column) -> Column:
        m = (x["a"] + x["b"]) / 2
        return (F.when(x["a"] > 0, x["a"] * F.log2(x["a"] / m)).otherwise(0.0) + F.when(x["b"] > 0, x["b"] * F.log2(x["b"] / m)).otherwise(0.0)) / 2

    def distance(s: Column) -> Column:
        both = F.zip_with(s["p"], s["q"], lambda a, b: F.struct((a / s["np"]).alias("a"), (b / s["nq"]).alias("b")))
        return F.when((s["np"] > 0) & (s["nq"] > 0), F.sqrt(F.greatest(total(F.transform(both, part)), F.lit(0.0))))

    return bind(F.struct(counts.alias("p"), reference.alias("q"), F.nullif(total(counts), F.lit(0.0)).alias("np"),
        F.nullif(total(reference), F.lit(0.0)).alias("nq")), distance)


def judge_quality(docs: DataFrame, most_chars: float = 0.25, most_words: float = 0.22, least_chars: int = 300, least_words: int = 200) -> DataFrame:
    """Judge every document (doc_id, text, lang) by base counts and divergence.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept. A document fails the base with under 50 words, or with
    more than half of its words in repeated 3-word windows. Else it is kept unless its character
    classes lie further than ``most_chars``, or its common words further than ``most_words``, from
    its language's reference; texts under ``least_chars`` characters, or ``least_words`` words,
    are too short for that test and pass it.

    Nulls: a null text has no words and fails; a null lang is a language of its own. Repeated rows
    are judged as often as they occur and count in the references as often; an empty table gives
    no rows; a language whose histograms are empty rejects nothing; further columns are ignored.
    Each text is read once: counts are written to the checkpoint folder, without the text.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = counts_of(docs.select("doc_id", "text", "lang")).checkpoint()
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)])
    references = rows.groupBy("lang").agg(sums("chars", len(CLASSES) + 1).alias("ref_chars"), sums("common",
        len(COMMON) + 1).alias("ref_words")).withColumnRenamed("lang", "ref_lang")
    small = references.count() <= BROADCAST_LANGUAGES
    rows = rows.join(F.broadcast(references) if small else references, F.col("lang").eqNullSafe(F.col("ref_lang")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("char_distance", js_distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance",
        js_distance(F.col("common"), F.col("ref_words")))
    far_chars = (total(F.col("chars")) >= least_chars) & (F.coalesce("char_distance", F.lit(0.0)) > most_chars)
    far_words = (F.col("n_words") >= least_words) & (F.coalesce("word_distance", F.lit(0.0)) > most_words)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "char_distance", "word_distance", (~(F.col("base_failed") | far_chars | far_words)).alias("kept"))
