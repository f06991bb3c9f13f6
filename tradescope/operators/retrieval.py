"""Retrieval: text scores, blocked vector search, relevance, merging of ranked lists."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators.counts import postings, term_lists
from tradescope.operators.joins import checked_broadcast
from tradescope.operators.neighbours import neighbour_pairs

#: Query terms, and rows and queries in a block of a vector search.
BROADCAST_TERMS, BLOCK = 1_000_000, 4096


def field_terms(docs: DataFrame, key: str, fields: Sequence[tuple[Column, int]]) -> DataFrame:
    """(key, l, terms) as ``counts.term_lists`` gives: occurrences in each (text, boost) count ``boost`` times. Documents are moved once, to be dealt evenly."""
    terms = F.concat(*[F.flatten(F.array_repeat(S.tokens(F.coalesce(text, F.lit(""))), boost)) for text, boost in fields])
    return term_lists(docs, key, terms).filter("l > 0")


def bm25(lists: DataFrame, key: str, queries: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score) of documents that share a term with a query (query, term); all terms count.

    Scores are added up where a document's terms lie; only the queries' terms leave a document, and
    only they are counted over the corpus.
    """
    asked = queries.select(query, "term").distinct()
    wanted = checked_broadcast(asked.select("term").distinct(), BROADCAST_TERMS)
    figures = lists.agg(F.avg("l").alias("a"), F.count(F.lit(1)).alias("c"))
    hits = postings(lists, key).join(wanted, "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    weights = checked_broadcast(asked.join(df, "term").join(F.broadcast(figures)), BROADCAST_TERMS)
    joined = hits.join(weights, "term")
    rarity = F.log(1 + (F.col("c") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    part = rarity * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("l") / F.col("a")))
    return joined.groupBy(query, key).agg(F.sum(part).alias("score"))


def best(scores: DataFrame, query: str, key: str, k: int, digits: int = 5) -> DataFrame:
    """The k best of each query by rounded score, ties to the smaller key."""
    ranked = scores.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def vector_search(queries: DataFrame, vectors: DataFrame, least: float = -1.0, k: int | None = None, kind: Column | None = None,
    block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score): cosines of at least ``least``, the k best of each query if ``k`` is given.

    Both sides have vec_id and embedding; ``kind`` is a column of both that must agree. On unit
    vectors a cosine is a distance, so rows and queries meet by ``neighbour_pairs``: cells that
    cannot hold a cosine of ``least``, or better than the k-th found, are not visited. Vectors of
    zeros or nulls, and shorter ones than the longest, find nothing.
    """
    kind = F.coalesce(kind.cast("string"), F.lit("")) if kind is not None else F.lit("")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    made = lambda d: d.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), kind.alias("kind")).filter(
        F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(
        "id", F.transform("v", lambda x: x / length).alias("v"), "kind")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    queries, vectors = (d.filter(F.size("embedding") == width) for d in (queries, vectors))
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * least)) * (1 + 1e-9) + 1e-9
    found = neighbour_pairs(made(queries), made(vectors).withColumn("n", F.lit(1).cast("long")), k, radius, block=block).filter("query_id >= 0")
    score = 1.0 - F.col("distance") * F.col("distance") / 2.0
    found = found.select("query_id", F.col("id").alias("vec_id"), score.alias("score")).filter(F.col("score") >= least - 1e-12)
    if k is None:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def hybrid(exact: DataFrame, vector: DataFrame, text: DataFrame, key: str = "pk", most: int = 100) -> DataFrame:
    """Merge three result lists (key, score): 1 for exact hits, vector scores times 1.2, text scores / 10 up to 1 times .8.

    Each key has its best; the ``most`` best stay, ties to the smaller key.
    """
    parts = exact.select(key, F.lit(1.0).alias("score")).union(vector.select(key, F.col("score") * 1.2)).union(text.select(key,
        F.least(F.col("score") / 10.0, F.lit(1.0)) * 0.8))
    return parts.groupBy(key).agg(F.round(F.max("score"), 6).alias("score")).orderBy(F.desc("score"), key).limit(most)


def overlap_share(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of ``a`` that ``b`` has; null where ``a`` has none."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_distinct(a)), F.lit(0))


def mean_known(*parts: Column) -> Column:
    """Mean of the parts that are not null; null if none is."""
    known = F.array_compact(F.array(*parts))
    return F.aggregate(known, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(known), F.lit(0))


def context_relevance(query_words: Column, words: Column, query_names: Column, names: Column, days: Column) -> Column:
    """Mean of keyword share, entity overlap and closeness in time (1 at a day, less by 1/30 a day), of those that are known."""
    return context_of_shares(overlap_share(query_words, words), overlap_share(query_names, names), days)


def context_of_shares(words: Column, names: Column, days: Column) -> Column:
    """``context_relevance`` from the shares of a query's words and names that a document has."""
    closeness = F.when(days.isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.abs(days) / 30.0))
    return mean_known(words, names, closeness)


def relevance(lexical: Column, semantic: Column, context: Column, quality: Column) -> Column:
    """Weighted relevance: .4 semantic, .3 lexical, .2 context, .1 quality; unknown parts count 0."""
    known = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.4 * known(semantic) + 0.3 * known(lexical) + 0.2 * known(context) + 0.1 * known(quality)


def relevance_level(score: Column) -> Column:
    """high from .8, medium from .6, else low."""
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def agreement(*parts: Column) -> Column:
    """Confidence by agreement: 1 less the spread (population deviation) of the known parts."""
    known = F.array_compact(F.array(*parts))
    mean = mean_known(*parts)
    square = F.aggregate(known, F.lit(0.0), lambda t, x: t + x * x) / F.nullif(F.size(known), F.lit(0))
    return 1.0 - F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
