"""Recommendation from ratings (user_id, item_id, rating) and item similarities (a, b, similarity), both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.operators.graph import shared_checkpoints
from tradescope.operators.joins import checked_broadcast


def both_ways(similar: DataFrame) -> DataFrame:
    """Each pair of items in both directions."""
    return similar.select("a", "b", "similarity").union(similar.select("b", "a", "similarity"))


def mean_ratings(ratings: DataFrame) -> DataFrame:
    """One rating for each user and item: the mean."""
    return ratings.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def unrated(ratings: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(user_id, item_id): every item that anyone rates and the user does not.

    The items are one array, broadcast; more than ``most`` of them are an error, as the result
    has about users times items rows. A user's own items are taken off where their rows meet.
    """
    items = ratings.filter(F.col("item_id").isNotNull()).select("item_id").distinct()
    if items.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} items")
    every = items.agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    own = ratings.groupBy("user_id").agg(F.collect_set("item_id").alias("own"))  # the items at most
    return own.join(F.broadcast(every)).select("user_id", F.explode(F.array_except("items", "own")).alias("item_id"))


def content_based(ratings: DataFrame, similar: DataFrame, liked: float = 4.0, one_way: bool = False) -> DataFrame:
    """(user_id, item_id, score): the largest similarity of an unrated item to one that the user rates ``liked`` or more.

    ``similar`` has each pair once unless ``one_way``: then b is like a, not also a like b.
    """
    mine = mean_ratings(ratings)
    near = mine.filter(F.col("rating") >= liked).join(similar if one_way else both_ways(similar), F.col("item_id") == F.col("a")).groupBy("user_id",
        F.col("b").alias("item_id")).agg(F.max("similarity").alias("score"))
    return near.join(mine.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def collaborative(ratings: DataFrame, similar: DataFrame) -> DataFrame:
    """(user_id, item_id, score): the user's ratings of like items, weighted by similarity, over 5; unrated items only."""
    mine = mean_ratings(ratings)
    near = mine.join(both_ways(similar), F.col("item_id") == F.col("a"))
    predicted = near.groupBy("user_id", F.col("b").alias("item_id")).agg((F.sum(F.col("similarity") * F.col("rating")) / F.sum("similarity") / 5).alias("score"))
    return predicted.join(mine.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def hybrid(cf: DataFrame, cb: DataFrame, weight: float = 0.6) -> DataFrame:
    """``weight`` of the first score and the rest of the second, unknown ones being 0."""
    j = cf.withColumnRenamed("score", "cf").join(cb.withColumnRenamed("score", "cb"), ["user_id", "item_id"], "full_outer")
    zero = F.lit(0.0)
    return j.select("user_id", "item_id", (weight * F.coalesce("cf", zero) + (1 - weight) * F.coalesce("cb", zero)).alias("score"))


def top_items(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best items of each user by rounded score, ties to the smaller item."""
    ranked = scores.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))
    return ranked.withColumn("k", rank).filter(F.col("k") <= k).drop("k")


def best_items(ratings: DataFrame, content: DataFrame, k: int, similar: DataFrame | None = None, weight: float = 0.6, digits: int = 6, liked: float = 4.0) -> DataFrame:
    """(user_id, item_id, score): ``top_items`` of ``content_based`` one way, or of its ``hybrid`` with ``collaborative`` if ``similar`` is given.

    Ratings are moved once, by user, and nothing of a user's is moved again. An item that no one rates can be among a user's
    best only if it is among the k best of an item that the user likes, those that the user rates not counted; the other
    pairs stay away. Ratings and similarities are not below 0.
    """
    shared_checkpoints(ratings.sparkSession)
    part = 1.0 if similar is None else 1 - weight
    mine = ratings.select("user_id", "item_id", "rating").repartition("user_id").groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))
    own = mine.groupBy("user_id").agg(F.collect_list(F.struct("item_id", "rating")).alias("r"))  # the items at most
    items = F.array_compact(F.transform("r", lambda x: x["item_id"]))
    own = own.select("user_id", F.when(F.col("user_id").isNotNull(), items).otherwise(F.slice(items, 1, 0)).alias("own"), F.size("r").alias("m"), F.explode("r").alias("r"))
    rated = ratings.select(F.col("item_id").alias("b")).filter("b IS NOT NULL").distinct().withColumn("rated", F.lit(True))
    most = ratings.groupBy("user_id").agg(F.count_distinct("item_id").alias("m")).agg(F.coalesce(F.max("m"), F.lit(0)).alias("most"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round(part * F.col("similarity"), digits)), "b"))
    near = content.select("a", "b", "similarity", rank.alias("rank")).join(F.broadcast(most)).join(F.broadcast(rated), "b", "left")
    kept = F.col("rank") <= F.col("most") + 1 + k
    near = near.filter(kept if similar is None else kept | F.col("rated")).select("a", "b", F.col("similarity").alias("cb"), "rank", F.coalesce("rated", F.lit(False)).alias("rated"))
    pairs = near.withColumn("cs", F.lit(None).cast("double"))
    if similar is not None:
        none = F.lit(None)
        pairs = pairs.unionByName(both_ways(similar).select("a", "b", F.col("similarity").alias("cs"), none.cast("double").alias("cb"), none.cast("int").alias("rank"), F.lit(True).alias("rated")))
    met = own.join(checked_broadcast(pairs.checkpoint(), 5_000_000), F.col("r.item_id") == F.col("a")).filter(~F.array_contains("own", F.col("b")))
    some = F.col("rank") <= k + F.col("m")
    met = met.filter(F.col("cs").isNotNull() | ((F.col("r.rating") >= liked) & (some if similar is None else some | F.col("rated"))))
    side = F.when(F.col("user_id").isNull(), F.col("cs").isNotNull()).alias("side")  # a join of both scores meets no null
    scores = met.groupBy("user_id", F.col("b").alias("item_id"), side).agg((F.sum(F.col("cs") * F.col("r.rating")) / F.sum("cs") / 5).alias("cf"),
        F.max(F.when(F.col("r.rating") >= liked, F.col("cb"))).alias("cb"))
    zero = F.lit(0.0)
    score = F.col("cb") if similar is None else weight * F.coalesce("cf", zero) + part * F.coalesce("cb", zero)
    return top_items(scores.select("user_id", "item_id", score.alias("score")), k, digits)


def diverse(scores: DataFrame, category: str, each: int, k: int) -> DataFrame:
    """The k best of each user with at most ``each`` of a category; best first, ties to the smaller item."""
    order = [F.desc("score"), F.col("item_id")]
    capped = scores.withColumn("c", F.row_number().over(Window.partitionBy("user_id", category).orderBy(*order))).filter(F.col("c") <= each)
    return capped.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).filter(F.col("k") <= k).drop("c")


def context_factor(hour: Column, weekday: Column, popularity: Column, recent: Column) -> Column:
    """Mean of four multipliers: time of day, weekend, popularity (up to 1.5) and recency."""
    parts = [
        F.when(hour.between(6, 11), 1.2).when(hour.between(18, 22), 1.1).otherwise(1.0),
        F.when(weekday > 5, 1.1).otherwise(0.9),
        F.least(F.lit(1.5), 1.0 + popularity / 100.0),
        F.when(recent, 1.2).otherwise(1.0),
    ]
    return sum(parts[1:], parts[0]) / 4.0


#: Multipliers of priorities and of feed volumes (fixed values); another priority or volume is 1.
PRIORITIES = {"low": 0.7, "medium": 1.0, "high": 1.3, "urgent": 1.5}
VOLUMES = {"minimal": 0.5, "normal": 1.0, "extensive": 1.5}


def multiplier(table: dict[str, float], name: Column) -> Column:
    """A name's multiplier; 1 for another."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), F.coalesce(name, F.lit(""))), F.lit(1.0))


def company_relevance(companies: Column, preferred: Column) -> Column:
    """1 for an item with a preferred company, 0.4 with others, 0.3 with none; 0.5 if the user prefers none. Arrays."""
    return F.when(F.size(preferred) < 1, 0.5).when(F.size(companies) < 1, 0.3).when(F.arrays_overlap(companies, preferred), 1.0).otherwise(0.4)


def topic_relevance(text: Column, wanted: Column, excluded: Column) -> Column:
    """0.1 if a text has an excluded topic, else 0.8 and 0.1 more for each further wanted topic, up to 1; 0.5 with none. Arrays of topics."""
    low = F.lower(F.coalesce(text, F.lit("")))
    met = lambda topics: F.size(F.filter(topics, lambda w: F.contains(low, F.lower(w))))
    return F.when(met(excluded) > 0, 0.1).when(met(wanted) > 0, F.least(F.lit(1.0), 0.7 + 0.1 * met(wanted))).otherwise(0.5)


def feed_score(base: Column, engagement: Column, priority: Column, company: Column, topic: Column, time: Column) -> Column:
    """Relevance of an item for a user: .3 category weight (0.5 if unknown), .25 engagement (1 if unknown), .2 priority, .15 company, .05 topic, .05 time."""
    return (0.3 * F.coalesce(base, F.lit(0.5)) + 0.25 * F.coalesce(engagement, F.lit(1.0)) + 0.2 * multiplier(PRIORITIES, priority) + 0.15 * company + 0.05 * topic + 0.05 * time)


def feed_selection(scored: DataFrame, user: str, category: str, score: str, item: str, volume: str, most: int = 50) -> DataFrame:
    """The feed of each user, with ``place``: the best items, at most a fifth of the feed (two at least) of a category.

    A feed has ``most`` items times the multiplier of the user's ``volume``. Ties go to the smaller item.
    """
    order = [F.desc(score), F.col(item)]
    size = F.floor(most * multiplier(VOLUMES, F.col(volume)))
    each = F.greatest(F.lit(2), F.floor(size / 5))
    capped = scored.withColumn("_c", F.row_number().over(Window.partitionBy(user, category).orderBy(*order))).filter(F.col("_c") <= each).drop("_c")
    return capped.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(*order))).filter(F.col("place") <= size)
