"""Streaming operators: each takes a DataFrame that may be a stream or a table, so that both give one result."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an event may come: append mode drops what is later.
LATENESS = "10 minutes"


def prepared(events: DataFrame) -> DataFrame:
    """Event times with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def bursts(events: DataFrame, hit: Column, length: str = "5 minutes", slide: str | None = None, least: int = 2) -> DataFrame:
    """Windows with at least ``least`` hits: start (seconds), hits, total."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = prepared(events).groupBy(w.alias("w")).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total"))
    return g.filter(F.col("hits") >= least).select(F.unix_timestamp("w.start").alias("start"), "hits", "total")


def keyed_windows(events: DataFrame, key: str, length: str, *metrics: Column, slide: str | None = None) -> DataFrame:
    """Metrics by key and window: key, start (seconds), metrics."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = prepared(events).groupBy(key, w.alias("w")).agg(*metrics)
    return g.select(key, F.unix_timestamp("w.start").alias("start"), *[c for c in g.columns if c not in (key, "w")])


def over_limit(events: DataFrame, key: str, limit: int = 100, length: str = "60 seconds") -> DataFrame:
    """Windows in which a key has more than ``limit`` requests: key, start (seconds), n and how many are refused."""
    found = keyed_windows(events, key, length, F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return found.withColumn("refused", F.col("n") - limit)


def trending(events: DataFrame, item: str, hours: tuple[int, ...], n: int) -> DataFrame:
    """(hours, item, n): the ``n`` items with most events in each of the spans before the last event of a table, ties to the smaller item."""
    last = events.agg(F.max("ts").alias("_last"))
    spans = F.filter(F.array(*map(F.lit, hours)), lambda h: F.col("_age") < h * 3600)
    age = F.unix_micros(F.col("_last").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    counts = events.join(F.broadcast(last)).withColumn("_age", age).select(item, F.explode(spans).alias("hours")).groupBy("hours", item).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("hours").orderBy(F.desc("n"), item))  # a row per item
    return counts.withColumn("_k", rank).filter(F.col("_k") <= n).select("hours", item, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key that end after a gap: key, start and last event (seconds), events."""
    g = prepared(events).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    return g.select(key, F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("last").alias("last"), "events")


def pattern_alerts(lines: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Lines that match a pattern, with the name of the first that does."""
    name = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in patterns.items()])
    return lines.withColumn("alert", name).filter(F.col("alert").isNotNull())


def route(handlers: Mapping[str, Callable[[DataFrame], None]], column: str = "aggregate_type") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each handler gets the events of its type."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, handle in handlers.items():
                handle(batch.filter(F.col(column) == name).withColumn("batch_id", F.lit(batch_id)))
        finally:
            batch.unpersist()

    return run


def cool_down(alerts: DataFrame, key: str, seconds: int = 300) -> DataFrame:
    """Alerts (key, at) less those within so many seconds of the last one let through; state per key."""

    def pick(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(int(x) for frame in frames for x in frame["at"])
        kept = []
        for x in times:
            if last is None or x - last >= seconds:
                kept.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), "at": kept})

    shape = f"{key} string, at long"
    return alerts.groupBy(key).applyInPandasWithState(pick, shape, "last long", "append", GroupStateTimeout.NoTimeout)


def cool_down_table(alerts: DataFrame, key: str, seconds: int = 300) -> DataFrame:
    """The same on a table, by a fold over each key's ordered times."""
    times = alerts.groupBy(key).agg(F.sort_array(F.collect_list(F.col("at").cast("long"))).alias("t"))
    start = F.array().cast("array<bigint>")
    kept = F.aggregate("t", start, lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= seconds), F.array_append(a, x)).otherwise(a))
    return times.select(key, F.explode(kept).alias("at"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Change events of two snapshots: key, op (INSERT, UPDATE, DELETE), old and new rows as JSON."""
    pack = lambda d, n: d.select(F.col(key), F.to_json(F.struct(*[c for c in d.columns if c != key])).alias(n))
    j = pack(before, "old").join(pack(after, "new"), key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return j.select(key, F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE").alias("op"), "old", "new")


def apply_changes(target: DataFrame, events: DataFrame, key: str, order: str, deleted: Column) -> DataFrame:
    """Latest event of each key over what the target holds; deleted keys go."""
    latest = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("e")).select(key, "e.*")
    kept = target.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.filter(~deleted).select(*target.columns))
