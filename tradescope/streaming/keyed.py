"""Keyed state of streams by stateful processors: rings of values, cool-downs, counters and sessions that expire.

Each operator takes a stream whose rows have a key, seq (their order within the key; a number of
seconds where time matters) and what it looks at, and has a twin over tables. Rows of a batch are
taken in order of seq; what a later batch brings must not be earlier than what was seen. State is
bounded for each key: rings by their length, counters and sessions by timers on event time, which
remove what has expired once the watermark is past it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tradescope.streaming.detectors import LEAST, RING

#: The store that keyed state with several variables and timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ONE_LONG, ONE_DOUBLE = StructType([StructField("x", LongType())]), StructType([StructField("x", DoubleType())])


def use_state_store(spark: SparkSession) -> None:
    """Let this session's streams keep state in the store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _rows(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    return sorted(zip(*(c for c in pd.concat(list(frames))[list(columns)].T.to_numpy()), strict=True))


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, shape: str, timers: bool = False) -> DataFrame:
    use_state_store(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=shape, outputMode="Append",
        timeMode="EventTime" if timers else "None")


class _Ring(StatefulProcessor):
    """The last values of a key as list state."""

    def __init__(self, key: str, value: str, ring: int, least: int):
        self.key, self.value, self.ring, self.least = key, value, ring, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", ONE_DOUBLE)

    def judged(self, kept: list[float], x: float) -> tuple:
        sd = float(np.std(kept))
        z = abs(x - float(np.mean(kept))) / sd if sd > 0 else 0.0
        return z, 0.6 * min(z / 6.0, 1.0) + 0.4 * (x > max(kept) or x < min(kept))

    names = ("z", "score")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept, out = [float(v[0]) for v in self.kept.get()] if self.kept.exists() else [], []
        for seq, x in _rows(rows, "seq", self.value):
            if len(kept) >= self.least:
                out.append((key[0], int(seq), *self.judged(kept, float(x))))
            kept = [*kept, float(x)][-self.ring :]
        self.kept.put([(v,) for v in kept])
        yield pd.DataFrame(out, columns=[self.key, "seq", *self.names])

    def close(self) -> None:
        pass


class _Quick(_Ring):
    """Two deviations off the last ten, and a step over three deviations of the last twenty steps."""

    names = ("odd", "jump")

    def judged(self, kept: list[float], x: float) -> tuple:
        last, odd, jump = np.array(kept[-10:]), False, False
        if len(last) == 10:
            odd = bool(abs(x - last.mean()) > 2 * last.std())
        steps = np.diff(kept)[-20:]
        if len(steps) >= 19:
            jump = bool(abs(x - kept[-1]) > 3 * steps.std())
        return odd, jump


def ring_scores(points: DataFrame, key: str, value: str, ring: int = RING, least: int = LEAST) -> DataFrame:
    """key, seq, z, score: each point of a stream against the last ``ring`` before it, from ``least`` on (twin: ``detectors.ring_scores_table``)."""
    return _run(points, key, _Ring(key, value, ring, least), f"{key} long, seq long, z double, score double")


def quick_checks(points: DataFrame, key: str, value: str) -> DataFrame:
    """key, seq, odd, jump of every point of a stream that has one before it (twin: ``detectors.quick_checks``)."""
    return _run(points, key, _Quick(key, value, 21, 1), f"{key} long, seq long, odd boolean, jump boolean")


class _CoolDown(StatefulProcessor):
    """The last alert let through, as a value."""

    def __init__(self, key: str, seconds: int):
        self.key, self.seconds = key, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ONE_LONG)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, kept = self.last.get()[0] if self.last.exists() else None, []
        for (at,) in _rows(rows, "at"):
            if last is None or at - last >= self.seconds:
                last = int(at)
                kept.append((key[0], last))
        if kept:
            self.last.update((last,))
        yield pd.DataFrame(kept, columns=[self.key, "at"])

    def close(self) -> None:
        pass


def cool_down(alerts: DataFrame, key: str, seconds: int = 300) -> DataFrame:
    """Alerts (key, at) of a stream less those within so many seconds of the last one let through (twin: ``events.cool_down_table``)."""
    return _run(alerts.select(key, "at"), key, _CoolDown(key, seconds), f"{key} string, at long")


class _Counter(StatefulProcessor):
    """A count and the time of the last write; a timer removes both when they have expired."""

    def __init__(self, key: str, ttl: int):
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("count", StructType([StructField("n", LongType()), StructField("last", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        if last is not None:
            self.handle.deleteTimer((last + self.ttl) * 1000)
        out = []
        for (seq,) in _rows(rows, "seq"):
            n = n + 1 if last is not None and seq - last < self.ttl else 1
            last = int(seq)
            out.append((key[0], last, int(n), "write"))
        self.state.update((int(n), last))
        self.handle.registerTimer((last + self.ttl) * 1000)
        yield pd.DataFrame(out, columns=[self.key, "seq", "n", "what"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, last = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], int(last) + self.ttl, int(n), "expired")], columns=[self.key, "seq", "n", "what"])

    def close(self) -> None:
        pass


def expiring_counters(writes: DataFrame, key: str, ttl: int = 3600) -> DataFrame:
    """key, seq, n, what of a stream of writes (key, seq in seconds, ts with a watermark): the count after each write, and its end.

    A counter expires ``ttl`` seconds after its last write and then counts from 1; what is left of
    it is removed, with a row ``expired``, once the watermark is past that (twin: ``expiring_counters_table``).
    """
    return _run(writes.select(key, "seq", "ts"), key, _Counter(key, ttl), f"{key} long, seq long, n long, what string", timers=True)


def expiring_counters_table(writes: DataFrame, key: str, order: tuple[str, ...], ttl: int = 3600) -> DataFrame:
    """Add ``n``, the count after each write, and ``ends``, when the counter that it belongs to expires. The first of ``order`` is in seconds."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = F.coalesce((F.col(order[0]) - F.lag(order[0]).over(w) >= ttl).cast("int"), F.lit(1))
    x = writes.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(key, "_run")
    return x.withColumns({"n": F.row_number().over(own.orderBy(*order)).cast("long"), "ends": F.max(order[0]).over(own) + ttl}).drop("_fresh", "_run")


class _Sessions(StatefulProcessor):
    """Open sessions of a user as a map of token to last activity; timers remove those that are over."""

    def __init__(self, user: str, gap: int, most: int):
        self.user, self.gap, self.most = user, gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", StructType([StructField("token", StringType())]), ONE_LONG)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {k[0]: int(v[0]) for k, v in self.open.iterator()}
        before, out = dict(known), []
        for seq, token in _rows(rows, "seq", "token"):
            for over in [k for k, last in known.items() if last + self.gap <= seq]:
                del known[over]
            if token not in known:
                out.append((key[0], token, int(seq), len(known) + 1, len(known) + 1 <= self.most))
            known[token] = int(seq)
        for token in before.keys() - known.keys():
            self.open.removeKey((token,))
        for token, last in known.items():
            self.open.updateValue((token,), (last,))
            self.handle.registerTimer((last + self.gap) * 1000)
        yield pd.DataFrame(out, columns=[self.user, "token", "start", "active", "allowed"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for token, last in [(k, v[0]) for k, v in self.open.iterator()]:
            if (last + self.gap) * 1000 <= at:
                self.open.removeKey(token)
        yield pd.DataFrame([], columns=[self.user, "token", "start", "active", "allowed"])

    def close(self) -> None:
        pass


def concurrent_sessions(activity: DataFrame, user: str, gap: int = 1800, most: int = 3) -> DataFrame:
    """user, token, start, active, allowed for each session that begins in a stream (user, token, seq in seconds, ts with a watermark).

    A session of a token ends ``gap`` seconds after its last activity. ``active`` are the user's
    open sessions, itself included; more than ``most`` are not allowed (twin: ``concurrent_sessions_table``).
    """
    return _run(activity.select(user, "token", "seq", "ts"), user, _Sessions(user, gap, most), f"{user} long, token string, start long, active long, allowed boolean",
        timers=True)


def concurrent_sessions_table(activity: DataFrame, user: str, gap: int = 1800, most: int = 3) -> DataFrame:
    """The same of a table: sessions by gaps, then running sums of their beginnings and ends, ends first at one time."""
    own = Window.partitionBy(user, "token").orderBy("seq")
    fresh = F.coalesce((F.col("seq") - F.lag("seq").over(own) >= gap).cast("int"), F.lit(1))
    x = activity.select(user, "token", "seq").withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = x.groupBy(user, "token", "_run").agg(F.min("seq").alias("start"), (F.max("seq") + gap).alias("over"))
    steps = found.select(user, "token", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("over").alias("at"),
        F.lit(-1).alias("step")))).alias("s")).select(user, "token", "s.at", "s.step")
    order = Window.partitionBy(user).orderBy("at", "step", "token").rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn("active", F.sum("step").over(order)).filter("step = 1")
    return counted.select(user, "token", F.col("at").alias("start"), "active", (F.col("active") <= most).alias("allowed"))
