"""Detectors that keep something of each stream: as stateful streams, and as windows over a table with equal results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Points a stream keeps, and how many it needs before it scores.
RING, LEAST = 100, 10


def ring_scores_table(points: DataFrame, key: str, order: tuple[str, ...], value: str, ring: int = RING, least: int = LEAST) -> DataFrame:
    """Add ``z`` and ``score`` of each point against the last ``ring`` before it; points with under ``least`` before them go.

    score: .6 for the deviation (full at six) and .4 for lying outside of all that is kept.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-ring, -1)
    x, n = F.col(value), F.count(F.lit(1)).over(w)
    z = F.abs(x - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    outside = (x > F.max(value).over(w)) | (x < F.min(value).over(w))
    scored = points.withColumns({"kept": n, "z": F.coalesce(z, F.lit(0.0)), "outside": outside}).filter(F.col("kept") >= least)
    return scored.withColumn("score", 0.6 * F.least(F.col("z") / 6.0, F.lit(1.0)) + 0.4 * F.col("outside").cast("int")).drop("kept", "outside")


def ring_scores(points: DataFrame, key: str, value: str, ring: int = RING, least: int = LEAST) -> DataFrame:
    """The same of a stream (key, seq, value) of points in order of seq, with the ring as state: key, seq, z, score."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        out = []
        for seq, x in sorted((int(s), float(v)) for frame in frames for s, v in zip(frame["seq"], frame[value], strict=True)):
            if len(kept) >= least:
                sd = float(np.std(kept))
                z = abs(x - float(np.mean(kept))) / sd if sd > 0 else 0.0
                out.append((name[0], seq, z, 0.6 * min(z / 6.0, 1.0) + 0.4 * (x > max(kept) or x < min(kept))))
            kept = [*kept, x][-ring:]
        state.update((kept,))
        yield pd.DataFrame(out, columns=[key, "seq", "z", "score"])

    return points.groupBy(key).applyInPandasWithState(step, f"{key} long, seq long, z double, score double", "kept array<double>",
        "append", GroupStateTimeout.NoTimeout)


def quick_checks(points: DataFrame, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Add ``odd`` (two deviations off the last ten) and ``jump`` (a step over three deviations of the last twenty steps)."""
    w = Window.partitionBy(key).orderBy(*order)
    last10, last20 = w.rowsBetween(-10, -1), w.rowsBetween(-20, -1)
    step = F.col(value) - F.lag(value).over(w)
    x = points.withColumn("step", step)
    odd = (F.count(F.lit(1)).over(last10) == 10) & (F.abs(F.col(value) - F.avg(value).over(last10)) > 2 * F.stddev_pop(value).over(last10))
    jump = (F.count("step").over(last20) >= 19) & (F.abs("step") > 3 * F.stddev_pop("step").over(last20))
    return x.withColumns({"odd": odd, "jump": F.coalesce(jump, F.lit(False))}).drop("step")


def failed_logins_table(attempts: DataFrame, user: str, order: tuple[str, ...], failed: Column, success: Column, limit: int = 3) -> DataFrame:
    """Add ``failures`` (since the last success, each attempt included) and ``locked`` (``limit`` or more)."""
    w = Window.partitionBy(user).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = attempts.withColumns({"failed_": failed.cast("int"), "run_": F.sum(success.cast("int")).over(upto)})
    inside = Window.partitionBy(user, "run_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = x.withColumn("failures", F.sum("failed_").over(inside))
    return found.withColumn("locked", F.col("failures") >= limit).drop("failed_", "run_")


def failed_logins(attempts: DataFrame, user: str, limit: int = 3) -> DataFrame:
    """The same of a stream (user, seq, outcome: failed, success or other) in order of seq: user, seq, failures, locked."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for seq, outcome in sorted((int(s), o) for frame in frames for s, o in zip(frame["seq"], frame["outcome"], strict=True)):
            n = 0 if outcome == "success" else n + (outcome == "failed")
            out.append((name[0], seq, n, n >= limit))
        state.update((n,))
        yield pd.DataFrame(out, columns=[user, "seq", "failures", "locked"])

    return attempts.groupBy(user).applyInPandasWithState(step, f"{user} long, seq long, failures long, locked boolean",
        "n long", "append", GroupStateTimeout.NoTimeout)
