"""The boundary of one class: a support vector machine over random Fourier features, trained on all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.operators.graph import shared_checkpoints

#: Random features, bins of scores, and rounds of training.
FEATURES, BINS, ROUNDS = 128, 64, 24


class Waves:
    """Random Fourier features of the Gaussian kernel exp(-gamma d^2), of length about 1."""

    def __init__(self, width: int, gamma: float, features: int, seed: int):
        g = np.random.default_rng(seed)
        self.w, self.shift = g.normal(size=(width, features)) * np.sqrt(2 * gamma), g.uniform(0, 2 * np.pi, features)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.shift)) * np.cos(x @ self.w + self.shift)


def one_class_scores(df: DataFrame, row_id: str, columns: Sequence[str], outside: float = 0.1, gamma: float | None = None, features: int = FEATURES,
    rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """row_id, score: how far a row lies beyond the boundary that leaves about the share ``outside`` of rows out; positive is outside.

    Columns are scaled first, nulls count as the mean. The dual problem of the one-class machine
    puts weights of at most 1 / (outside n) on rows; Frank-Wolfe steps solve it: each round moves
    the boundary's normal towards the mean of the share ``outside`` of rows that lie furthest
    out. A round is one pass over all rows, which hands on sums by bins of the score, never rows.
    """
    shared_checkpoints(df.sparkSession)
    figures = df.agg(F.count(F.lit(1)).alias("n"), *[f for i, c in enumerate(columns) for f in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"d{i}"))]).first()
    n, width = figures["n"], len(columns)
    if not n:
        return df.select(row_id, F.lit(0.0).alias("score"))
    mean, spread = [figures[f"m{i}"] or 0.0 for i in range(width)], [figures[f"d{i}"] or 1.0 for i in range(width)]
    z = F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, m, s in zip(columns, mean, spread, strict=True)])
    rows = df.select(row_id, z.alias("z")).checkpoint()
    waves = Waves(width, gamma or 1.0 / width, features, seed)

    def binned(normal: np.ndarray | None):
        """For mapInPandas: rows in; their number and summed features in each bin of the score out."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts, sums = np.zeros(BINS, dtype=np.int64), np.zeros((BINS, features))
            for frame in frames:
                if len(frame):
                    phi = waves.of(np.array(frame["z"].tolist(), dtype=float))
                    score = phi @ normal if normal is not None else np.zeros(len(phi))
                    at = np.clip(((score + low) / (2 * low) * BINS).astype(int), 0, BINS - 1)
                    counts += np.bincount(at, minlength=BINS)
                    for b in np.unique(at):
                        sums[b] += phi[at == b].sum(axis=0)
            some = np.flatnonzero(counts)
            if len(some):  # an empty list has no element type
                yield pd.DataFrame({"bin": some, "n": counts[some], "s": list(sums[some])})

        return run

    normal, low, cut = None, 1.0, 0.0
    for t in range(rounds):
        low = max(1e-6, float(np.sqrt((normal**2).sum())) * 1.5) if normal is not None else 1.0
        found = rows.select("z").mapInPandas(binned(normal), "bin int, n long, s array<double>").select("bin", "n", F.posexplode("s").alias("k", "x"))
        found = found.groupBy("bin", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))  # two plain sums, however many features
        found = found.groupBy("bin").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "x")))["x"].alias("s")).collect()  # BINS rows
        if normal is None:
            normal = np.sum([r["s"] for r in found], axis=0) / n
            continue
        left, total = max(1.0, outside * n), np.zeros(features)
        for r in sorted(found, key=lambda r: r["bin"]):  # the furthest out first, the last bin in part
            part = min(1.0, left / r["n"])
            total += part * np.array(r["s"])
            left -= part * r["n"]
            cut = (r["bin"] + part) / BINS * 2 * low - low
            if left <= 0:
                break
        step = 2.0 / (t + 2.0)
        normal = (1 - step) * normal + step * total / max(1.0, outside * n)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["z"].tolist(), dtype=float).reshape(len(frame), width)
            yield pd.DataFrame({row_id: frame[row_id], "score": cut - waves.of(x) @ normal})

    return rows.mapInPandas(score, f"{row_id} {dict(df.dtypes)[row_id]}, score double")
