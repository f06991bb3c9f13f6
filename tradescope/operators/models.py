"""Learned detectors and forecasts. Training data are bounded samples or one series; scoring is distributed."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees of an isolation forest and rows of each tree's sample.
TREES, TREE_ROWS = 100, 256


def grow(x: np.ndarray, depth: int, rng: np.random.Generator):
    """An isolation tree: (column, cut, left, right), or the number of rows in a leaf."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else ()
    if depth == 0 or not len(spread):
        return len(x)
    column = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, column].min(), x[:, column].max()))
    left = x[:, column] < cut
    return column, cut, grow(x[left], depth - 1, rng), grow(x[~left], depth - 1, rng)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def path_lengths(tree, x: np.ndarray, rows: np.ndarray, out: np.ndarray, depth: int = 0) -> None:
    """Add each row's depth in a tree to ``out``."""
    if isinstance(tree, int):
        out[rows] += depth + expected_path(tree)
        return
    column, cut, left, right = tree
    below = x[rows, column] < cut
    if below.any():
        path_lengths(left, x, rows[below], out, depth + 1)
    if not below.all():
        path_lengths(right, x, rows[~below], out, depth + 1)


def isolation_scores(df: DataFrame, row_id: str, columns: Sequence[str], seed: int = 11) -> DataFrame:
    """row_id, score in (0, 1]: near 1 is isolated. Each tree is grown on 256 rows.

    A row is in a tree's draw by a hash of its id and the tree, with a chance that gives the tree
    a third more rows than it takes, at every size of the table.
    """
    n = df.count()
    rows = df.select(F.col(row_id), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    share = min(1.0, (TREE_ROWS * 1.3 + 20) / max(n, 1))
    drawn = lambda t: F.pmod(F.xxhash64(F.col(row_id), t, F.lit(seed)), F.lit(1 << 52)) < F.lit(int(share * (1 << 52)))
    dealt = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), drawn)))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(key[0]))
        x = frame.sort_values(row_id)[list(columns)].to_numpy(float)
        x = x[rng.permutation(len(x))[:TREE_ROWS]]
        return pd.DataFrame({"tree": [pickle.dumps((grow(x, 8, rng), len(x)))]})

    forest = [pickle.loads(r["tree"]) for r in dealt.groupBy("tree").applyInPandas(one, "tree binary").collect()]  # TREES rows
    if not forest:
        return rows.select(row_id, F.lit(0.5).alias("score"))
    trees = df.sparkSession.sparkContext.broadcast(forest)
    norm = expected_path(max(size for _, size in forest)) or 1.0

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, total = frame[list(columns)].to_numpy(float), np.zeros(len(frame))
            for tree, _ in trees.value:
                path_lengths(tree, x, np.arange(len(x)), total)
            yield pd.DataFrame({row_id: frame[row_id], "score": 2.0 ** (-total / len(trees.value) / norm)})

    return rows.mapInPandas(score, f"{row_id} {dict(rows.dtypes)[row_id]}, score double")


def flagged(scores: DataFrame, share: float) -> DataFrame:
    """The rows above the (1 - share) quantile of the score."""
    return scores.join(F.broadcast(scores.agg(F.percentile_approx("score", 1 - share, 10_000).alias("cut")))).filter("score > cut").drop("cut")


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``z``: the columns as a scaled vector."""
    wide = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="_x", outputCol="z", withMean=True).fit(wide).transform(wide).drop("_x")


def reconstruction_scores(df: DataFrame, row_id: str, columns: Sequence[str], parts: int = 2) -> DataFrame:
    """row_id, score: squared distance from the plane of the first principal components."""
    z = standardised(df, columns)
    model = PCA(k=parts, inputCol="z", outputCol="p").fit(z)
    back = model.pc.toArray()
    arrays = model.transform(z).select(row_id, vector_to_array("z").alias("z"), vector_to_array("p").alias("p"))
    rebuilt = F.array(*[sum((F.col("p")[k] * float(back[i, k]) for k in range(parts)), F.lit(0.0)) for i in range(len(columns))])
    return arrays.select(row_id, F.aggregate(F.zip_with("z", rebuilt, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x).alias("score"))


def distance_scores(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """row_id, score: squared Mahalanobis distance from the mean."""
    figures = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i,
        a in enumerate(columns) for j, b in enumerate(columns)]).first()  # one row
    mean = [figures[f"m{i}"] or 0.0 for i in range(len(columns))]
    inverse = np.linalg.pinv(np.array([[figures[f"c{i}_{j}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))]))
    d = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    return df.select(row_id, sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0)).alias("score"))


def recommend(ratings: DataFrame, user: str, item: str, rating: str, k: int = 5) -> DataFrame:
    """The k items of the best predicted rating for each user (user, item, score), by ALS."""
    als = ALS(userCol=user, itemCol=item, ratingCol=rating, rank=8, maxIter=5, seed=3, coldStartStrategy="drop")
    means = ratings.groupBy(F.col(user).cast("int").alias(user), item).agg(F.avg(rating).cast("float").alias(rating))
    return als.fit(means).recommendForAllUsers(k).select(user, F.explode("recommendations").alias("r")).select(user,
        F.col(f"r.{item}").alias(item), F.col("r.rating").cast("double").alias("score"))


def fraud_probabilities(df: DataFrame, row_id: str, columns: Sequence[str], label: str, known: DataFrame | None = None) -> DataFrame:
    """row_id, label, forest, boosted and leaf_boosted: probabilities by a random forest, boosted trees and boosted deeper trees of slower steps.

    The models learn from ``known`` (the rows themselves, if none is given), whose rows weigh as
    much as their class is rare. Without both classes in it all probabilities are its share of 1.
    """
    seen = df if known is None else known
    share = seen.agg(F.avg(F.col(label).cast("double")).alias("s")).first()["s"]
    names = ("forest", "boosted", "leaf_boosted")
    if share is None or share in (0.0, 1.0):
        return df.select(row_id, label, *[F.lit(share or 0.0).alias(n) for n in names])
    wide = VectorAssembler(inputCols=list(columns), outputCol="x", handleInvalid="skip")
    weigh = lambda d: wide.transform(d.withColumn("w", F.when(F.col(label) == 1, 1 - share).otherwise(share)))
    settings = {"featuresCol": "x", "labelCol": label, "weightCol": "w", "seed": 5}
    models = [RandomForestClassifier(numTrees=20, maxDepth=5, **settings), GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.2, **settings),
        GBTClassifier(maxIter=12, maxDepth=5, stepSize=0.1, minInstancesPerNode=10, **settings)]
    learned, out = weigh(seen).select("x", "w", label).persist(), weigh(df)
    try:
        for name, model in zip(names, models, strict=True):
            out = model.fit(learned).transform(out).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    finally:
        learned.unpersist()
    return out.select(row_id, label, *names)


def lasso(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with a penalty on the size of each weight (0: none), by accelerated proximal steps on scaled columns."""
    scale = np.sqrt((x * x).mean(axis=0))
    scale[scale == 0] = 1.0
    a = x / scale
    gram, target = a.T @ a / len(y), a.T @ y / len(y)
    step = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    w = v = np.linalg.lstsq(a, y, rcond=None)[0]
    momentum = 1.0
    for _ in range(rounds):
        moved = v - step * (gram @ v - target)
        after = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0.0)
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        v, w, momentum = after + (momentum - 1) / faster * (after - w), after, faster
    return w / scale


def changepoints(t: np.ndarray, y: np.ndarray, seasons: np.ndarray, most: int = 25, history: float = 0.8, strength: float = 0.05) -> np.ndarray:
    """The times, among ``most`` evenly spaced ones in the first ``history`` of a series, at which its trend changes.

    Changes of slope are chosen by an L1 penalty of ``strength`` times the series' deviation; the
    strongest of neighbours that were chosen together stands for them.
    """
    places = np.unique(np.quantile(t, np.linspace(0, history, most + 1)[1:])) if len(t) > 2 * most else np.zeros(0)
    if not len(places):
        return places
    hinges = np.maximum(t[:, None] - places, 0.0)
    x = np.concatenate((seasons, hinges), axis=1)
    spread = float(np.std(y)) or 1.0
    penalty = np.append(np.zeros(seasons.shape[1]), np.full(len(places), strength * spread))
    change = np.abs(lasso(x, y, penalty)[seasons.shape[1] :] * np.sqrt((hinges * hinges).mean(axis=0)))
    chosen = change > 0.02 * spread
    best = [i for i in np.flatnonzero(chosen) if change[i] >= change[max(0, i - 1) : i + 2].max()]
    return places[best]


def seasonal_forecast(key: str, day: str, value: str, horizon: int = 14):
    """A function for applyInPandas: piecewise-linear trend, week and year of one series; 95 % interval.

    The trend's changes are chosen by ``changepoints``, then all weights are fitted by least
    squares, those of the changes with a slight ridge. A series is one group.
    """

    def waves(t: np.ndarray) -> np.ndarray:
        turns = [f(2 * np.pi * k * t / p) for p, most in ((7.0, 3), (365.25, 4)) for k in range(1, most + 1) for f in (np.sin, np.cos)]
        return np.stack([np.ones_like(t), t / 1000.0, *turns], axis=1)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(day)
        days = pd.to_datetime(frame[day])
        t = (days - days.iloc[0]).dt.days.to_numpy(float)
        y = frame[value].to_numpy(float)
        at = changepoints(t, y, waves(t))
        design = lambda t: np.concatenate((waves(t), np.maximum(t[:, None] - at, 0.0) / 1000.0), axis=1)
        x = design(t)
        ridge = np.diag(np.append(np.zeros(x.shape[1] - len(at)), np.full(len(at), 1e-6)))
        weights = np.linalg.lstsq(np.concatenate((x, ridge)), np.append(y, np.zeros(len(ridge))), rcond=None)[0]
        spread = 1.96 * float(np.std(y - x @ weights))
        ahead = t[-1] + np.arange(1, horizon + 1)
        mean = design(ahead) @ weights
        return pd.DataFrame({key: frame[key].iloc[0], "date": [(days.iloc[-1] + pd.Timedelta(days=i)).date() for i in range(1,
            horizon + 1)], "forecast": mean, "low": mean - spread, "high": mean + spread})

    return run


def backtest(key: str, day: str, value: str, last: int = 10, least: int = 60):
    """A function for applyInPandas: one-step forecasts of the last days, each from the days before it."""
    forecast = seasonal_forecast(key, day, value, 1)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(day)
        rows = []
        for i in range(max(least, len(frame) - last), len(frame)):
            rows.append((frame[key].iloc[0], frame[day].iloc[i], float(frame[value].iloc[i]), float(forecast(frame.iloc[:i])["forecast"].iloc[0])))
        return pd.DataFrame(rows, columns=[key, "date", "actual", "forecast"])

    return run
