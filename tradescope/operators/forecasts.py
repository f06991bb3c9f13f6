"""Forecasts by models over all series at once, and mixtures of forecasts."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["f_lag1", "f_lag2", "f_lag3", "f_mean3", "f_month"]


def lag_features(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Add lags 1 to 3, the mean of the three before, and the month; rows without three before them go."""
    w = Window.partitionBy(key).orderBy(at)
    lags = {f"f_lag{i}": F.lag(value, i).over(w) for i in (1, 2, 3)}
    x = series.withColumns(lags).withColumns({"f_mean3": (F.col("f_lag1") + F.col("f_lag2") + F.col("f_lag3")) / 3, "f_month": F.month(at).cast("double")})
    return x.filter(F.col("f_lag3").isNotNull())


def split_by_time(rows: DataFrame, at: str, share: float = 0.8) -> DataFrame:
    """Add ``late``: whether a row lies beyond that share of the whole span of time."""
    span = rows.agg(F.min(at).alias("from_"), F.max(at).alias("to_"))
    late = F.datediff(F.col(at), F.col("from_")) > share * F.datediff("to_", "from_")
    return rows.join(F.broadcast(span)).withColumn("late", late).drop("from_", "to_")


def boosted_forecast(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, value, forecast, low, high) of the last fifth of time, by boosted trees over the first four.

    One model serves all series; bounds lie 1.96 deviations of the training errors around the forecast.
    """
    rows = split_by_time(lag_features(series, key, at, value), at)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("label", F.col(value).cast("double")))
    early = ready.filter(~F.col("late"))
    if early.limit(1).count() == 0:
        return rows.limit(0).select(key, at, value, *[F.lit(0.0).alias(c) for c in ("forecast", "low", "high")])
    model = GBTRegressor(maxIter=10, maxDepth=3, seed=5).fit(early)
    error = model.transform(early).agg(F.stddev_pop(F.col("label") - F.col("prediction")).alias("e"))
    found = model.transform(ready.filter("late")).join(F.broadcast(error))
    return found.select(key, at, value, F.col("prediction").alias("forecast"), (F.col("prediction") - 1.96 * F.col("e")).alias("low"),
        (F.col("prediction") + 1.96 * F.col("e")).alias("high"))


def price_ensemble(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, value, forecast, dispersion): three models weighted by how small their errors are.

    Linear regression, a random forest and boosted trees learn from the first three fifths of
    time, are weighted by 1 / RMSE on the fourth, and forecast the last. Dispersion is the
    population deviation of the three.
    """
    rows = split_by_time(lag_features(series, key, at, value), at)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("label", F.col(value).cast("double")))
    early = split_by_time(ready.filter(~F.col("late")).drop("late"), at, 0.75)
    train, check = early.filter(~F.col("late")).drop("late"), early.filter("late").drop("late")
    if train.limit(1).count() == 0 or check.limit(1).count() == 0:
        return rows.limit(0).select(key, at, value, *[F.lit(0.0).alias(c) for c in ("forecast", "dispersion")])
    late = ready.filter("late")
    models = {"linear": LinearRegression(regParam=0.1), "forest": RandomForestRegressor(numTrees=10, maxDepth=4,
        seed=5), "boosted": GBTRegressor(maxIter=10, maxDepth=3, seed=5)}
    fitted = {n: m.setPredictionCol(n).fit(train) for n, m in models.items()}
    for model in fitted.values():
        check, late = model.transform(check), model.transform(late)
    rmse = check.agg(*[F.sqrt(F.avg(F.pow(F.col(n) - F.col("label"), 2))).alias(n) for n in models]).first()  # one row
    weight = {n: 1.0 / max(rmse[n], 1e-9) for n in models}
    total = sum(weight.values())
    mean = sum((F.col(n) for n in models), F.lit(0.0)) / len(models)
    spread = F.sqrt(sum((F.pow(F.col(n) - mean, 2) for n in models), F.lit(0.0)) / len(models))
    return late.select(key, at, value, sum((F.col(n) * (w / total) for n, w in weight.items()), F.lit(0.0)).alias("forecast"), spread.alias("dispersion"))


def blend(first: Column, second: Column, deviation: Column, weight: float = 0.6) -> dict[str, Column]:
    """A blend of two forecasts with the envelope of both 95 % intervals."""
    low, high = F.least(first, second) - 1.96 * deviation, F.greatest(first, second) + 1.96 * deviation
    return {"forecast": weight * first + (1 - weight) * second, "low": low, "high": high}


def technical_signal(close: Column, rsi: Column, sma20: Column, sma50: Column, upper: Column, lower: Column) -> Column:
    """Signals of a bar, joined by commas: RSI beyond 30 and 70, averages in order, bands broken; neutral without any. Unknown figures signal nothing."""
    parts = [
        F.when(rsi < 30, "oversold").when(rsi > 70, "overbought"),
        F.when((close > sma20) & (sma20 > sma50), "golden_cross").when((close < sma20) & (sma20 < sma50), "death_cross"),
        F.when(close > upper, "breakout_upper").when(close < lower, "breakout_lower"),
    ]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("neutral"))


def rating_points(signal: Column, pe_ratio: Column, sentiment: Column, change: Column) -> Column:
    """Up to 20 points each for the signal, the price to earnings ratio, sentiment and the expected change in percent; unknown ratios give none, other unknowns count 0."""
    mood, ahead = F.coalesce(sentiment, F.lit(0.0)), F.coalesce(change, F.lit(0.0))
    parts = [
        F.when(F.contains(signal, F.lit("golden_cross")), 20).when(F.contains(signal, F.lit("oversold")), 15).otherwise(0),
        F.when(pe_ratio.between(10, 25), 20).when((pe_ratio != 0) & (pe_ratio < 15), 15).otherwise(0),
        F.when(mood > 0.1, 20).when(mood > -0.1, 10).otherwise(0),
        F.when(ahead > 10, 20).when(ahead > 0, 10).otherwise(0),
    ]
    return sum(parts[1:], parts[0])


def rating(points: Column) -> Column:
    """strong_buy from 70, buy from 50, hold from 30, else sell."""
    return F.when(points >= 70, "strong_buy").when(points >= 50, "buy").when(points >= 30, "hold").otherwise("sell")
