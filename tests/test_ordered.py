"""Orders over whole tables against numpy and pandas: quantiles, places, running sums, tests of samples, exponential means."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradescope.operators import ordered


@pytest.mark.parametrize("gathered", [1, 50, 10_000])
def test_quantiles_equal_percentile(spark, gathered):
    g = np.random.default_rng(1)
    rows = [("heavy", float(v)) for v in np.exp(g.normal(size=400) * 30) * g.choice([-1, 1], 400)]
    rows += [("same", 4.0)] * 300 + [("few", 1.0), ("few", 2.0), ("one", -7.5), (None, 3.0), (None, 9.0), ("none", None), ("few", float("nan"))]
    rows += [("zero", v) for v in (-0.0, 0.0, 5e-324, -5e-324, 1e308, -1e308)] + [("narrow", 1e9 + i * 1e-6) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    fractions = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: r["q"] for r in ordered.exact_quantiles(df, "x", fractions, by=("g",), gathered=gathered).collect()}
    plain = df.filter("NOT isnan(x)").groupBy("g").agg(F.percentile("x", list(fractions)).alias("q")).filter("q IS NOT NULL").collect()
    assert got == {r["g"]: r["q"] for r in plain} and set(got) == {"heavy", "same", "few", "one", None, "zero", "narrow"}
    whole = ordered.exact_quantiles(df, "x", fractions, gathered=gathered).first()["q"]
    assert whole == df.filter("NOT isnan(x)").agg(F.percentile("x", list(fractions))).first()[0]
    row = ordered.quantile_figures(df.limit(0), "x", a=0.5).first()
    assert row["a"] is None


def test_places_and_running_sums(spark):
    g = np.random.default_rng(2)
    x = pd.DataFrame({"k": g.integers(0, 3, 500), "v": g.integers(0, 40, 500), "w": g.random(500)})
    df = spark.createDataFrame(x).repartition(6)
    got = ordered.running_sums(df, ["v", "w"], ["v", "w"]).toPandas().sort_values("place")
    s = x.sort_values(["v", "w"])
    assert got["place"].tolist() == list(range(1, 501)) and got["v"].tolist() == s["v"].tolist()
    assert np.allclose(got["through_w"], s["w"].cumsum()) and got["through_v"].tolist() == s["v"].cumsum().tolist()
    got = ordered.numbered(df, ["k"], ["v", "w"]).toPandas().sort_values(["k", "place"])
    s = x.sort_values(["k", "v", "w"])
    assert got["w"].tolist() == s["w"].tolist() and got["place"].tolist() == s.groupby("k").cumcount().tolist()


def test_two_samples(spark):
    g = np.random.default_rng(3)
    a, b = g.normal(size=300).round(1), (g.normal(size=200) + 0.3).round(1)
    df = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "v double, a boolean")
    row = ordered.two_sample_ks(df, "v", F.col("a"), ~F.col("a")).first()
    every = np.unique(np.concatenate((a, b)))
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in every)
    z = d * math.sqrt(300 * 200 / 500)
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 200))
    assert abs(row["d"] - d) < 1e-12 and abs(row["p"] - p) < 1e-9
    same = ordered.two_sample_ks(df.withColumn("b", F.lit(True)), "v", F.col("b"), F.col("b")).first()
    assert same["d"] == 0 and same["p"] == 1


def test_exponential_means_equal_pandas(spark):
    g = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k, n in ((0, 1000), (1, 1), (2, 128), (3, 129)) for i, v in enumerate(g.normal(size=n).cumsum())]
    df = spark.createDataFrame(rows, "k long, i long, x double").repartition(5)
    got = ordered.ewm_means(df, ["k"], ["i"], "x", (1, 12, 26, 400)).toPandas().sort_values(["k", "i"])
    for span in (1, 12, 26, 400):
        expected = got.groupby("k")["x"].transform(lambda s, n=span: s.ewm(span=n).mean())
        assert np.allclose(got[f"ewm_{span}"], expected, rtol=1e-10, atol=1e-10)
