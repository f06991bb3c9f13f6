"""Peaks of series against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradescope.operators import peaks


def plain_peaks(x, distance, deviations):
    """Places of peaks and their prominence, by loops."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda p: (-x[p], p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = {}
    for p in kept:
        sides = []
        for way in (-1, 1):
            low, q = x[p], p + way
            while 0 <= q < len(x) and x[q] <= x[p]:
                low = min(low, x[q])
                q += way
            sides.append(low)
        if x[p] - max(sides) >= deviations * np.std(x):
            out[p] = x[p] - max(sides)
    return out


@pytest.mark.parametrize("fan, distance, deviations", [(4, 5, 1.0), (64, 3, 0.2), (3, 1, 0.0)])
def test_peaks_equal_plain_search(spark, monkeypatch, fan, distance, deviations):
    monkeypatch.setattr(peaks, "FAN", fan)
    g = np.random.default_rng(5)
    series = {0: g.normal(size=400).cumsum().round(1), 1: g.integers(0, 4, 150), 2: np.zeros(30), 3: [1.0], 4: np.sin(np.arange(300) / 9).round(3), 5: [1.0, 3.0, 3.0, 2.0]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k long, i long, x double").withColumn("note", F.lit("n"))
    df = df.unionByName(spark.createDataFrame([(0, 9999, None, "n")], df.schema))
    got = {(r["k"], r["i"]): r["prominence"] for r in peaks.find_peaks(df.withColumnRenamed("x", "v"), ["k"], ["i"], "v", distance, deviations).collect()}
    expected = {(k, p): h for k, x in series.items() for p, h in plain_peaks(np.array(x, dtype=float), distance, deviations).items()}
    assert got == pytest.approx(expected) and len(got) > 5
    assert peaks.find_peaks(df.withColumnRenamed("x", "v").limit(0), ["k"], ["i"], "v").count() == 0
