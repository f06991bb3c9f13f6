"""Streams with keyed state against their table twins, over several batches, expiry included."""

import random

import pytest
from pyspark.sql import functions as F

from tradescope.streaming import detectors, events, keyed


@pytest.fixture(scope="module")
def points():
    r = random.Random(8)
    return [(k, i, round(r.gauss(0, 1) + (9 if r.random() < 0.04 else 0), 3)) for k in range(3) for i in range(70)]


def streamed(spark, df, path, make, name, order):
    """The rows that an operator makes of a stream in three batches, in order of a column."""
    rows = df.orderBy(order).collect()
    for n in range(3):
        part = spark.createDataFrame(rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3], df.schema).coalesce(1)
        part.write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_rings_and_quick_checks(spark, tmp_path, points):
    df = spark.createDataFrame(points, "k long, seq long, v double")
    got = streamed(spark, df, tmp_path, lambda s: keyed.ring_scores(s, "k", "v", ring=30), "ring_rows", "seq")
    table = detectors.ring_scores_table(df, "k", ("seq",), "v", ring=30).collect()
    assert {(r["k"], r["seq"]): pytest.approx(r["score"]) for r in table} == {(r["k"], r["seq"]): r["score"] for r in got} and len(got) == len(table)


def test_quick_checks(spark, tmp_path, points):
    df = spark.createDataFrame(points, "k long, seq long, v double")
    got = {(r["k"], r["seq"]): (r["odd"], r["jump"]) for r in streamed(spark, df, tmp_path, lambda s: keyed.quick_checks(s, "k", "v"), "quick_rows", "seq")}
    table = {(r["k"], r["seq"]): (r["odd"], r["jump"]) for r in detectors.quick_checks(df, "k", ("seq",), "v").filter("seq > 0").collect()}
    assert got == table and any(o for o, _ in got.values()) and any(j for _, j in got.values())


def test_cool_down(spark, tmp_path):
    r = random.Random(2)
    df = spark.createDataFrame([(r.choice("ab"), t) for t in sorted(r.randrange(5000) for _ in range(120))], "stream string, at long")
    got = streamed(spark, df, tmp_path, lambda s: keyed.cool_down(s, "stream"), "cool_rows", "at")
    assert sorted(map(tuple, got)) == sorted(map(tuple, events.cool_down_table(df, "stream").collect()))


def timed(spark, rows, shape):
    return spark.createDataFrame(rows, shape).withColumn("ts", F.timestamp_seconds("seq"))


def test_counters_expire(spark, tmp_path):
    r = random.Random(3)
    times = sorted(r.sample(range(40_000), 60))
    df = timed(spark, [(r.randrange(3), t) for t in times] + [(9, 90_000)], "k long, seq long")
    got = streamed(spark, df, tmp_path, lambda s: keyed.expiring_counters(s.withWatermark("ts", "10 seconds"), "k", 3600), "counter_rows", "seq")
    table = keyed.expiring_counters_table(df, "k", ("seq",), 3600)
    assert {(r["k"], r["seq"], r["n"]) for r in got if r["what"] == "write"} == {(r["k"], r["seq"], r["n"]) for r in table.collect()}
    ends = {(r["k"], r["ends"], r["n"]) for r in table.groupBy("k", "ends").agg(F.max("n").alias("n")).filter("ends <= 89990").collect()}
    late = {(r["k"], r["seq"], r["n"]) for r in got if r["what"] == "expired"}
    last = {k: max(e for a, e, _ in ends if a == k) for k, *_ in ends}
    assert late <= ends and {(k, e, n) for k, e, n in ends if e == last[k]} <= late  # a counter that is written to again in time starts anew without a timer


def test_concurrent_sessions(spark, tmp_path):
    r = random.Random(4)
    times = sorted(r.sample(range(60_000), 150))
    df = timed(spark, [(r.randrange(2), r.choice("abcdef"), t) for t in times], "user long, token string, seq long")
    got = streamed(spark, df, tmp_path, lambda s: keyed.concurrent_sessions(s.withWatermark("ts", "10 seconds"), "user", 1800, 2), "session_rows", "seq")
    table = keyed.concurrent_sessions_table(df, "user", 1800, 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, table)) and {r["allowed"] for r in table} == {True, False}
