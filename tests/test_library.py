"""Hand-made cases: conventions, properties, and streams against tables."""

import pandas as pd
from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators import filters, graph, peaks, windows
from tradescope.streaming import events as E


def test_graph_of_two_triangles_and_a_bridge(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (8, 9, 1)], "src long, dst long, weight long")
    assert {r[0]: r[1] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 8, 9: 8}
    assert {r[0]: r[1] for r in graph.components(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).collect()}[6] == 1
    assert {r["node"]: r["triangles"] for r in graph.triangles(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert abs(sum(r["rank"] for r in graph.pagerank(e).collect()) - 1) < 1e-9
    paths = {r["node"]: r for r in graph.distances(e, 1).collect()}
    assert paths[6]["distance"] == 3 and paths[6]["path"] == [1, 3, 4, 6] and 8 not in paths


def test_peak_of_a_short_series(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0] * 5 + [9.0] + [1.0] * 6)], "k long, i long, v double")
    assert [(r["i"], r["prominence"]) for r in peaks.find_peaks(df, ["k"], ["i"], "v").collect()] == [(5, 8.0)]


def test_record_errors_name_the_rules(spark):
    shape = "pk string, hs_code string, date string, amount string, qty string, country_code string, company_name string"
    rows = [("a", "8418", "2023-01-15", "1", "2", "chn", "x"), ("b", "8x", None, "-1", None, "c1", None), ("c", None, "2023-02-30", "nan?", "1", None, None)]
    typed = filters.typed_records(spark.createDataFrame(rows, shape)).withColumn("e", filters.record_errors())
    assert {r["pk"]: r["e"] for r in typed.collect()} == {"a": [], "b": ["hs_code", "date", "amount", "country_code"], "c": ["hs_code", "date"]}


def test_adjusted_moments(spark):
    x = pd.Series([1.0, 2, 2, 3, 9])
    got = spark.createDataFrame(x.to_frame("x")).agg(S.adjusted_skew(F.col("x")).alias("s"), S.adjusted_kurtosis(F.col("x")).alias("k")).first()
    assert abs(got["s"] - x.skew()) < 1e-9 and abs(got["k"] - x.kurt()) < 1e-9


def test_ewm_equals_pandas(spark):
    frame = pd.DataFrame({"k": 1, "i": range(30), "x": [float((i * 37) % 11) for i in range(30)]})
    got = spark.createDataFrame(frame).select("i", windows.ewm_mean("x", 12, windows.ordered(["k"], ["i"])).alias("m")).orderBy("i").toPandas()
    assert (got["m"] - frame["x"].ewm(span=12).mean()).abs().max() < 1e-9


def stream_of(spark, df, path):
    df.repartition(3).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_windows_equal_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = stream_of(spark, events.coalesce(1), tmp_path / "in")
    make = lambda d: E.keyed_windows(d, "event_type", "1 hour", F.count(F.lit(1)).alias("n"))
    q = make(stream).writeStream.outputMode("complete").format("memory").queryName("windows_out").option("checkpointLocation",
        str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted(map(tuple, d.select("event_type", "start", "n").collect()))
    assert key(spark.table("windows_out")) == key(make(events))


def test_outbox_routes_each_event_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "customs" if i % 3 else "company") for i in range(30)], "id long, aggregate_type string")
    seen = {"customs": [], "company": []}
    keep = lambda name: lambda d: seen[name].extend(r["id"] for r in d.collect())
    q = stream_of(spark, rows, tmp_path / "in").writeStream.foreachBatch(E.route({n: keep(n) for n in seen})).option("checkpointLocation",
        str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(seen["customs"]) == [i for i in range(30) if i % 3] and sorted(seen["company"]) == [i for i in range(0, 30, 3)]


def test_cool_down_on_a_table(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 100, 299, 300, 650, 651)] + [("b", 5)], "stream string, at long")
    assert sorted(map(tuple, E.cool_down_table(df, "stream").collect())) == [("a", 0), ("a", 300), ("a", 650), ("b", 5)]


def test_snapshot_changes_can_be_applied(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k long, v string")
    found = {r["k"]: r["op"] for r in E.changes(before, after, "k").collect()}
    assert found == {2: "UPDATE", 3: "DELETE", 4: "INSERT"}
    log = spark.createDataFrame([(2, "x", 1, False), (2, "c", 2, False), (3, None, 1, True), (4, "d", 1, False)], "k long, v string, seq int, gone boolean")
    assert sorted(map(tuple, E.apply_changes(before, log, "k", "seq", F.col("gone")).collect())) == [(1, "a"), (2, "c"), (4, "d")]
