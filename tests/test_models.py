"""Operators without SQL: learned detectors, forecasts and graph rounds, against plain versions or planted cases."""

import datetime
import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradescope.operators import balls, boundary, communities, forecasts, graph, models, neighbours, networks, retrieval, texts
from tradescope.streaming import detectors


@pytest.fixture(scope="module")
def cloud(spark):
    """Two tight clusters and one point far from both."""
    g = np.random.default_rng(1)
    x = np.concatenate((g.normal(0, 1, (60, 2)), g.normal(20, 1, (60, 2)), [[60.0, -40.0]]))
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")


def scores(df):
    return np.array([r["score"] for r in sorted(df.collect(), key=lambda r: r["id"])])


def test_isolation_finds_the_far_point(cloud):
    s = scores(models.isolation_scores(cloud[1], "id", ["a", "b"]))
    assert s.argmax() == 120 and (s > 0).all() and (s <= 1).all()
    assert [r["id"] for r in models.flagged(models.isolation_scores(cloud[1], "id", ["a", "b"]), 0.02).collect()][-1:] == [120]


def test_mahalanobis_equals_numpy(cloud):
    x, df = cloud
    d = x - x.mean(axis=0)
    expected = (d @ np.linalg.inv(np.cov(x.T)) * d).sum(axis=1)
    assert np.allclose(scores(models.distance_scores(df, "id", ["a", "b"])), expected, rtol=1e-3)


def test_reconstruction_equals_numpy(cloud):
    x, df = cloud
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    first = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)[2][:1]
    expected = ((z - z @ first.T @ first) ** 2).sum(axis=1)
    assert np.allclose(scores(models.reconstruction_scores(df, "id", ["a", "b"], parts=1)), expected, atol=1e-6)


def test_local_density_equals_plain_lof(cloud):
    x, df = cloud
    k = 10
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach = np.sort(d, axis=1)[:, k - 1]
    density = np.array([1 / np.mean([max(d[i, j], reach[j]) for j in near[i]]) for i in range(len(x))])
    expected = np.array([np.mean(density[near[i]]) / density[i] for i in range(len(x))])
    got = scores(neighbours.local_outlier_factors(df, "id", ["a", "b"], k=k))
    assert np.allclose(got, expected) and got.argmax() == 120
    assert scores(neighbours.local_outlier_factors(df.limit(1), "id", ["a", "b"])).tolist() == [1.0]


def test_fraud_model_prefers_fraud(spark):
    rows = [(i, float(i % 50), float(i % 7), int(i % 50 > 45)) for i in range(600)]
    p = models.fraud_probabilities(spark.createDataFrame(rows, "id long, a double, b double, y int"), "id", ["a", "b"], "y").toPandas()
    for name in ("forest", "boosted", "leaf_boosted"):
        assert p[p["y"] == 1][name].min() > p[p["y"] == 0][name].max()
    one = models.fraud_probabilities(spark.createDataFrame(rows[:40], "id long, a double, b double, y int"), "id", ["a", "b"], "y").toPandas()
    assert set(one["boosted"]) == {0.0} and len(one) == 40


def test_factorisation_recommends_the_group_s_items(spark):
    rows = [(u, i, 5.0 if u % 2 == i % 2 else 1.0) for u in range(20) for i in range(12) if (u * 7 + i) % 3]
    got = models.recommend(spark.createDataFrame(rows, "user_id int, item_id int, rating double"), "user_id", "item_id", "rating", k=3).collect()
    assert np.mean([r["user_id"] % 2 == r["item_id"] % 2 for r in got]) > 0.9


def days(n):
    return [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(n)]


def test_seasonal_forecast_and_backtest_follow_a_wave(spark):
    wave = lambda i: 100 + 0.1 * i + 10 * math.sin(2 * math.pi * i / 7)
    frame = pd.DataFrame({"id": 1, "date": days(400), "amount": [wave(i) for i in range(400)]})
    ahead = models.seasonal_forecast("id", "date", "amount")(frame)
    assert np.abs(ahead["forecast"] - [wave(i) for i in range(400, 414)]).max() < 1.0
    assert (ahead["low"] <= ahead["forecast"]).all() and (ahead["high"] >= ahead["forecast"]).all()
    tested = models.backtest("id", "date", "amount")(frame)
    assert len(tested) == 10 and np.abs(tested["forecast"] - tested["actual"]).max() < 1.0


def test_a_planted_break_of_the_trend_is_found():
    rng = np.random.default_rng(3)
    line = lambda i: 50 + 0.3 * i - 0.8 * max(0, i - 300) + 8 * math.sin(2 * math.pi * i / 7)
    y = np.array([line(i) for i in range(500)]) + rng.normal(size=500)
    t = np.arange(500.0)
    seasons = np.stack([np.ones(500), t / 1000, np.sin(2 * np.pi * t / 7), np.cos(2 * np.pi * t / 7)], axis=1)
    found = models.changepoints(t, y, seasons)
    assert 1 <= len(found) <= 4 and min(abs(found - 300)) <= 16
    straight = np.array([50 + 0.3 * i + 8 * math.sin(2 * math.pi * i / 7) for i in range(500)]) + rng.normal(size=500)
    assert len(models.changepoints(t, straight, seasons)) == 0
    ahead = models.seasonal_forecast("id", "date", "amount")(pd.DataFrame({"id": 1, "date": days(500), "amount": y}))
    assert np.abs(ahead["forecast"] - [line(i) for i in range(500, 514)]).max() < 6
    x = rng.normal(size=(200, 5))
    w = models.lasso(x, x @ [2.0, 0, 0, -1.0, 0] + 0.01 * rng.normal(size=200), np.full(5, 0.1))
    assert w[1] == w[2] == w[4] == 0 and abs(w[0] - 1.9) < 0.05 and abs(w[3] + 0.9) < 0.05


def test_boundary_of_a_ring_leaves_its_middle_out(spark):
    rng = np.random.default_rng(1)
    turn = rng.uniform(0, 2 * np.pi, 600)
    ring = np.stack([np.cos(turn), np.sin(turn)], axis=1) * (5 + rng.normal(size=(600, 1)) * 0.2)
    points = np.concatenate((ring, [[0.0, 0.0], [9.0, 9.0]]))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, a double, b double").repartition(4)
    got = {r["id"]: r["score"] for r in boundary.one_class_scores(df, "id", ["a", "b"], outside=0.1, gamma=2.0).collect()}
    assert got[600] > 0 and got[601] > 0 and 0.02 < np.mean([got[i] > 0 for i in range(600)]) < 0.2
    assert got[600] > np.quantile([got[i] for i in range(600)], 0.99)
    assert boundary.one_class_scores(df.limit(0), "id", ["a", "b"]).count() == 0


def test_forecasts_by_models_beat_the_mean(spark):
    months = [datetime.date(2015 + i // 12, 1 + i % 12, 1) for i in range(72)]
    rows = [(k, m, 50.0 * k + 20 * math.sin(2 * math.pi * i / 12) + i * 0.1) for k in range(1, 9) for i, m in enumerate(months)]
    series = spark.createDataFrame(rows, "k long, month date, v double")
    for found in (forecasts.boosted_forecast(series, "k", "month", "v"), forecasts.price_ensemble(series, "k", "month", "v")):
        x = found.toPandas()
        assert 90 <= len(x) <= 130
        assert np.abs(x["forecast"] - x["v"]).mean() < 0.6 * np.abs(x["v"] - np.mean([r[2] for r in rows])).mean()
    x = forecasts.boosted_forecast(series, "k", "month", "v").toPandas()
    assert (x["low"] < x["forecast"]).all() and forecasts.price_ensemble(series.limit(0), "k", "month", "v").count() == 0


EDGES = [(1, 2, 1), (2, 3, 2), (1, 3, 1), (3, 4, 1), (4, 5, 3), (5, 6, 1), (4, 6, 1), (6, 7, 1), (10, 11, 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long, weight long")


def paths():
    """All shortest paths of the test graph, plainly."""
    near = {}
    for a, b, _ in EDGES:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {}
    for s in near:
        level, seen = [[s]], {s: 0}
        while level:
            nxt = []
            for p in level:
                found.setdefault((s, p[-1]), []).append(p)
                nxt += [[*p, b] for b in near[p[-1]] if b not in seen or seen[b] == len(p)]
            for p in nxt:
                seen.setdefault(p[-1], len(p) - 1)
            level = [p for p in nxt if seen[p[-1]] == len(p) - 1]
    return found


def test_distances_and_betweenness_equal_all_paths(edges):
    found = paths()
    got = {(r["source"], r["node"]): (r["distance"], r["paths"]) for r in networks.all_distances(edges).collect()}
    assert got == {k: (len(v[0]) - 1, float(len(v))) for k, v in found.items()}
    nodes = {a for a, _ in found}
    expected = {n: sum(sum(n in p[1:-1] for p in v) / len(v) for (s, t), v in found.items() if s != t) / ((len(nodes) - 1) * (len(nodes) - 2)) for n in nodes}
    between = {r["node"]: r["betweenness"] for r in networks.betweenness(edges).collect()}
    assert all(abs(between[n] - expected[n]) < 1e-12 for n in nodes)


def test_reach_and_sampling_equal_all_paths(edges):
    """Sketches are exact while few nodes are within reach; paths from all nodes are exact; a sample keeps its error."""
    found = paths()
    nodes = {a for a, _ in found}
    reach = balls.reach_counts(edges)
    got = {(r["node"], r["distance"]): r["reached"] for r in reach.collect()}
    for n in nodes:
        steps = [len(v[0]) - 1 for (s, _), v in found.items() if s == n]
        for d in range(max(steps) + 1):
            assert got[n, d] == sum(x <= d for x in steps)
        assert (n, max(steps) + 1) not in got
    exact = {r["node"]: r["closeness"] for r in networks.closeness(networks.all_distances(edges)).collect()}
    near = {r["node"]: r["closeness"] for r in balls.closeness_by_reach(reach).collect()}
    assert near == pytest.approx(exact)
    lengths = {r["distance"]: (r["pairs"], r["diameter"]) for r in balls.path_lengths_by_reach(reach).collect()}
    every = [len(v[0]) - 1 for v in found.values()]
    assert lengths == {d: (every.count(d), max(every)) for d in range(1, max(every) + 1)}
    exact = {r["node"]: r["betweenness"] for r in networks.betweenness(edges).collect()}
    whole = balls.sampled_betweenness(edges, batch=4).collect()
    assert {r["node"]: r["betweenness"] for r in whole} == pytest.approx(exact) and all(r["error"] == 0 for r in whole)
    some = balls.sampled_betweenness(edges, error=0.9, batch=2).collect()
    assert all(abs(r["betweenness"] - exact[r["node"]]) <= r["error"] for r in some) and any(r["error"] > 0 for r in some)


def test_sketches_of_a_larger_graph_keep_their_error(spark):
    rng = np.random.default_rng(9)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 1500, (3000, 2)) if a < b}
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    last = {}
    for r in balls.reach_counts(e, lg_k=11).collect():
        last[r["node"]] = max(last.get(r["node"], 0), r["reached"])
    for start in sorted(near)[:40]:
        seen, todo = {start}, [start]
        while todo:
            todo = [y for x in todo for y in near[x] if y not in seen and not seen.add(y)]
        assert abs(last[start] - len(seen)) <= 0.1 * len(seen) + 1


def test_louvain_is_at_least_label_propagation_and_never_falls(spark, edges):
    rng = np.random.default_rng(4)
    dense = {(a, b) for g in range(5) for a in range(g * 12, g * 12 + 12) for b in range(a + 1, g * 12 + 12) if rng.random() < 0.5}
    loose = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (25, 2)) if a != b}
    e = spark.createDataFrame([(a, b, 1) for a, b in dense | loose], "src long, dst long, weight long")
    for graph_ in (e, edges):
        found, levels = communities.louvain(graph_)
        found = found.cache()
        quality = networks.modularity(graph_, found).first()["modularity"]
        assert levels == sorted(levels) and abs(levels[-1] - quality) < 1e-9
        assert quality >= networks.modularity(graph_, communities.propagate_labels(graph_)).first()["modularity"] - 1e-9
        assert {r["community"] for r in found.collect()} <= {r["node"] for r in found.collect()}
    groups = {}
    for r in communities.louvain(e)[0].collect():
        groups.setdefault(r["node"] // 12, []).append(r["community"])
    assert np.mean([max(g.count(c) for c in g) / len(g) for g in groups.values()]) > 0.9
    best = max(_quality(dict(zip(range(1, 8), split, strict=True))) for split in _splits(7))
    small = spark.createDataFrame([x for x in EDGES if x[0] < 8], "src long, dst long, weight long")
    assert communities.louvain(small)[1][-1] >= best - 0.02
    assert communities.louvain(edges.limit(0))[0].count() == 0


def _splits(n, most=0):
    if n == 0:
        yield []
        return
    for rest in _splits(n - 1):
        for c in range(max(rest, default=-1) + 2):
            yield [*rest, c]


def _quality(label):
    inside = [x for x in EDGES if x[0] < 8]
    m = sum(w for *_, w in inside)
    degree = Counter()
    for a, b, w in inside:
        degree[label[a]] += w
        degree[label[b]] += w
    return sum(w for a, b, w in inside if label[a] == label[b]) / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def test_eigenvector_equals_numpy(edges):
    nodes = sorted({x for a, b, _ in EDGES for x in (a, b)})
    m = np.eye(len(nodes))
    for a, b, _ in EDGES:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = 1
    v = np.ones(len(nodes))
    for _ in range(500):
        v = m @ v
        v /= np.sqrt((v * v).sum())
    got = {r["node"]: r["score"] for r in networks.eigenvector(edges, 1e-8).collect()}
    assert all(abs(got[n] - v[i]) < 1e-6 for i, n in enumerate(nodes))


def test_strong_components_of_two_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "src long, dst long").withColumn("weight", F.lit(1))
    assert {r["node"]: r["component"] for r in networks.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_communities_and_modularity_equal_the_formula(edges):
    found = {r["node"]: r["community"] for r in communities.propagate_labels(edges).collect()}
    assert found[10] == found[11] and len(set(found.values())) >= 2
    m = sum(w for *_, w in EDGES)
    degree = {}
    for a, b, w in EDGES:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    expected = sum(w / m for a, b, w in EDGES if found[a] == found[b]) - sum((sum(d for n, d in degree.items() if found[n] == c) / (2 * m)) ** 2 for c in set(found.values()))
    row = networks.modularity(edges, communities.propagate_labels(edges)).first()
    assert abs(row["modularity"] - expected) < 1e-12 and row["communities"] == len(set(found.values()))


def test_pagerank_equals_numpy(edges):
    nodes = sorted({x for a, b, _ in EDGES for x in (a, b)})
    n, at = len(nodes), {x: i for i, x in enumerate(nodes)}
    m = np.zeros((n, n))
    for a, b, _ in EDGES:
        m[at[b], at[a]] = 1
    out = m.sum(axis=0)
    rank = np.full(n, 1 / n)
    for _ in range(200):
        rank = 0.15 / n + 0.85 * (m @ np.where(out > 0, rank / np.maximum(out, 1), 0) + rank[out == 0].sum() / n)
    got = {r["node"]: r["rank"] for r in graph.pagerank(edges, tolerance=1e-9).collect()}
    assert all(abs(got[x] - rank[at[x]]) < 1e-7 for x in nodes)


def test_rake_scores_phrases_by_degree(spark):
    df = spark.createDataFrame([(1, "The red river bank, red lamp and the lamp. Old stone bridge of the river"), (2, None)], "id long, text string")
    got = {r["phrase"]: r["score"] for r in texts.rake(df, "id", "text").collect()}
    red, lamp, river = (3 + 2) / 2, (2 + 1) / 2, (3 + 1) / 2
    assert got["red river bank"] == pytest.approx(red + river + 3) and got["red lamp"] == pytest.approx(red + lamp) and got["lamp"] == pytest.approx(lamp)
    assert got["old stone bridge"] == pytest.approx(9)


def test_vector_search_in_blocks_equals_all_pairs(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(90, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(200, [0.0] * 5), (201,
        None)], "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    cos = unit @ unit.T
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in retrieval.vector_search(df.filter("vec_id % 10 = 0"), df, k=4, block=16).collect()}
    expected = {(q, int(i)) for q in range(0, 90, 10) for i in sorted((i for i in range(90) if i != q), key=lambda i: -cos[q, i])[:4]}
    assert set(got) == expected and all(abs(s - cos[q, i]) < 1e-12 for (q, i), s in got.items())


def as_stream(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def collected(stream, path, name, spark):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_ring_scores_of_a_stream_equal_the_table(spark, tmp_path):
    g = np.random.default_rng(2)
    df = spark.createDataFrame([(int(k), i, float(g.normal())) for i in range(150) for k in (1, 2)], "k long, seq long, v double").coalesce(1)
    table = {(r["k"], r["seq"]): r["score"] for r in detectors.ring_scores_table(df, "k", ("seq",), "v", ring=30).collect()}
    got = {(r["k"], r["seq"]): r["score"] for r in collected(detectors.ring_scores(as_stream(spark, df, tmp_path / "in"),
        "k", "v", ring=30), tmp_path / "cp", "ring_out", spark)}
    assert got.keys() == table.keys() and all(abs(got[x] - table[x]) < 1e-9 for x in got)


def test_failed_logins_of_a_stream_equal_the_table(spark, tmp_path):
    outcomes = itertools.cycle(["failed", "failed", "other", "failed", "failed", "success", "failed"])
    df = spark.createDataFrame([(i % 3, i, next(outcomes)) for i in range(60)], "user long, seq long, outcome string").coalesce(1)
    found = detectors.failed_logins_table(df, "user", ("seq",), F.col("outcome") == "failed", F.col("outcome") == "success")
    table = {(r["user"], r["seq"]): (r["failures"], r["locked"]) for r in found.collect()}
    got = {(r["user"], r["seq"]): (r["failures"], r["locked"]) for r in collected(detectors.failed_logins(as_stream(spark,
        df, tmp_path / "in"), "user"), tmp_path / "cp", "logins_out", spark)}
    assert got == table
