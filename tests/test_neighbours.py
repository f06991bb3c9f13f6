"""Neighbours, overlaps and clusters against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradescope.operators import neighbours, overlaps


def plain_near(q, x, k, radius):
    out = []
    for i, kind, v in q:
        d = sorted((math.dist(v, w), j) for j, other, w in x if j != i and other == kind and math.dist(v, w) <= radius)
        cut = d[k - 1][0] if k is not None and len(d) >= k else math.inf
        out += [(i, j) for a, j in d if a <= cut]
    return sorted(out)


@pytest.mark.parametrize("k, radius", [(3, math.inf), (None, 0.9), (4, 0.8), (500, math.inf)])
def test_pairs_equal_all_pairs(spark, k, radius):
    g = np.random.default_rng(1)
    x = [(i, "ab"[i % 2], [float(v) for v in g.normal(size=3).round(2) + 5 * (i % 4)]) for i in range(240)] + [(240 + i, "a", [1.0, 1.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(x, "id long, kind string, v array<double>").withColumn("n", F.lit(1).cast("long"))
    found = neighbours.neighbour_pairs(df.filter("id % 7 = 0"), df, k, radius, pivots=8, block=25).collect()
    got = sorted((r["query_id"], r["id"]) for r in found if r["query_id"] >= 0)
    assert got == plain_near([r for r in x if r[0] % 7 == 0], x, k, radius)
    assert neighbours.neighbour_pairs(df, df.limit(0), k, radius).count() == 0


def test_cells_spare_pairs(spark):
    g = np.random.default_rng(2)
    x = [(i, "", [float(v) for v in g.normal(size=4) * 0.1 + 10 * g.integers(0, 2, 1) + (i % 30) * 5]) for i in range(1500)]
    df = spark.createDataFrame(x, "id long, kind string, v array<double>").withColumn("n", F.lit(1).cast("long"))
    compared = neighbours.neighbour_pairs(df, df, 5).filter("query_id < 0").agg(F.sum("compared")).first()[0]
    assert compared < 0.1 * 1500 * 1500


def test_outlier_factors_with_copies_equal_plain(spark):
    g = np.random.default_rng(3)
    x = np.concatenate((g.normal(size=(80, 2)).round(1), np.repeat([[0.5, 0.5], [3.0, 3.0]], [30, 4], axis=0), [[9.0, 9.0]]))
    k = 6
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["score"] for r in neighbours.local_outlier_factors(df, "id", ["a", "b"], k=k).collect()}
    assert len(got) == len(x) and got[len(x) - 1] > 2
    np.fill_diagonal(d, np.inf)
    far = np.sort(d, axis=1)[:, k - 1]
    clear = [i for i in range(len(x)) if np.sort(d, axis=1)[i, k] > far[i] + 1e-9]  # no tie at the k-th: the neighbours are determined
    near = {i: np.argsort(d[i], kind="stable")[:k] for i in range(len(x))}
    density = {i: 1 / (np.mean([max(d[i, j], far[j]) for j in near[i]]) + 1e-10) for i in range(len(x))}
    sure = [i for i in clear if all(j in clear for j in near[i])]
    assert len(sure) > 5
    for i in sure:
        assert abs(got[i] - np.mean([density[j] for j in near[i]]) / density[i]) < 1e-6 * max(1, got[i])
    assert len({round(got[i], 9) for i in range(80, 110)}) == 1


WORDS = [f"w{i}" for i in range(40)]


def random_sets(n, seed):
    r = random.Random(seed)
    return [[w for w in r.sample(WORDS, r.randrange(0, 15))] + ["the"] * (r.random() < 0.9) for _ in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8])
def test_sharing_equals_all_pairs(spark, share):
    docs, asked = random_sets(150, 1) + [None], random_sets(12, 2) + [["unknown", "the"], []]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, w array<string>")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, q array<string>")
    found = overlaps.sharing(overlaps.rare_first(q, d), d, F.ceil(F.lit(share) * F.size("q"))).collect()
    expected = {(i, j): len({*a} & {*b}) for i, a in enumerate(asked) for j, b in enumerate(docs) if b and len({*a} & {*b}) >= max(1, math.ceil(share * len(a)))}
    assert {(r["query_id"], r["id"]): r["shared"] for r in found} == expected and len(found) == len(expected)


def test_best_sharing_holds_the_best(spark):
    docs, asked = random_sets(200, 3), random_sets(10, 4)
    d = spark.createDataFrame([(i, w, i % 3) for i, w in enumerate(docs)], "id long, w array<string>, plus int")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, q array<string>")
    found = overlaps.best_sharing(q, d, 4, lambda shared: shared + F.col("plus"), bonus=2, first=2).collect()
    for i, a in enumerate(asked):
        best = sorted(((-(len({*a} & {*b}) + j % 3), j) for j, b in enumerate(docs) if {*a} & {*b}))[:4]
        assert sorted((-r["score"], r["id"]) for r in found if r["query_id"] == i)[:4] == best


def plain_units(texts):
    counts = [Counter(t.split()) for t in texts]
    df = Counter(w for c in counts for w in c)
    out = []
    for c in counts:
        v = {w: n * math.log(len(texts) / df[w]) for w, n in c.items() if df[w] < len(texts)}
        length = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / length for w, x in v.items()} if length else {})
    return out


def test_cosines_and_clusters_equal_all_pairs(spark):
    r = random.Random(6)
    groups = [["alpha beta gamma", "alpha beta delta", "alpha beta"], ["kernel panic on node", "kernel panic on host", "kernel panic"]]
    texts = [" ".join([r.choice(g), r.choice(["", "x", "y"])]).strip() + " line" for g in groups for _ in range(12)] + ["zebra crossing line", "lonely quartz line", "line"]
    texts = sorted({*texts})
    units = plain_units(texts)
    dot = lambda a, b: sum(x * b.get(w, 0.0) for w, x in a.items())
    points = spark.createDataFrame([(i, t, 1 + i % 2) for i, t in enumerate(texts)], "id long, text string, copies long")
    terms = points.select("id", F.explode(F.split("text", " ")).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    unit = overlaps.unit_vectors(terms, len(texts)).cache()
    for least in (0.2, 0.5, 0.9):
        got = {(p["query_id"], p["id"]): p["similarity"] for p in overlaps.cosine_pairs(unit, unit, least).collect()}
        expected = {(i, j): dot(a, b) for i, a in enumerate(units) for j, b in enumerate(units) if i != j and dot(a, b) >= least}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    near = {i: [j for j in range(len(texts)) if i == j or dot(units[i], units[j]) >= 0.5] for i in range(len(texts))}
    core = {i for i in near if sum(1 + j % 2 for j in near[i]) >= 5}
    found = {p["id"]: (p["kind"], p["cluster"]) for p in overlaps.density_clusters(unit, points.select("id", "copies"), 0.5, 5).collect()}
    for i in range(len(texts)):
        assert found[i][0] == ("core" if i in core else "border" if any(j in core for j in near[i]) else "noise")
    for i in core:
        assert all(found[j][1] == found[i][1] for j in near[i] if j in core)
    assert {found[i][0] for i, t in enumerate(texts) if t.split()[0] in ("zebra", "lonely")} == {"noise"} and any(c is not None for _, c in found.values())
