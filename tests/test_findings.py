"""Small cases of faults that reviews found."""

import math

from pyspark.sql import functions as F

from tradescope.functions import scalars as S
from tradescope.operators import graph, joins, overlaps, texts


def test_sentences_lose_blanks_and_no_digits(spark):
    text = "Zero 0. 19.37.233.111!  2 and 2 " + " ? three 3"
    found = spark.createDataFrame([(text,), (None,)], "text string").select(S.sentences(F.col("text")).alias("s")).collect()
    assert found[0]["s"] == ["Zero 0.", "19.37.233.111!", "2 and 2  ?", "three 3"] and found[1]["s"] is None


def test_spread_of_sentence_lengths_counts_words_at_the_ends(spark):
    df = spark.createDataFrame([("a b. 1 2 1.",)], "text string")
    row = df.select(texts.style(F.col("text"))["variety"].alias("v")).first()
    assert math.isclose(row["v"], 0.2)


def test_reading_ease_is_weighed_before_it_is_divided(spark):
    df = spark.range(1, 400).selectExpr("id AS n").crossJoin(spark.range(1, 12).selectExpr("id AS s")).withColumn("y", F.col("n") * 2 + 1)
    f = texts.readability(F.col("n"), F.col("s"), F.col("y"))
    for row in df.select("n", "s", "y", f["flesch"].alias("flesch"), f["grade"].alias("grade")).collect():
        n, s, y = row["n"], row["s"], row["y"]
        assert row["flesch"] == max(0.0, min(100.0, 206.835 - n * 1015 / 1000 / s - y * 846 / 10 / n))
        assert row["grade"] == n * 39 / 100 / s + y * 118 / 10 / n - 15.59


def test_every_document_that_shares_a_word_is_found(spark):
    q = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, None)], "query_id long, q array<string>")
    d = spark.createDataFrame([(10, ["a"] + [f"w{i}" for i in range(99)]), (11, ["x", "d"]), (12, ["y"]), (13, None), (14, [])], "id long, w array<string>")
    got = sorted((r["query_id"], r["id"], r["shared"], r["n_terms"]) for r in overlaps.all_sharing(q, d).collect())
    assert got == [(1, 10, 1, 100), (1, 11, 1, 2), (2, 11, 1, 2)]


def test_counted_pairs_equal_a_self_join_over_many_blocks(spark):
    rows = [((i * 7919) % 53, (i * 104729) % 900 + 1) for i in range(9000)] + [(None, 1), (1, None)]
    links = spark.createDataFrame(rows, "k long, e int")
    keys: dict[int, set[int]] = {}
    for k, e in rows:
        if k is not None and e is not None:
            keys.setdefault(k, set()).add(e)
    shared: dict[tuple[int, int], int] = {}
    for es in keys.values():
        for a in es:
            for b in es:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    found = joins.counted_pairs(links, ["k"], "e", 1, 900)
    assert {(r["src"], r["dst"]): r["weight"] for r in found.collect()} == {p: n for p, n in shared.items() if n > 1}
    assert "BroadcastNestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "SortMergeJoin" not in plan
    assert joins.counted_pairs(links.filter("e < 0"), ["k"], "e", 1, 0).count() == 0


def test_strong_components_of_two_cycles_and_a_bridge(spark):
    from tradescope.operators import networks

    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1), (4, 5, 1), (5, 4, 1), (5, 6, 1), (1, 2, 1)], "src long, dst long, weight long")
    assert {r[0]: r[1] for r in networks.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_triangles_by_blocks_equal_those_by_pairs(spark, monkeypatch):
    rows = [(a, b, 1) for a in range(1, 90) for b in range(a + 1, 90) if (a * 31 + b * 17) % 5 < 2 or b < 12] + [(200, 201, 1)]
    e = spark.createDataFrame(rows, "src long, dst long, weight long")
    near: dict[int, set[int]] = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = {v: sum(len(near[v] & near[u]) for u in near[v]) // 2 for v in near}
    for dense, block in ((0, 20), (0, 64), (1e9, 64)):
        monkeypatch.setattr(graph, "DENSE", dense)
        monkeypatch.setattr(graph, "NODE_BLOCK", block)
        got = {r["node"]: r["triangles"] for r in graph.triangles(e).collect()}
        assert {v: got.get(v, 0) for v in near} == expected


def test_path_strengths_by_node_equal_those_by_path(spark):
    up = [(a, b, (a * 5 + b * 3) % 7 / 10) for a in range(1, 14) for b in range(a + 1, 14) if (a + b) % 3]
    s = spark.createDataFrame([(1,), (4,)], "id long")
    for rows in (up, [*up, (9, 2, 0.5), (5, 5, 0.5)]):
        expected: dict[tuple[int, int], list[float]] = {}
        paths = [((a,), 1.0) for a in (1, 4)]
        for _ in range(3):
            paths = [((*p, b), w * x if len(p) > 1 else x) for p, w in paths for a, b, x in rows if a == p[-1] and (b not in p or len(p) == 1)]
            for p, w in paths:
                expected.setdefault((p[0], p[-1]), []).append(w)
        got = graph.path_strengths(spark.createDataFrame(rows, "src long, dst long, weight double"), s, 3)
        assert {(r["source"], r["end"]): (r["paths"], r["strongest"]) for r in got.collect()} == {k: (len(v), max(v)) for k, v in expected.items()}
        assert "array_contains" in got._jdf.queryExecution().toString() or rows is up


def test_pairs_with_evidence_are_not_moved(spark):
    from tradescope.operators import joins

    own = {e: {str(k) for k in range(12) if (e * 7 + k * k) % (3 + e % 3)} for e in range(60)} | {e: {"1", "2", "3"} for e in range(60, 700)}
    links = spark.createDataFrame([(e, k) for e, ks in own.items() for k in ks] * 2 + [(1, None), (None, "1")], "e long, k string")
    found = joins.evidence_pairs(links, "k", "e", 2)
    plain = {(a, b): (len(own[a] & own[b]), ",".join(sorted(own[a] & own[b]))) for a in own for b in own if a < b and len(own[a] & own[b]) > 2}
    assert {(r["a"], r["b"]): (r["shared"], r["evidence"]) for r in found.collect()} == plain and found.count() == len(plain)
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in tree[:tree.index("Join")]  # nothing is grouped after pairs are made


def test_terms_are_counted_where_texts_lie(spark):
    from tradescope.operators import counts

    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (1, ["c", "a"]), (None, ["x"]), (None, ["y", "x"]), (4, ["é", "z", "é"])]
    docs = spark.createDataFrame(rows, "id long, w array<string>").repartition(3)
    got = {r["id"]: (r["l"], sorted((x["term"], x["n"], x["first"]) for x in r["terms"])) for r in counts.term_lists(docs, "id", F.col("w")).collect()}
    assert got == {1: (5, [("a", 2, 1), ("b", 2, 0), ("c", 1, 0)]), 2: (0, []), 3: (0, []), None: (3, [("x", 2, 0), ("y", 1, 0)]), 4: (3, [("z", 1, 1), ("é", 2, 0)])}
    scored = counts.postings(counts.term_lists(docs, "id", F.col("w")), "id").select("id", "term", F.col("n").alias("score"))
    best = sorted(((r["id"] or 0, r["term"]) for r in counts.best_terms(scored, "id", 2).collect()))
    tree = counts.postings(counts.term_lists(docs.filter("id > 1"), "id", F.col("w")), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in tree  # no row for each word is moved
    assert best == [(0, "x"), (0, "y"), (1, "a"), (1, "b"), (4, "z"), (4, "é")]


def test_cosines_of_texts_move_no_terms(spark, monkeypatch):
    words = ["a", "b", "c", "d", "e", "f", "g", "h"]
    texts = [(i, [words[(i * k + k * k) % (3 + i % 6)] for k in range(1 + i % 9)] + ([f"own{i}"] if i % 4 == 0 else [])) for i in range(60)] + [(60, []), (61, None), (None, ["a", "b"])]
    plain: dict[tuple[int, int], float] = {}
    df: dict[str, int] = {}
    for _, w in texts:
        for x in set(w or []):
            df[x] = df.get(x, 0) + 1
    vectors = {i: {x: w.count(x) * math.log(len(texts) / df[x]) for x in set(w)} for i, w in texts if w and i is not None}
    for a in vectors:
        for b in vectors:
            dot = sum(v * vectors[b].get(x, 0) for x, v in vectors[a].items()) / math.sqrt(sum(v * v for v in vectors[a].values()) * sum(v * v for v in vectors[b].values()))
            if a % 5 == 0 and a != b and dot >= 0.2:
                plain[a, b] = dot
    docs = spark.createDataFrame(texts, "id long, w array<string>").repartition(3)
    for limit, asked in (("ASKED_TERMS", 20), ("KNOWN_TERMS", 2)):  # several blocks of queries; joined by terms
        monkeypatch.setattr(overlaps, limit, asked)
        found = overlaps.cosine_search(docs, F.col("id") % 5 == 0, 0.2)
        got = {(r["query_id"], r["id"]): r["similarity"] for r in found.collect()}
        assert got.keys() == plain.keys() and all(abs(got[p] - plain[p]) < 1e-9 for p in plain)
        if limit == "ASKED_TERMS":
            tree = found._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate" not in tree and "Generate" not in tree


def test_best_items_equal_those_of_all_pairs_and_move_none(spark):
    from tradescope.operators import recommend

    rows = [(u, (u * 7 + k * k) % 12, 1 + (u + 3 * k) % 5) for u in range(40) for k in range(1 + u % 7)] + [(None, 3, 5), (1, None, 4)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id int, rating int").repartition(3)
    content = spark.createDataFrame([(a, b, ((a * 31 + b * 17) % 23 + 1) / 24) for a in range(12) for b in range(60) if a != b], "a int, b int, similarity double")
    similar = spark.createDataFrame([(a, b, ((a * 5 + b * 3) % 7 + 1) / 8) for a in range(12) for b in range(a + 1, 12) if (a + b) % 3], "a int, b int, similarity double")
    order = lambda d: sorted(d.select("user_id", "item_id", "score").collect(), key=repr)
    cb = recommend.content_based(ratings, content, one_way=True)
    found = recommend.best_items(ratings, content, 3)
    assert order(found) == order(recommend.top_items(cb, 3))
    both = recommend.best_items(ratings, content, 3, similar, digits=5)
    assert order(both) == order(recommend.top_items(recommend.hybrid(recommend.collaborative(ratings, similar), cb), 3, 5))
    for df in (found, both):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # ratings, once


def test_texts_are_looked_up_once_for_all_queries(spark):
    q = spark.createDataFrame([(1, ["a", "b", "b"], ["A"]), (1, ["c"], None), (2, ["x"], ["A", "B"]), (3, None, ["B"])], "query_id long, q array<string>, qn array<string>")
    d = spark.createDataFrame([(10, ["a", "b", "a", "z"], ["B", "A", "B"], 5), (11, ["x", "c"], None, None), (12, ["y"], ["A"], 1), (13, None, ["A"], 2)], "id long, w array<string>, n array<string>, days int")
    found = overlaps.all_sharing(q, d, ("qn", "n"))
    got = sorted(((r["query_id"], r["id"], r["days"], r["shared"], r["n_terms"], r["also_shared"], r["q"][0]) for r in found.collect()), key=repr)
    assert got == [(1, 10, 5, 2, 3, 1, "a"), (1, 11, None, 1, 2, 0, "c"), (2, 11, None, 1, 2, 0, "x")]
    tree = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in tree and "arrays_overlap" not in tree


def test_appends_move_keys_of_the_target_and_nothing_derived(spark, tmp_path):
    from tradescope.sinks import tables

    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "a long, b int, pk string")
    for batch in (rows((1, 1, "y"), (1, 1, "x"), (None, 5, "n")), rows((1, 1, "a"), (5, None, "m"), (2, 1, "q"), (None, 5, "c")), rows((2, 1, "q"), (5, None, "m"))):
        kept = tables.append_new(batch, path, ("a", "b"), {"h": F.concat_ws("|", "a", "b")})
    assert sorted(map(tuple, kept.collect()), key=repr) == [(1, 1, "x", "1|1"), (2, 1, "q", "2|1"), (5, None, "m", "5"), (None, 5, "n", "5")]
    one = str(tmp_path / "one")
    for batch in (rows((1, 2, "b"), (1, 1, "c"), (None, 1, "z")), rows((1, 0, "a"), (3, 1, "d"))):
        kept = tables.append_new(batch, one, "a")
    assert sorted(map(tuple, kept.collect())) == [(1, 1, "c"), (3, 1, "d")]


def test_boundary_of_rows_in_some_partitions_only(spark):
    from tradescope.operators import boundary

    rows = spark.range(0, 400, 1, 8).filter("id < 90").selectExpr("id", "cast(id % 9 as double) AS a", "cast(id % 7 as double) AS b")
    got = {r["id"]: r["score"] for r in boundary.one_class_scores(rows, "id", ["a", "b"]).collect()}
    one = {r["id"]: r["score"] for r in boundary.one_class_scores(rows.coalesce(1), "id", ["a", "b"]).collect()}
    assert len(got) == 90 and all(math.isclose(got[i], one[i], abs_tol=1e-9) for i in one)


def test_pairs_with_evidence_are_held_by_one_pair_of_blocks(spark, monkeypatch):
    links = spark.range(300).selectExpr("id AS e", "explode(array('1', '2', '3')) AS k")
    monkeypatch.setattr(joins, "FEW", 8)
    monkeypatch.setattr(joins, "MANY", 16)
    found = joins.evidence_pairs(links, "k", "e", 2)
    assert found.count() == found.distinct().count() == 300 * 299 // 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "NestedLoop" not in join and "block" in join  # a left block's row meets one right block, not all
    assert "Coalesce" in plan[plan.index(join):]  # no code generated for the join runs over a left block's meetings


def test_unlinked_pairs_of_a_dense_graph_are_not_moved(spark, monkeypatch):
    from tradescope.operators import dense

    rows = [(a, b, 1) for a in range(60) for b in range(a + 1, 60) if (a * 31 + b * 17) % 5 < 2]
    e = spark.createDataFrame(rows, "src long, dst long, weight long")
    plain = joins.common_neighbours(e, 2, linked=False).collect()
    monkeypatch.setattr(dense, "LEAST_EDGES", 0)
    monkeypatch.setattr(dense, "LEAST_BLOCK", 20)
    found = joins.common_neighbours(e, 2, linked=False)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain)) and len(plain) > 500
    assert not {(r["a"], r["b"]) for r in plain} & {(a, b) for a, b, _ in rows}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_path_strengths_of_a_dense_graph_are_not_made_from_edges(spark, monkeypatch):
    from tradescope.operators import dense

    rows = [(a, b, (a * 31 + b * 17) % 9 + 1 + 600 * (b - a == 40)) for a in range(70) for b in range(a + 1, 70) if (a * 31 + b * 17) % 5 < 2]
    e = spark.createDataFrame(rows, "src long, dst long, weight long").repartition(3)
    s = spark.createDataFrame([(i,) for i in (0, 1, 7, 7, 30, 31, 69, 500)], "s long")
    for name, value in (("STRIP", 7), ("PACKED", 300), ("BATCH", 16 * 70 * 2)):
        monkeypatch.setattr(dense, name, value)
    for most in (2, 3, 4):
        plain = sorted(map(tuple, graph.path_strengths(e, s, most, 10.0).collect()))
        with monkeypatch.context() as m:
            m.setattr(dense, "LEAST_EDGES", 0)
            found = graph.path_strengths(e, s, most, 10.0)
            bits = sorted(map(tuple, found.collect()))
            twice = sorted(map(tuple, graph.path_strengths(e.union(e.limit(1)), s, most, 10.0).collect()))  # such edges are other paths
        assert [r[:3] for r in bits] == [r[:3] for r in plain] and all(math.isclose(a[3], b[3]) for a, b in zip(bits, plain, strict=True)) and len(bits) > 150
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sum(r[2] for r in twice) >= sum(r[2] for r in plain)


def test_communities_of_light_edges_beside_a_heavy_one(spark, monkeypatch):
    from tradescope.operators import communities, dense, networks

    groups = [range(0, 6), range(10, 17), range(20, 26)]
    e = spark.createDataFrame([(a, b, 1) for g in groups for a in g for b in g if a < b] + [(100, 101, 10_000_000)], "src long, dst long, weight long")
    for least in (dense.LEAST_EDGES, 0):  # by edges, by rows of bits
        monkeypatch.setattr(dense, "LEAST_EDGES", least)
        found, levels = communities.louvain(e)
        assert {r["node"]: r["community"] for r in found.collect()} == {n: g[0] for g in groups for n in g} | {100: 100, 101: 100}
        assert abs(networks.modularity(e, found).first()["modularity"] - levels[-1]) < 1e-9


def test_levels_of_a_dense_graph_are_met_as_bits(spark, monkeypatch):
    from tradescope.operators import communities, dense, networks

    weight = lambda a, b: (a * 31 + b * 17) % 7 + 1 + 8 * (a // 8 == b // 8) + 4 * (a // 24 == b // 24)
    e = spark.createDataFrame([(a, b, weight(a, b)) for a in range(72) for b in range(a + 1, 72) if (a + b) % 3 or a // 8 == b // 8], "src long, dst long, weight long").repartition(3)
    plain = networks.modularity(e, communities.louvain(e)[0]).first()["modularity"]
    for name, value in (("LEAST_EDGES", 0), ("STRIP", 7), ("BATCH", 400)):
        monkeypatch.setattr(dense, name, value)
    monkeypatch.setattr(communities, "_moves", None)  # no level goes along edges
    found, levels = communities.louvain(e)
    quality = networks.modularity(e, found).first()["modularity"]
    assert levels == sorted(levels) and abs(levels[-1] - quality) < 1e-9 and quality > 0.9 * plain > 0.05


def test_eigenvector_of_a_dense_graph_goes_over_rows_of_bits(spark, monkeypatch):
    from tradescope.operators import dense, networks

    rows = [(a * 2, b * 2, 1) for a in range(50) for b in range(a + 1, 50) if (a * 31 + b * 17) % 5 < 2 or b < 9] + [(4, 4, 1), (0, 2, 5), (2, 0, 1)]
    e = spark.createDataFrame(rows, "src int, dst int, weight long").repartition(3)
    plain = {r["node"]: r["score"] for r in networks.eigenvector(e).collect()}
    monkeypatch.setattr(dense, "LEAST_EDGES", 0)
    monkeypatch.setattr(dense, "STRIP", 7)
    monkeypatch.setattr(networks, "undirected", None)  # no edge is turned and moved
    found = networks.eigenvector(e)
    got = {r["node"]: r["score"] for r in found.collect()}
    assert got.keys() == plain.keys() and all(math.isclose(got[n], plain[n], abs_tol=1e-6) for n in plain)
    assert found.schema["node"].dataType.simpleString() == "int"
