"""Queries of graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradescope.operators import balls
from tradescope.operators import communities as C
from tradescope.operators import dense
from tradescope.operators import graph as G
from tradescope.operators import joins
from tradescope.operators import networks as N
from tradescope.registry import query

_BOTH = "both_ways AS (SELECT src AS node, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"
_DEG = f"{_BOTH}, deg AS (SELECT node, count(*) AS degree FROM both_ways GROUP BY 1)"


def r(c, digits=6):
    return F.round(c, digits)


def rows():
    return F.count(F.lit(1))


@query("grf01_build_graph", f"WITH {_BOTH} SELECT node, count(*) AS links, CAST(sum(weight) AS BIGINT) AS total FROM both_ways GROUP BY 1")
def grf01(t):
    return joins.undirected(t("edges")).groupBy("node").agg(rows().alias("links"), F.sum("weight").alias("total"))


@query("grf02_degree_centrality", f"WITH {_DEG} SELECT node, degree, round(degree * 1.0 / (count(*) OVER () - 1), 6)::DOUBLE AS centrality FROM deg")
def grf02(t):
    return G.degrees(t("edges")).withColumn("centrality", r(F.col("centrality")))


@query(
    "grf04_clustering",
    f"""WITH {_DEG}, tri AS (SELECT a.node, count(*) / 2 AS n FROM both_ways a JOIN both_ways b ON a.node = b.node AND a.other <>
    b.other JOIN both_ways c ON c.node = a.other AND c.other = b.other GROUP BY 1) SELECT node, round(CASE WHEN degree >
    1 THEN coalesce(n, 0) / (degree * (degree - 1) / 2.0) ELSE 0 END, 6)::DOUBLE AS clustering FROM deg LEFT JOIN tri USING
    (node)""",
)
def grf04(t):
    return G.clustering(t("edges")).withColumn("clustering", r(F.col("clustering")))


_REACH = f"WITH RECURSIVE {_BOTH}, reach(node, far) AS (SELECT DISTINCT node, node FROM both_ways UNION SELECT reach.node, other FROM reach JOIN both_ways ON reach.far = both_ways.node)"


@query("grf05_connected_components", f"{_REACH} SELECT node, min(far) AS component FROM reach GROUP BY 1")
def grf05(t):
    return G.components(t("edges"))


@query("grf07_pagerank")
def grf07(t):
    return G.pagerank(t("edges"))


@query("grf14_ego_network", f"WITH {_BOTH} SELECT node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS neighbours FROM both_ways GROUP BY 1")
def grf14(t):
    return dense.ego_networks(t("edges"))


@query("grf15_label_propagation")
def grf15(t):
    return C.propagate_labels(t("edges"))


@query(
    "grf18_graph_metrics",
    f"""{_REACH}, c AS (SELECT node, min(far) AS component FROM reach GROUP BY 1) SELECT (SELECT count(*) FROM c) AS nodes, (SELECT
    count(*) FROM edges) AS edges, round(2.0 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM c) * ((SELECT count(*)
    FROM c) - 1)), 6)::DOUBLE AS density, (SELECT count(DISTINCT component) FROM c) AS components""",
)
def grf18(t):
    c = G.components(t("edges")).agg(rows().alias("nodes"), F.count_distinct("component").alias("components"))
    e = t("edges").agg(rows().alias("edges"))
    return c.join(F.broadcast(e)).select("nodes", "edges", r(2.0 * F.col("edges") / F.nullif(F.col("nodes") * (F.col("nodes") - 1),
        F.lit(0))).alias("density"), "components")


@query(
    "grf20_closure_candidates",
    """SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM
    edges e WHERE e.src = a.src AND e.dst = b.dst)""",
)
def grf20(t):
    return G.closure_candidates(t("edges"))


@query(
    "grf22_triple_patterns",
    """SELECT DISTINCT n_name AS place, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey
    = n_nationkey WHERE s_acctbal < 0""",
)
def grf22(t):
    n, s = t("nation").join(joins.checked_broadcast(t("region")),
        F.col("n_regionkey") == F.col("r_regionkey")), t("supplier").join(joins.checked_broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    triples = n.select(F.col("n_name").alias("s"), F.lit("in").alias("p"), F.col("r_name").alias("o")).union(s.select("s_name",
        F.lit("at"), "n_name")).union(s.filter("s_acctbal < 0").select("s_name", F.lit("is"), F.lit("indebted")))
    return G.match_triples(triples, [("?firm", "is", "indebted"), ("?firm", "at", "?place"), ("?place", "in", "?area")]).select("place", "area").distinct()


@query(
    "grf23_isolated_nodes",
    """WITH h AS (SELECT * FROM edges WHERE weight >= 7) SELECT company_id FROM companies WHERE company_id NOT IN (SELECT src FROM
    h UNION SELECT dst FROM h)""",
)
def grf23(t):
    """Companies without a heavy link."""
    return joins.in_list(t("companies").select("company_id"), "company_id", joins.undirected(t("edges").filter("weight >= 7")).select("node"), negate=True)


@query(
    "grf25_transaction_graph",
    """SELECT user_id, merchant, arg_max(amount, (ts, transaction_id)) AS last_amount, count(*) AS n FROM transactions GROUP BY
    1, 2""",
)
def grf25(t):
    return t("transactions").groupBy("user_id", "merchant").agg(F.max_by("amount", F.struct("ts", "transaction_id")).alias("last_amount"), rows().alias("n"))


#: Walks of so many steps are counted in the SQL of distances; the test graphs are no deeper.
_DEPTH = 6
_WALKS = ", ".join(f"w{k} AS (SELECT w.s, b.other AS t, sum(w.n)::DOUBLE AS n FROM w{k - 1} w JOIN both_ways b ON b.node = w.t GROUP BY 1, 2)" for k in range(2,
    _DEPTH + 1))
_ALL = " UNION ALL ".join(f"SELECT s, t, n, {k} AS d FROM w{k}" for k in range(1, _DEPTH + 1))
_DIST = f"""{_BOTH}, w1 AS (SELECT node AS s, other AS t, 1.0::DOUBLE AS n FROM both_ways), {_WALKS}, walks AS ({_ALL} UNION
    ALL SELECT DISTINCT node, node, 1.0, 0 FROM both_ways),
    dist AS (SELECT s, t, min(d)::INTEGER AS d, arg_min(n, d) AS n FROM walks GROUP BY 1, 2)"""


def asked(t):
    """The query set of path searches: companies whose id is divisible by 100."""
    return t("supplier").filter("s_suppkey % 100 = 0").select(F.col("s_suppkey").alias("company_id"))  # the companies' ids


@query(
    "grf03_betweenness",
    f"""WITH {_DIST}, c AS (SELECT count(DISTINCT s) AS n FROM dist), b AS (SELECT v.t AS node, sum(v.n * x.n / st.n) AS s FROM dist
    v JOIN dist x ON x.s = v.t AND v.d > 0 AND x.d > 0 JOIN dist st ON st.s = v.s AND st.t = x.t AND st.d = v.d + x.d GROUP
    BY 1) SELECT z.s AS node, round(coalesce(max(b.s), 0) / max((c.n - 1) * (c.n - 2)), 6)::DOUBLE AS betweenness FROM (SELECT
    DISTINCT s FROM dist) z LEFT JOIN b ON b.node = z.s, c GROUP BY z.s""",
)
def grf03(t):
    """Paths from as many nodes as bound the error by 0.02; with fewer nodes than that, as in the test tables, from all."""
    return balls.sampled_betweenness(t("edges")).select("node", r(F.col("betweenness")).alias("betweenness"))


_DIRECTED = "dir AS (SELECT CASE WHEN weight % 2 = 1 THEN src ELSE dst END AS a, CASE WHEN weight % 2 = 1 THEN dst ELSE src END AS b FROM edges)"


def directed(t):
    """Edges with a direction: from the smaller to the larger id where the weight is odd, else back."""
    odd = F.col("weight") % 2 == 1
    return t("edges").select(F.when(odd, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(odd,
        F.col("dst")).otherwise(F.col("src")).alias("dst"), "weight")


@query(
    "grf06_strong_components",
    f"""WITH RECURSIVE {_DIRECTED}, reach(a, b) AS (SELECT a, a FROM dir UNION SELECT b, b FROM dir UNION SELECT reach.a, dir.b FROM
    reach JOIN dir ON dir.a = reach.b) SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND
    y.b = x.a GROUP BY 1""",
)
def grf06(t):
    return N.strong_components(directed(t))


_STEPS = ", ".join(f'b{k} AS (SELECT b.s, w.other AS t, min(list_append(b.path, w.other)) AS path FROM b{k - 1} b JOIN both_ways w ON w.node = b.t GROUP BY 1, 2)' for k in range(1, _DEPTH + 1))
_STEPS_ALL = " UNION ALL ".join(f"SELECT s, t, path, {k} AS d FROM b{k}" for k in range(_DEPTH + 1))


@query(
    "grf08_shortest_paths",
    f"""WITH {_BOTH}, b0 AS (SELECT DISTINCT node AS s, node AS t, [node] AS path FROM both_ways WHERE node % 100 = 0), {_STEPS}, b AS ({_STEPS_ALL})
    SELECT s AS source, t AS node, min(d)::INTEGER AS distance, array_to_string(arg_min(path, d), '>') AS path FROM b GROUP BY 1, 2""",
)
def grf08(t):
    found = G.distances(t("edges"), asked(t))
    return found.select("source", "node", "distance", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


_PATHS = 'p("end", path, strength) AS (SELECT dst, [src, dst], CAST(weight AS DOUBLE) / 10 FROM edges WHERE src % 100 = 0 UNION ALL SELECT e.dst, list_append(path, e.dst), strength * e.weight / 10 FROM p JOIN edges e ON e.src = p."end" WHERE NOT list_contains(path, e.dst) AND len(path) < 4)'


def paths_of(t):
    return G.path_strengths(t("edges"), asked(t), 3, unit=10.0)


@query("grf09_grf10_simple_paths", f'WITH RECURSIVE {_PATHS} SELECT path[1] AS source, "end", count(*) AS paths, round(max(strength), 6) AS strongest FROM p GROUP BY 1, 2')
def grf10(t):
    return paths_of(t).select("source", "end", "paths", r(F.col("strongest")).alias("strongest"))


@query("grf09_influence", f'WITH RECURSIVE {_PATHS}, g AS (SELECT path[1] AS source, "end", round(max(strength), 6) AS strength FROM p GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY strength DESC, "end") <= 10')
def grf09(t):
    g = paths_of(t).select("source", "end", r(F.col("strongest")).alias("strength"))
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("strength"), "end"))
    return g.withColumn("k", k).filter("k <= 10").drop("k")


_TRI = "tri AS (SELECT a.node, count(*) / 2 AS n FROM both_ways a JOIN both_ways b ON a.node = b.node AND a.other <> b.other JOIN both_ways c ON c.node = a.other AND c.other = b.other GROUP BY 1)"


@query(
    "grf11_network_risk",
    f"""WITH {_DEG}, {_TRI}, rich AS (SELECT node, avg((balance > 5000)::INT) AS share FROM both_ways JOIN companies ON company_id = other GROUP BY 1)
    SELECT node, round(0.4 * degree / ((SELECT count(*) FROM deg) - 1) + 0.3 * share + 0.3 * CASE WHEN degree > 1 THEN coalesce(n,
    0) / (degree * (degree - 1) / 2.0) ELSE 0 END, 6)::DOUBLE AS risk FROM deg JOIN rich USING (node) LEFT JOIN tri USING
    (node)""",
)
def grf11(t):
    e = t("edges")
    rich = joins.undirected(e).join(t("companies").select(F.col("company_id").alias("other"), "balance"), "other").groupBy("node").agg(F.avg((F.col("balance") > 5000).cast("int")).alias("share"))
    j = G.degrees(e).join(rich, "node").join(G.clustering(e), "node")
    return j.select("node", r(N.network_risk(F.col("centrality"), F.col("share"), F.col("clustering"))).alias("risk"))


@query(
    "grf12_sector_influence",
    """WITH s AS (SELECT nation_id AS sector, src, dst, weight FROM edges JOIN companies ON company_id = src), o AS (SELECT
    sector, src, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY n DESC,
    src) AS k, sum(n) OVER (PARTITION BY sector) AS total, count(*) OVER (PARTITION BY sector) AS size FROM o)
    SELECT sector, string_agg(src, ',' ORDER BY k) FILTER (WHERE k <= 10) AS leaders, round(max(total) * 1.0 / nullif(max(size
    * (size - 1)), 0), 6)::DOUBLE AS density, round(sum((n * 1.0 / total) * (n * 1.0 / total)), 6)::DOUBLE AS concentration
    FROM k GROUP BY 1""",
)
def grf12(t):
    o = t("edges").join(t("companies").select(F.col("company_id").alias("src"), F.col("nation_id").alias("sector")),
        "src").groupBy("sector", "src").agg(rows().alias("n"))
    g = o.groupBy("sector").agg(F.sum("n").alias("total"), rows().alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    top = o.withColumn("k", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("n"), "src"))).filter("k <= 10")
    leaders = top.groupBy("sector").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "src"))),
        lambda x: x["src"].cast("string")), ",").alias("leaders"))
    return g.join(leaders, "sector").select("sector", "leaders", r(F.col("total") / F.nullif(F.col("size") * (F.col("size") - 1),
        F.lit(0))).alias("density"), r(F.col("squares") / (F.col("total") * F.col("total"))).alias("concentration"))


@query(
    "grf13_pair_relationship",
    f"""WITH {_BOTH}, b0 AS (SELECT DISTINCT node AS s, node AS t, [node] AS path FROM both_ways WHERE node % 100 = 0), {_STEPS}, b AS ({_STEPS_ALL}),
    p AS (SELECT s, t, arg_min(path, d) AS path FROM b GROUP BY 1, 2), c AS (SELECT x.node AS s, y.node AS t, count(*) AS common FROM both_ways x JOIN both_ways y ON x.other = y.other
    WHERE x.node % 100 = 0 GROUP BY 1, 2)
    SELECT p.s AS a, p.t AS b, w.weight, concat_ws(',', CASE WHEN w.weight IS NOT NULL THEN 'partner' END, CASE WHEN w.weight >= 6 THEN 'close partner' END, CASE WHEN ca.nation_id = cb.nation_id
    THEN 'same country' END) AS types, coalesce(c.common, 0) AS common, array_to_string(p.path, '>') AS path FROM p LEFT JOIN both_ways w ON w.node = p.s AND w.other = p.t
    LEFT JOIN c ON c.s = p.s AND c.t = p.t JOIN companies ca ON ca.company_id = p.s JOIN companies cb ON cb.company_id = p.t WHERE p.s <> p.t""",
)
def grf13(t):
    """Every company that an asked one reaches: the edge between them, kinds of relation, common partners and the shortest path."""
    e, nations = t("edges"), t("supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_nationkey").alias("nation_id"))
    kinds = [("partner", F.col("weight").isNotNull()), ("close partner", F.col("weight") >= 6), ("same country", F.col("na") == F.col("nb"))]
    pairs = N.pair_relationships(e, asked(t)).join(nations.select(F.col("company_id").alias("a"), F.col("nation_id").alias("na")), "a")
    pairs = pairs.join(nations.select(F.col("company_id").alias("b"), F.col("nation_id").alias("nb")), "b")
    types = F.concat_ws(",", *[F.when(when, name) for name, when in kinds])
    return pairs.select("a", "b", "weight", types.alias("types"), "common", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("grf16_modularity")
def grf16(t):
    """Louvain's communities in figures, with the modularity before the last level; it never falls from level to level."""
    e = t("edges")
    found, levels = C.louvain(e)
    first = levels[0] if levels else None
    return N.modularity(e, found).select("communities", "largest", r(F.col("modularity")).alias("modularity"), F.lit(len(levels)).alias("levels"),
        r(F.lit(first).cast("double")).alias("first_modularity"))


@query("grf16_communities")
def grf16b(t):
    return C.louvain(t("edges"))[0]


@query(
    "grf17_closeness",
    f"""WITH {_DIST}, g AS (SELECT s AS node, count(*) AS k, sum(d) AS far FROM dist WHERE d > 0 GROUP BY 1) SELECT node, round(k
    * 1.0 / far * k / nullif((SELECT count(DISTINCT t) FROM dist) - 1, 0), 6)::DOUBLE AS closeness FROM g ORDER BY 2 DESC,
    1 LIMIT 10""",
)
def grf17(t):
    c = balls.closeness_by_reach(balls.reach_counts(t("edges")))
    return c.withColumn("closeness", r(F.col("closeness"))).orderBy(F.desc("closeness"), "node").limit(10)


@query("grf17_eigenvector")
def grf17b(t):
    return N.eigenvector(t("edges")).withColumn("score", r(F.col("score"), 5)).orderBy(F.desc("score"), "node").limit(10)


@query(
    "grf19_path_lengths",
    f"""WITH {_DIST}, x AS (SELECT d AS distance, count(*) AS pairs FROM dist WHERE d > 0 GROUP BY 1) SELECT distance, pairs, max(distance)
    OVER () AS diameter FROM x""",
)
def grf19(t):
    return balls.path_lengths_by_reach(balls.reach_counts(t("edges")))


_CLASSES = "SELECT DISTINCT p_brand AS s, p_type AS o FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL UNION SELECT DISTINCT p_type, 'goods' FROM part UNION SELECT 'goods', 'thing' UNION SELECT DISTINCT p_name, p_brand FROM part"


@query(
    "grf21_subclass_closure",
    f"""WITH RECURSIVE e AS ({_CLASSES}), c(s, o) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON e.s = c.o) SELECT
    s, o FROM c""",
)
def grf21(t):
    p = t("part")
    pair = lambda s, o: p.select(s.alias("s"), F.lit("subClassOf").alias("p"), o.alias("o"))
    triples = pair(F.col("p_brand"), F.col("p_type")).union(pair(F.col("p_type"), F.lit("goods"))).union(pair(F.col("p_name"),
        F.col("p_brand"))).union(pair(F.lit("goods"), F.lit("thing")))
    return N.subclass_closure(triples)


@query(
    "grf24_entities_relations",
    """WITH s AS (SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON
    r_regionkey = n_regionkey), x AS (SELECT 'company' AS kind, s_name AS name FROM s UNION ALL SELECT 'place', n_name FROM
    s UNION ALL SELECT 'place', r_name FROM s) SELECT 'entity' AS part, kind AS type, name, count(*) AS n FROM x GROUP BY
    2, 3 UNION ALL SELECT 'relation', 'located in', n_name, count(*) FROM s GROUP BY 3 UNION ALL SELECT 'relation', 'active in',
    r_name, count(*) FROM s GROUP BY 3 UNION ALL SELECT 'relation', 'is', s_name, count(*) FROM s GROUP BY 3""",
)
def grf24(t):
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    entities, relations = N.entities_and_relations(s, "s_suppkey", [("s_name", "company", "is"), ("n_name", "place",
        "located in"), ("r_name", "place", "active in")])
    links = relations.groupBy("type", F.col("dst").alias("name")).agg(rows().alias("n")).select(F.lit("relation").alias("part"), "type", "name", "n")
    return entities.select(F.lit("entity").alias("part"), "type", "name", "n").union(links)


@query(
    "grf26_lobbying_report",
    """WITH h AS (SELECT hs_code, count(DISTINCT company_id) AS firms, sum(amount) AS s FROM records GROUP BY 1 HAVING count(DISTINCT
    company_id) > 5), c AS (SELECT hs_code, company_id, sum(amount) AS v FROM records GROUP BY 1, 2), k AS (SELECT hs_code,
    sum((v / t) * (v / t)) AS herfindahl FROM (SELECT *, sum(v) OVER (PARTITION BY hs_code) AS t FROM c) GROUP BY 1)
    SELECT 'cluster' AS pattern, hs_code AS key, round(firms, 4)::DOUBLE AS value FROM h UNION ALL SELECT 'concentration',
    hs_code, round(herfindahl, 6) FROM k WHERE herfindahl > 0.01""",
)
def grf26(t):
    c = t("records").groupBy("hs_code", "company_id").agg(F.sum("amount").alias("v"))
    g = c.groupBy("hs_code").agg(rows().alias("firms"), (F.sum(F.col("v") * F.col("v")) / (F.sum("v") * F.sum("v"))).alias("herfindahl"))
    clusters = g.filter("firms > 5").select(F.lit("cluster").alias("pattern"), F.col("hs_code").alias("key"), F.col("firms").cast("double").alias("value"))
    return clusters.union(g.filter("herfindahl > 0.01").select(F.lit("concentration"), "hs_code", r(F.col("herfindahl"))))
