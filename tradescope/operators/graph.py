"""Graphs as two tables: nodes (id) and edges (src, dst, weight). Loops cut their lineage by checkpoint()."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradescope.operators import dense
from tradescope.operators.joins import checked_broadcast, undirected
from tradescope.registry import Steps, shared_dir


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; a local one only where there is none and the master is local."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, centrality: degree over the number of other nodes."""
    d = undirected(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return d.join(F.broadcast(d.agg(F.count(F.lit(1)).alias("n")))).select("node", "degree", (F.col("degree") / F.nullif(F.col("n") - 1,
        F.lit(0))).alias("centrality"))


#: Nodes in a block of a dense graph, and open paths a link from which triangles are counted by blocks.
NODE_BLOCK, LEAST_BLOCK, DENSE = 4096, 256, 64


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles of a graph whose edges (src, dst) stand once; nodes without one may be left out.

    Each edge points to the end of higher degree, so that no hub is expanded, and pairs of edges
    out of a node are looked up among the edges. In a dense graph these pairs are far more than
    the edges: from DENSE to an edge on they are counted by blocks of nodes and never made.
    """
    d = degrees(edges).select("node", "degree")
    rank = lambda c: F.struct(F.col(f"d{c}"), F.col(c))
    shared_checkpoints(edges.sparkSession)
    steps = Steps(edges.sparkSession)
    d = steps.store(d)
    e = edges.select("src", "dst").join(d.select(F.col("node").alias("src"), F.col("degree").alias("dsrc")),
        "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("ddst")), "dst")
    up = e.select(F.when(rank("src") < rank("dst"), F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(rank("src") < rank("dst"),
        F.col("dst")).otherwise(F.col("src")).alias("b"))
    out = up.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    paths = out.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("r")).first()["r"] or 0.0
    if paths > DENSE:
        found = _dense_triangles(edges, d, steps)
    else:
        wedge = up.join(up.select("a", F.col("b").alias("c")), "a").filter("b <> c")
        closed = wedge.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
        found = closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    found = found.checkpoint()
    steps.clear()
    return found


def _dense_triangles(edges: DataFrame, nodes: DataFrame, steps: Steps) -> DataFrame:
    """node, triangles, by products of the matrices of blocks of nodes: an edge is moved once as a cell, a matrix as bits once a block."""
    n = nodes.count()
    blocks = -(-n // min(NODE_BLOCK, max(LEAST_BLOCK, n // 6)))
    dealt = nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("b"))
    at = steps.store(dealt.withColumn("x", F.row_number().over(Window.partitionBy("b").orderBy("node")) - 1))  # a block's nodes
    sizes = {r["b"]: r["n"] for r in at.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a block
    place = lambda c: at.select(F.col("node").alias(c), F.col("b").alias(f"b_{c}"), F.col("x").alias(f"x_{c}"))
    cells = edges.filter("src <> dst").select("src", "dst").join(place("src"), "src").join(place("dst"), "dst")
    turn = F.col("b_src") > F.col("b_dst")
    cells = cells.select(*[F.when(turn, F.col(f"{c}_dst")).otherwise(F.col(f"{c}_src")).alias(f"{c}i") for c in "bx"],
        *[F.when(turn, F.col(f"{c}_src")).otherwise(F.col(f"{c}_dst")).alias(f"{c}j") for c in "bx"])
    packed = cells.select("bi", "bj", F.when(F.col("bi") != F.col("bj"), F.col("xi") * F.lit(NODE_BLOCK * 4) + F.col("xj")).otherwise(
        F.least("xi", "xj") * F.lit(NODE_BLOCK * 4) + F.greatest("xi", "xj")).cast("int").alias("cell"))
    matrices = steps.store(packed.groupBy("bi", "bj").applyInArrow(_as_bits(sizes), "bi int, bj int, bits binary"))
    third = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k")
    triple = F.array_sort(F.array("bi", "bj", "k"))
    parts = matrices.select("bi", "bj", "bits", third).select("bi", "bj", "bits", triple.alias("t"))
    parts = parts.select("bi", "bj", "bits", *[F.col("t")[i].alias(c) for i, c in enumerate(("i", "j", "k"))])
    counts = parts.groupBy("i", "j", "k").applyInArrow(_closed(sizes), "b int, x int, n bigint")
    return counts.groupBy("b", "x").agg(F.sum("n").alias("triangles")).join(at, ["b", "x"]).select("node", "triangles")


def _as_bits(sizes: dict[int, int]):
    """A function for applyInArrow: the cells of two blocks as a matrix of bits."""
    width = NODE_BLOCK * 4

    def run(cells: pa.Table) -> pa.Table:
        i, j = cells.column("bi")[0].as_py(), cells.column("bj")[0].as_py()
        cell = cells.column("cell").to_numpy()
        m = np.zeros((sizes[i], sizes[j]), np.uint8)
        m[cell // width, cell % width] = 1
        if i == j:
            m |= m.T
        return pa.table({"bi": pa.array([i], pa.int32()), "bj": pa.array([j], pa.int32()), "bits": pa.array([np.packbits(m).tobytes()], pa.binary())})

    return run


def _closed(sizes: dict[int, int]):
    """A function for applyInArrow: triangles with a corner in each of three blocks i <= j <= k, by corner."""

    def run(found: pa.Table) -> pa.Table:
        m = {}
        for r in found.to_pylist():
            shape = sizes[r["bi"]], sizes[r["bj"]]
            m[r["bi"], r["bj"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(np.float32)
            i, j, k = r["i"], r["j"], r["k"]
        of = lambda a, b: m.get((a, b), m[b, a].T if (b, a) in m else None)
        total = {b: np.zeros(sizes[b]) for b in (i, j, k)}
        if i == k:
            a = of(i, i)
            total[i] += (a * (a @ a)).sum(axis=1, dtype=float) / 2
        elif i == j or j == k:
            one, two = (k, i) if i == j else (i, j)
            a, inner = of(one, two), of(two, two)
            if a is not None and inner is not None:
                p = a * (a @ inner)
                total[one] += p.sum(axis=1, dtype=float) / 2
                total[two] += p.sum(axis=0, dtype=float)
        else:
            ij, ik, jk = of(i, j), of(i, k), of(j, k)
            if ij is not None and ik is not None and jk is not None:
                p = ij * (ik @ jk.T)
                total[i] += p.sum(axis=1, dtype=float)
                total[j] += p.sum(axis=0, dtype=float)
                total[k] += (ik * (ij @ jk)).sum(axis=0, dtype=float)
        b = np.concatenate([np.full(len(t), c) for c, t in total.items()])
        x = np.concatenate([np.arange(len(t)) for t in total.values()])
        n = np.rint(np.concatenate(list(total.values()))).astype(np.int64)
        hit = n > 0
        return pa.table({"b": pa.array(b[hit], pa.int32()), "x": pa.array(x[hit], pa.int32()), "n": pa.array(n[hit], pa.int64())})

    return run


def clustering(edges: DataFrame) -> DataFrame:
    """node, clustering: triangles over possible triangles (0 below degree 2)."""
    d = degrees(edges).select("node", "degree").join(triangles(edges), "node", "left").fillna({"triangles": 0})
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return d.select("node", F.when(possible > 0, F.col("triangles") / possible).otherwise(0.0).alias("clustering"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached. Labels jump to their label's label each round.

    Edges are stored once and not moved where the labels can be broadcast.
    """
    spark = edges.sparkSession
    shared_checkpoints(spark)
    steps = Steps(spark)
    both = undirected(steps.store(edges.filter("src <> dst").select("src", "dst", F.lit(1).alias("weight"))))
    labels = steps.store(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        met = labels.join(seen, "node").select("node", "component", F.least("component", "c").alias("m"))
        after = steps.store(met.join(labels.select(F.col("node").alias("m"), F.col("component").alias("f")), "m").select("node",
            "component", F.least("m", "f").alias("next")))
        moved = after.filter("next <> component").limit(1).count()
        labels = after.select("node", F.col("next").alias("component"))
        if not moved:
            result = labels.checkpoint()
            steps.clear()
            return result


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """node, rank of a directed graph; the rank of nodes without an edge out is shared by all.

    It ends when the ranks of a round differ from the last by ``tolerance`` in sum; each round
    brings that down to ``damping`` of it at least.
    """
    spark = edges.sparkSession
    shared_checkpoints(spark)
    steps = Steps(spark)
    out = steps.store(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")))  # of known size, so that the edges are not moved for it
    links = steps.store(edges.select("src", "dst").join(out, "src"))
    nodes = steps.store(links.select(F.col("src").alias("node"), F.lit(False).alias("loose")).union(links.select("dst", F.lit(True))).groupBy("node").agg(F.min("loose").alias("loose")))
    n = nodes.count()
    ranks = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    while n:
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        loose = nodes.filter("loose").join(ranks, "node").agg(F.sum("rank")).first()[0] or 0.0
        after = nodes.join(ranks, "node").join(given, "node", "left").select("node", "rank",
            ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("next"))
        after = steps.store(after)
        ranks = after.select("node", F.col("next").alias("rank"))
        if after.agg(F.sum(F.abs(F.col("next") - F.col("rank")))).first()[0] <= tolerance:
            break
    result = ranks.checkpoint()
    steps.clear()
    return result


def distances(edges: DataFrame, sources: int | DataFrame) -> DataFrame:
    """source, node, distance, path from each source (one, or a column of them), breadth first to the end; of equal paths the least is kept.

    In a dense graph a node looks its first path up in its row of bits, and no path goes along an edge.
    """
    spark = edges.sparkSession
    rows = None if isinstance(sources, int) else dense.rows_of(edges, Steps(spark))
    if rows is not None:
        return dense.first_paths(rows, sources)
    shared_checkpoints(spark)
    both = undirected(edges).select("node", F.col("other").alias("next")).distinct().checkpoint()
    start = both.filter(F.col("node") == sources) if isinstance(sources, int) else both.join(sources.select(F.col(sources.columns[0]).alias("node")), "node", "left_semi")
    found = start.select("node").distinct().select(F.col("node").alias("source"), "node", F.lit(0).alias("distance"), F.array("node").alias("path")).checkpoint()
    frontier, step = found, 0
    while True:
        step += 1
        near = frontier.join(both, "node").groupBy("source", F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        frontier = near.join(found.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(step).alias("distance"), "path").checkpoint()
        if frontier.isEmpty():
            return found
        found = found.union(frontier).checkpoint()


def simple_paths(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """end, path, strength of all simple directed paths of up to ``most`` edges from ``sources`` (one column); strength is the product of weights."""
    step = edges.select(F.col("src").alias("end"), F.col("dst").alias("next"), F.col("weight").cast("double").alias("w"))
    paths = edges.join(sources.select(F.col(sources.columns[0]).alias("src")).distinct(), "src",
        "left_semi").select(F.col("dst").alias("end"), F.array("src", "dst").alias("path"), F.col("weight").cast("double").alias("strength"))
    found = paths
    for _ in range(most - 1):
        paths = paths.join(step, "end").filter(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("end"),
            F.concat("path", F.array("next")).alias("path"), (F.col("strength") * F.col("w")).alias("strength"))
        found = found.union(paths)
    return found


def path_strengths(edges: DataFrame, sources: DataFrame, most: int, unit: float = 1.0) -> DataFrame:
    """source, end, paths, strongest: how many simple directed paths of up to ``most`` edges there are, and the greatest strength, the product of weights over ``unit``.

    Where every edge leads to a larger id a path meets no node twice: then counts and greatest
    strengths are carried on by node, a row for each source and node, and no path is made. In a dense
    graph of whole weights, whose edges stand once, they are found from rows of bits.
    """
    whole = edges.schema["weight"].dataType.simpleString() in ("int", "bigint") and most > 1
    if whole and edges.filter("src >= dst OR weight IS NULL OR weight < 1 OR weight > 65535").isEmpty():
        rows = dense.rows_of(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "weight"), Steps(edges.sparkSession), weighted=True, both=False)
        if rows is not None and rows.table.agg(F.sum("degree")).first()[0] == edges.count():
            return dense.path_strengths(rows, sources, most, unit)
    edges = edges.withColumn("weight", F.col("weight") / unit)
    if not edges.filter("src >= dst OR weight IS NULL OR weight < 0").isEmpty():
        found = simple_paths(edges, sources, most)
        return found.groupBy(F.col("path")[0].alias("source"), "end").agg(F.count(F.lit(1)).alias("paths"), F.max("strength").alias("strongest"))
    steps = Steps(edges.sparkSession)
    step = edges.select(F.col("src").alias("end"), F.col("dst").alias("next"), F.col("weight").cast("double").alias("w"))
    first = edges.join(checked_broadcast(sources.select(F.col(sources.columns[0]).alias("src")).distinct()), "src", "left_semi")
    level = first.select(F.col("src").alias("source"), F.col("dst").alias("end"), F.lit(1).cast("long").alias("paths"), F.col("weight").cast("double").alias("strongest"))
    found = None
    for k in range(most):
        if k:
            level = level.join(step, "end").select("source", F.col("next").alias("end"), "paths", (F.col("strongest") * F.col("w")).alias("strongest"))
        level = steps.store(level.groupBy("source", "end").agg(F.sum("paths").alias("paths"), F.max("strongest").alias("strongest")))
        found = level if found is None else found.union(level)
    return found.groupBy("source", "end").agg(F.sum("paths").alias("paths"), F.max("strongest").alias("strongest"))


def closure_candidates(edges: DataFrame) -> DataFrame:
    """Directed pairs two steps apart that are no edge yet: src, dst. Paths of a dense graph are met as bits and not made."""
    rows = dense.rows_of(edges, Steps(edges.sparkSession), both=False)
    if rows is not None:
        return dense.closure_candidates(rows)
    two = edges.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"),
        "mid").filter("src <> dst").select("src", "dst").distinct()
    return two.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def match_triples(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of variables (``?x``) that meet all (s, p, o) patterns; a self-join per pattern."""
    found = None
    for pattern in patterns:
        one, names = triples, {}
        for column, value in zip(("s", "p", "o"), pattern, strict=True):
            if not value.startswith("?"):
                one = one.filter(F.col(column) == value)
            elif value in names:
                one = one.filter(F.col(column) == F.col(names[value]))
            else:
                names[value] = column
        one = one.select(*[F.col(c).alias(n[1:]) for n, c in names.items()]).distinct()
        shared = [] if found is None else [c for c in one.columns if c in found.columns]
        found = one if found is None else found.join(one, shared)
    return found
