"""Exact top-k search by inner product with two cover trees.

Both sides are indexed together. Level one of both trees is spread over Spark: rows and queries
are dealt to the nearest of some pivots, which a greedy net over a sample keeps apart. A query
first searches its own pivot's rows; the k-th best scores found there are the queries' first
bounds. Pairs of (group of queries, group of rows) are then pruned by the covering radii of both
against the group's worst k-th score, then query by query, and only what is left is moved: rows
go to the blocks of queries that visit them. Inside a task both sides are indexed by cover trees
whose pairs of nodes are pruned in the same way. Tasks hold bounded blocks of rows and of
queries, so that a common vector or a crowded pivot is spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, parts_for

#: Pivots, the sample that they are picked from, and rows and queries in one task's block.
PIVOTS, SAMPLE, BLOCK_ROWS, BLOCK_QUERIES = 64, 2048, 4096, 4096
#: Points of a node that is not split, children of a node for each step of scale, and points that make a tight node.
LEAF, FAN, TIGHT = 4, 32, 3
MISSING = np.iinfo(np.int64).min
#: Up to so many (pivot, block of queries) pairs are broadcast.
BROADCAST_VISITS = 200_000


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def scaled(vector: Column) -> Column:
    """floor(256 x) of each component; an error where that passes 64 bits."""
    big = F.raise_error(F.lit("a component times 256 passes 64 bits")).cast("long")
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * 256.0 < float(1 << 63), F.floor(x.cast("double") * 256.0)).otherwise(big))


def matrix(vectors, width: int) -> np.ndarray:
    """Rows as whole numbers, shorter ones filled with 0."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.array(list(vectors), dtype=np.int64)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class CoverTree:
    """A cover tree over points, built a level at a time.

    A node covers its points within ``radius`` of its centre. Its children's centres are points of
    the node, its own centre among them (nesting), each the farthest from those before, until all
    points are within half of the radius (covering); they lie further than that from each other
    (separation). Where FAN centres do not reach half of the radius, the distance that they do
    reach is an intermediate scale, and the children are split further. A node of at most LEAF
    points is a leaf, as is one whose points are in no tight nodes at any scale below (TIGHT
    points or more within half of its radius, for half of its points): there is no structure to use.
    """

    def __init__(self, points: np.ndarray, rows: np.ndarray | None = None):
        self.rows = np.arange(len(points)) if rows is None else rows
        self.points = points
        own = points[self.rows]
        self.centre = own[0]
        distance = lambda i: np.sqrt(((own - own[i]) ** 2).sum(axis=1))
        near = distance(0)
        self.radius = float(near.max()) * (1 + 1e-9)
        self.norm = float(np.sqrt((self.centre**2).sum()))
        self.longest = float(np.sqrt((own**2).sum(axis=1).max())) * (1 + 1e-9)
        self.children: list[CoverTree] = []
        self.leaves = [(self.radius, len(own))]
        if len(own) > LEAF and self.radius > 0:
            owner, centres = np.zeros(len(own), dtype=np.int64), [0]
            while len(centres) < FAN and near.max() > self.radius / 2:
                centres.append(int(near.argmax()))
                other = distance(centres[-1])
                owner[other < near] = len(centres) - 1
                near = np.minimum(near, other)
            order = np.argsort(owner, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)
            children = [CoverTree(points, self.rows[np.append(c, part[part != c])]) for c, part in zip(centres, parts, strict=True)]
            leaves = [leaf for child in children for leaf in child.leaves]
            if sum(n for r, n in leaves if n >= TIGHT and r <= self.radius / 2) * 2 >= len(own):
                self.children, self.leaves = children, leaves
                self.centres = np.array([c.centre for c in children])
                self.radii, self.norms, self.lengths = (np.array([getattr(c, k) for c in children]) for k in ("radius", "norm", "longest"))


class TopK:
    """The k best (score, id) of each query: larger scores, then smaller ids."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, exact: bool):
        kind = np.int64 if exact else np.float64  # products below 2^53 are as exact in floats, which are faster
        self.q, self.qid, self.x, self.id, self.k = queries.astype(kind), query_ids, rows.astype(kind), ids, k
        self.score = np.full((len(queries), k), MISSING, dtype=np.int64)
        self.best = np.full((len(queries), k), MISSING, dtype=np.int64)
        self.floor = floor
        self.compared = self.bounded = 0  # pairs of points, and of a node with another's child

    def worst(self, rows: np.ndarray) -> float:
        """The least k-th score of a group: a node that stays below it holds nothing for the group."""
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def hopeful(self, q: CoverTree, x: CoverTree) -> np.ndarray:
        """Which queries of a leaf may find something in a node of rows, each by its own bound."""
        own = q.points[q.rows]
        most = own @ x.centre + np.sqrt((own**2).sum(axis=1)) * x.radius
        return most + np.abs(most) * 1e-9 + 1e-6 >= np.maximum(self.score[q.rows, -1], self.floor[q.rows])

    def compare(self, q: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(q), 256):
            for start in range(0, len(x), 4096):
                self._compare(q[at : at + 256], x[start : start + 4096])

    def _compare(self, q: np.ndarray, x: np.ndarray) -> None:
        self.compared += len(q) * len(x)
        score = (self.q[q] @ self.x[x].T).astype(np.int64)
        own = self.qid[q][:, None] == self.id[x][None, :]
        if own.any():
            score[own] = MISSING
        least = np.maximum(self.score[q, -1], self.floor[q])
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
        row, column = np.nonzero((score >= least[:, None]) & (score > MISSING))
        if not len(row):
            return
        touched, new = np.unique(row, return_inverse=True)
        of = np.concatenate((np.repeat(np.arange(len(touched)), self.k), new))
        scores = np.concatenate((self.score[q[touched]].ravel(), score[row, column]))
        ids = np.concatenate((self.best[q[touched]].ravel(), self.id[x[column]]))
        order = np.lexsort((ids, np.invert(scores), of))
        of, scores, ids = of[order], scores[order], ids[order]
        rank = np.arange(len(of)) - np.searchsorted(of, np.arange(len(touched)))[of]
        keep = rank < self.k
        self.score[q[touched]], self.best[q[touched]] = scores[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)


def bounds(node: CoverTree, children: CoverTree) -> np.ndarray:
    """For each child of a node: the largest inner product that a point of it and a point of ``node`` can have."""
    value = children.centres @ node.centre + node.norm * children.radii + children.norms * node.radius + node.radius * children.radii
    value = np.minimum(value, node.longest * children.lengths)
    return value + np.abs(value) * 1e-9 + 1e-6


def dual_search(q: CoverTree, x: CoverTree, found: TopK) -> None:
    """Visit pairs of nodes, the most promising first, and skip those that cannot matter."""
    stack = [(math.inf, q, x)]
    while stack:
        most, a, b = stack.pop()
        if most < found.worst(a.rows):
            continue
        if not a.children and not b.children:
            found.compare(a.rows[found.hopeful(a, b)], b.rows)
            continue
        split = a if a.children and (not b.children or a.radius > b.radius) else b
        most = bounds(b if split is a else a, split)
        found.bounded += len(most)
        for i in np.argsort(most, kind="stable"):
            stack.append((float(most[i]), split.children[i], b) if split is a else (float(most[i]), a, split.children[i]))


def net(points: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the points, each the farthest from those before; copies are left out."""
    chosen = [0]
    near = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(axis=1)))
    return points[chosen]


def nearest(pivots: np.ndarray, names: list[str]):
    """A function for mapInArrow: add the nearest pivot and the distance to it."""
    squares = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), pivots.shape[1]).astype(float)
            apart = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + squares, 0.0)
            node = apart.argmin(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            distance = np.sqrt(((x - pivots[node]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(node, pa.int32()), pa.array(distance,
                pa.float64())], names=[*names, "node", "distance"])

    return run


def search_block(k: int, width: int, exact: bool):
    """A function for cogroups: rows and queries of one block in, partial results and the pairs compared out."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)}
        if len(rows) and len(queries):
            x, q = matrix(rows["v"], width), matrix(queries["v"], width)
            qid = queries["vec_id"].to_numpy(np.int64)
            found = TopK(q, qid, x, rows["vec_id"].to_numpy(np.int64), k, queries["floor"].to_numpy(np.int64), exact)
            dual_search(CoverTree(q.astype(float)), CoverTree(x.astype(float)), found)
            keep = found.score > MISSING
            out = {"query_id": np.repeat(qid, keep.sum(axis=1)), "vec_id": found.best[keep], "score": found.score[keep]}
        return pd.DataFrame(out)

    return run


def visits(pairs: dict[int, list[int]], radius: dict[int, float], pivots: np.ndarray):
    """A function for mapInPandas: queries in; out, once for each pivot whose rows may hold something for them.

    ``pairs`` names the pivots that are left to each group of queries, ``radius`` those of the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in batches:
            q = matrix(block["v"], pivots.shape[1]).astype(float)
            length = np.sqrt((q**2).sum(axis=1))
            floor = block["floor"].to_numpy(float)
            for group, rows in block.groupby("node").indices.items():
                for node in pairs.get(int(group), ()):
                    most = q[rows] @ pivots[node] + length[rows] * radius[node]
                    chosen = rows[most + np.abs(most) * 1e-9 + 1e-6 >= floor[rows]]
                    if len(chosen):
                        yield block.iloc[chosen][["vec_id", "v", "floor", "part"]].assign(node=np.int32(node))

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k rows with the largest inner product for each query: query_id, rank, vec_id, score.

    ``rows`` and ``queries`` have vec_id and v, an array of longs. A row with the query's own id
    is no candidate. Equal scores go to the smaller id; a query with fewer candidates gets all.

    Rows without an id or a vector are left out; callers leave out vectors with unusable
    components. Repeated rows count once; of different vectors under one id the smallest counts,
    compared component by component. Shorter vectors are filled with zeros. Scores are exact: in
    floats while the largest lengths allow products below 2^53, else in 64-bit integers; an
    OverflowError says where a score could pass 64 bits. Empty tables give no rows; further
    columns are ignored. Pivots come from a sample of at most SAMPLE rows; every row is indexed.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    clean = lambda d: d.select(F.col("vec_id").cast("long"), F.col("v").cast("array<bigint>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows, queries = clean(rows), clean(queries)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows
    result = "query_id long, rank int, vec_id long, score long"
    if not sample:
        return spark.createDataFrame([], result)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    width, longest = rows.agg(F.max(F.size("v")), F.max(length)).first()
    longest *= queries.agg(F.max(length)).first()[0] or 0.0
    if longest >= 2.0**63:
        raise OverflowError("scores can pass 64 bits")
    exact, width = longest >= 2.0**53, max(1, width)
    centres = net(matrix([r["v"] for r in sample], width).astype(float), pivots)
    deal = nearest(centres, ["vec_id", "v"])
    shape = "vec_id long, v array<bigint>, node int, distance double"
    data = rows.mapInArrow(deal, shape).checkpoint()
    counted = data.groupBy("node").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row per pivot
    radius = {r["node"]: r["radius"] * (1 + 1e-9) for r in counted}
    blocks = F.element_at(F.create_map(*[F.lit(v) for r in counted for v in (r["node"], parts_for(r["n"], block_rows))]), F.col("node"))
    asked = queries.mapInArrow(deal, shape).checkpoint()
    parts = parts_for(asked.count(), block_queries)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("floor", F.lit(int(MISSING)))
    key = ["node", "block", "part"]

    def partial(visiting: DataFrame) -> DataFrame:
        """Search what is visited: rows go to the parts of queries that visit their pivot."""
        wanted = visiting.select("node", "part").distinct().checkpoint()
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_VISITS else wanted
        left = data.join(wanted, "node").select("vec_id", "v", "node", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), "part")
        right = visiting.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search_block(k, width, exact), "query_id long, vec_id long, score long")

    at_home = partial(asked.filter(F.col("node").isin([*radius]))).checkpoint()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    floors = at_home.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"),
        F.col("score").alias("floor"))
    asked = asked.drop("floor").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(int(MISSING)))).checkpoint()
    groups = asked.groupBy("node").agg(F.max("distance").alias("radius"), F.min("floor").alias("worst")).collect()  # a row per pivot
    pairs = {g["node"]: [n for n in radius if n != g["node"] and reach(centres, g["node"], g["radius"], n, radius[n]) >= g["worst"]] for g in groups}
    away = partial(asked.mapInPandas(visits(pairs, radius, centres), "vec_id long, v array<bigint>, floor long, part int, node int"))
    return at_home.unionByName(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reach(pivots: np.ndarray, group: int, group_radius: float, node: int, radius: float) -> float:
    """The largest inner product between queries around one pivot and rows around another."""
    a, b = pivots[group], pivots[node]
    value = float(a @ b) + float(np.sqrt(a @ a)) * radius + (float(np.sqrt(b @ b)) + radius) * group_radius
    return value + abs(value) * 1e-9 + 1e-6
