"""Exact nearest neighbours and neighbours within a radius, by cells around pivots.

Rows are dealt to the nearest of some pivots. By the triangle inequality a query at distance d of
a pivot can have a neighbour within r in the pivot's cell only if d - r is at most the cell's
radius and d + r at least its least distance; inside the cell only rows whose own distance is
within r of d are compared. For the k nearest a query searches its own cell first; the k-th
distance found there is its r for the others. Cells are cut in blocks, so a crowded one is many
tasks; equal vectors are one row with a number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradescope.operators.graph import shared_checkpoints
from tradescope.operators.joins import checked_broadcast

#: Pivots at most, rows that they are picked from, and rows of a cell's block.
PIVOTS, SAMPLE, BLOCK = 128, 4000, 4096
#: Slack for sums in floating point.
SLACK = 1e-9


def pick_pivots(points: np.ndarray, most: int) -> np.ndarray:
    """Points of which each is the farthest from those before; copies are left out."""
    chosen, near = [0], np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(axis=1)))
    return points[chosen]


def _apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1), 0.0))


def _deal(pivots: np.ndarray):
    """A function for mapInPandas: add the nearest pivot and the distance to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.array(frame["v"].tolist(), dtype=float)
                cell = _apart(x, pivots).argmin(axis=1)
                yield frame.assign(cell=cell.astype(np.int32), d=np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)))

    return run


def _visits(pivots: np.ndarray, cells: dict[tuple, tuple], home: bool):
    """A function for mapInPandas: queries in; out, once for each block of each cell that may hold a neighbour within their r.

    ``home`` says whether a query's own cell is left out, as it was searched before.
    """
    by_kind: dict[str, list] = {}
    for (kind, cell), figures in cells.items():
        by_kind.setdefault(kind, []).append((cell, *figures))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            q, r = np.array(frame["v"].tolist(), dtype=float), frame["r"].to_numpy(float)
            own, kinds = frame["cell"].to_numpy(), frame["kind"].to_numpy()
            d = np.sqrt(((q[:, None, :] - pivots[None]) ** 2).sum(axis=2)) if len(q) * pivots.size < 2_000_000 else _apart(q, pivots)
            for kind, known in by_kind.items():
                for cell, low, high, blocks in known:
                    reach = (kinds == kind) & (d[:, cell] - r <= high + SLACK * (1 + high)) & (d[:, cell] + r >= low - SLACK * (1 + low))
                    some = np.flatnonzero(reach & (own != cell) if home else reach)
                    if len(some):
                        for block in range(blocks):
                            yield frame.iloc[some].assign(cell=np.int32(cell), d=d[some, cell], block=np.int32(block))

    return run


def _compare(k: int | None):
    """A function for cogroups of rows and queries of one block: pairs within r, the k nearest of each query; and pairs compared."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "distance", "n", "compared"]
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: [] for c in names})
        rows = rows.sort_values("d")
        x, dx, ids, n = np.array(rows["v"].tolist(), dtype=float), rows["d"].to_numpy(), rows["id"].to_numpy(), rows["n"].to_numpy()
        out, compared = [], 0
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512].sort_values("d")
            q, dq, r, qid = np.array(part["v"].tolist(), dtype=float), part["d"].to_numpy(), part["r"].to_numpy(float), part["id"].to_numpy()
            slack = SLACK * (1 + dx[-1] + dq[-1])
            low, high = np.searchsorted(dx, (dq - r).min() - slack), np.searchsorted(dx, (dq + r).max() + slack, side="right")
            if high <= low:
                continue
            compared += (high - low) * len(part)
            apart = _apart(q, x[low:high])
            ok = (apart <= r[:, None] + slack) & (qid[:, None] != ids[None, low:high])
            apart = np.where(ok, apart, np.inf)
            if k is not None and apart.shape[1] > k:
                least = np.partition(apart, k - 1, axis=1)[:, [k - 1]]
                ok &= apart <= least + slack
            a, b = np.nonzero(ok)
            exact = np.sqrt(((q[a] - x[low + b]) ** 2).sum(axis=1))
            within = exact <= r[a] * (1 + SLACK)
            out.append(pd.DataFrame({"query_id": qid[a], "id": ids[low + b], "distance": exact, "n": n[low + b]})[within])
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in names[:4]})
        found["compared"] = 0
        return pd.concat([found, pd.DataFrame({"query_id": [-1], "id": [-1], "distance": [0.0], "n": [0], "compared": [compared]})])

    return run


def neighbour_pairs(queries: DataFrame, rows: DataFrame, k: int | None = None, radius: float = math.inf, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, n): rows (id, v, kind, n) near queries (id, v, kind), of the same kind, by Euclidean distance.

    All within ``radius``, or the ``k`` nearest of those, and those as far as the k-th; a row with
    the query's id is none. ``v`` are arrays of finite doubles of one length, ids are unique and
    not negative; n is handed on. Pairs compared are counted in rows with query_id -1.
    """
    spark = rows.sparkSession
    shared_checkpoints(spark)
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()  # SAMPLE rows
    shape = "query_id long, id long, distance double, n long, compared long"
    if not sample:
        return spark.createDataFrame([], shape)
    centres = pick_pivots(np.array([r["v"] for r in sample], dtype=float), pivots)
    data = rows.select("id", "v", "kind", "n").mapInPandas(_deal(centres), "id long, v array<double>, kind string, n long, cell int, d double").checkpoint()
    figures = data.groupBy("kind", "cell").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n"))
    cells = {(r["kind"], r["cell"]): (r["low"], r["high"], max(1, math.ceil(r["n"] / block))) for r in figures.collect()}  # kinds x pivots
    blocks = figures.select("kind", "cell", F.ceil(F.col("n") / block).alias("blocks"))
    data = data.join(F.broadcast(blocks), ["kind", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    asked = queries.select("id", "v", "kind").mapInPandas(_deal(centres), "id long, v array<double>, kind string, cell int, d double").withColumn("r", F.lit(float(radius)))
    key, visit = ["kind", "cell", "block"], "id long, v array<double>, kind string, cell int, d double, r double, block int"

    def searched(visiting: DataFrame) -> DataFrame:
        return data.groupBy(*key).cogroup(visiting.groupBy(*key)).applyInPandas(_compare(k), shape)

    if k is None:
        return searched(asked.mapInPandas(_visits(centres, cells, False), visit))
    asked = asked.checkpoint()
    home = asked.join(F.broadcast(blocks), ["kind", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).drop("blocks")
    first = searched(home.select("id", "v", "kind", "cell", "d", "r", "block")).checkpoint()
    near = Window.partitionBy("query_id").orderBy("distance", "id")
    bound = first.filter("query_id >= 0").withColumn("place", F.row_number().over(near)).filter(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("kth"))
    bounded = asked.join(bound, "id", "left").withColumn("r", F.least("r", F.coalesce("kth", "r"))).drop("kth")
    away = searched(bounded.select("id", "v", "kind", "cell", "d", "r").mapInPandas(_visits(centres, cells, True), visit))
    both = first.unionByName(away)
    ranked = both.filter("query_id >= 0").withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy("distance"))).filter(F.col("place") <= k).drop("place")
    return ranked.unionByName(both.filter("query_id < 0"))


def local_outlier_factors(df: DataFrame, row_id: str, columns: Sequence[str], k: int = 20) -> DataFrame:
    """row_id, score: the local outlier factor of every row against its k nearest others.

    Near 1 is as dense as the neighbours, larger is sparser. All rows are references. Equal rows
    are searched once, with their number, and get equal scores; of others at one distance the
    smaller number comes first. Nulls count as 0. With k others or fewer, all of them count; a
    single row scores 1.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + F.lit(0.0) for c in columns])
    rows = df.select(row_id, v.alias("v"))
    distinct = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()).withColumn("kind", F.lit("")).checkpoint()
    pairs = neighbour_pairs(distinct, distinct, k).filter("query_id >= 0").select("query_id", "id", "distance", "n")
    own = distinct.filter("n > 1").select(F.col("id").alias("query_id"), F.col("id"), F.lit(0.0).alias("distance"), (F.col("n") - 1).alias("n"))
    order = Window.partitionBy("query_id").orderBy("distance", F.col("query_id") != F.col("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    near = pairs.unionByName(own).withColumn("w", F.least(F.col("n"), F.lit(k) - before)).filter("w > 0").select("query_id", "id", "distance", "w").checkpoint()
    far = near.groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("far"))
    reach = near.join(far, "id").groupBy("query_id").agg((F.sum("w") / (F.sum(F.greatest("far", "distance") * F.col("w")) + 1e-10 * F.sum("w"))).alias("density")).checkpoint()
    around = near.join(reach.select(F.col("query_id").alias("id"), "density"), "id").groupBy("query_id").agg((F.sum(F.col("density") * F.col("w")) / F.sum("w")).alias("beside"))
    scored = around.join(reach, "query_id").select(F.col("query_id").alias("id"), (F.col("beside") / F.col("density")).alias("score"))
    by_vector = distinct.join(scored, "id", "left").select("v", F.coalesce("score", F.lit(1.0)).alias("score"))
    return rows.join(checked_broadcast(by_vector), "v").select(row_id, "score")
