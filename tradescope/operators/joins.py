"""Joins. Spark chooses how; the functions say what, and keep both sides small before pairs are made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.registry import Steps

#: Entities in a block of counted pairs: a task holds one number for each pair of two blocks' entities (64 MB at most).
PAIR_BLOCK, LEAST_BLOCK, PAIRS_AT_ONCE = 4096, 256, 1 << 22
#: Entities of one set of keys in a left and in a right block: a task holds the rows of one pair of blocks at once.
FEW, MANY = 64, 1024


def partner_pairs(links: DataFrame, key: str, entity: str, least: int = 1) -> DataFrame:
    """Pairs a < b of entities that share at least ``least`` distinct keys: a, b, shared.

    Each (entity, key) is taken once before pairs are made.
    """
    own = links.select(F.col(key).alias("k"), F.col(entity).alias("a")).distinct()
    pairs = own.join(own.select("k", F.col("a").alias("b")), "k").filter(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def evidence_pairs(links: DataFrame, key: str, entity: str, over: int) -> DataFrame:
    """Pairs a < b of entities that share more than ``over`` distinct keys (strings): a, b, shared, evidence (the keys in order, parted by commas).

    Entities of equal sets of keys are met as one, in blocks of FEW by MANY at most, about, and what two sets share is
    found once a pair of blocks. Pairs are made where they are handed on; none is moved, grouped or counted. Spark's
    generated code holds all rows that come of one input row: so each left block meets one right block at a time, and
    ``coalesce`` parts the code that lists these meetings from the code that makes their pairs.
    """
    sets = links.dropna(subset=[key, entity]).groupBy(F.col(entity).alias("e")).agg(F.sort_array(F.collect_set(key)).alias("keys")).filter(F.size("keys") > over)
    sets = Steps(links.sparkSession).store(sets)
    n = sets.count()
    blocks = lambda size: -(-n // size) or 1
    dealt = lambda size, e, keys: sets.groupBy(F.col("keys").alias(keys), F.pmod(F.xxhash64("e"), F.lit(blocks(size))).alias("block")).agg(
        F.collect_list("e").alias(e))
    parts = 4 * links.sparkSession.sparkContext.defaultParallelism
    left = dealt(FEW, "as", "ka").drop("block").repartition(parts)
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks(MANY) - 1).cast("long")))).coalesce(parts)
    shared = F.array_intersect("ka", "kb")
    met = left.join(checked_broadcast(dealt(MANY, "bs", "kb")), "block").filter(F.size(shared) > over)
    met = met.select("as", "bs", F.size(shared).cast("long").alias("shared"), F.array_join(shared, ",").alias("evidence"))
    pairs = met.select(F.explode("as").alias("a"), "bs", "shared", "evidence").select("a", F.explode("bs").alias("b"), "shared", "evidence")
    return pairs.filter("a < b")


def _block_counter(over: int, kind: pa.DataType):
    """A function for applyInArrow: the pairs of the entities of two blocks that stand together in more than ``over`` rows of (left, right) lists."""

    def run(block_pair: pa.Table) -> pa.Table:
        left, right = (block_pair.column(c).combine_chunks() for c in ("left", "right"))
        (a_ids, a), (b_ids, b) = (np.unique(x.flatten().to_numpy(zero_copy_only=False), return_inverse=True) for x in (left, right))
        n_a, n_b = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right))
        counts = np.zeros(len(a_ids) * len(b_ids), np.int32)
        wide = np.repeat(n_b, n_a)  # each left entity meets so many right ones,
        start = np.repeat(np.cumsum(n_b) - n_b, n_a)  # from this place on
        ends = np.cumsum(wide)
        low = 0
        while low < len(a):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
            w = wide[low:high]
            place = np.arange(int(ends[high - 1] - done)) + np.repeat(start[low:high] - (ends[low:high] - w - done), w)
            np.add.at(counts, np.repeat(a[low:high] * len(b_ids), w) + b[place], np.int32(1))  # of the same type: add.at is ten times slower where it must cast
            low = high
        hit = np.flatnonzero(counts > over)
        x, y = a_ids[hit // max(len(b_ids), 1)], b_ids[hit % max(len(b_ids), 1)]
        once = x < y if block_pair.num_rows and block_pair.column("i")[0] == block_pair.column("j")[0] else np.ones(len(hit), bool)
        return pa.table({"src": pa.array(np.minimum(x, y)[once], kind), "dst": pa.array(np.maximum(x, y)[once], kind),
            "weight": pa.array(counts[hit][once].astype(np.int64))})

    return run


def counted_pairs(links: DataFrame, keys: list[str], entity: str, over: int, entities: int) -> DataFrame:
    """(src, dst, weight): pairs src < dst of entities (integers) that share more than ``over`` distinct keys, and how many.

    The pairs themselves, a row for each shared key, are never moved: entities are dealt to blocks
    by a hash, a key sends its entities of two blocks, as two lists, to where these blocks' pairs
    are counted, and only pairs that are kept leave it. An entity is moved once a key and block,
    and a task counts in a table of PAIR_BLOCK squared numbers at most, about, however many rows
    there are. ``entities`` is about their number. Null keys and entities are in no pair.
    """
    blocks = max(1, -(-entities // min(PAIR_BLOCK, max(LEAST_BLOCK, entities // 16))))
    own = links.select(*keys, F.col(entity).alias("e")).dropna().repartition(*keys).distinct()
    lists = own.groupBy(*keys, F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list("e").alias("es"))  # a key's entities in a block
    parts = lists.groupBy(*keys).agg(F.collect_list(F.struct("b", "es")).alias("parts"))
    meet = lambda i: F.transform(F.filter("parts", lambda j: j["b"] >= i["b"]), lambda j: F.struct(i["b"].alias("i"), j["b"].alias("j"),
        i["es"].alias("left"), j["es"].alias("right")))
    met = parts.select(F.inline(F.flatten(F.transform("parts", meet))))
    kind = links.schema[entity].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.int32()
    shape = f"src {kind.simpleString()}, dst {kind.simpleString()}, weight bigint"
    return met.groupBy("i", "j").applyInArrow(_block_counter(over, arrow), shape)


def checked_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a side of at most ``most`` rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def map_back(df: DataFrame, key: str, *figures: Column) -> DataFrame:
    """Add figures of each row's group: aggregated first, so that a large group is summed where its rows lie. Null is a group."""
    found = df.groupBy(F.col(key).alias("group_of_map_back")).agg(*figures)
    return df.join(checked_broadcast(found), F.col(key).eqNullSafe(F.col("group_of_map_back"))).drop("group_of_map_back")


def merge_ranked(*lists: DataFrame, key: str = "pk") -> DataFrame:
    """Merge ranked lists (key, score, source): the best score and the sorted sources of each key."""
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(key).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def consistency(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Compare two stores by key and digest: key, status (ok, mismatch, missing_left, missing_right)."""
    joined = left.select(F.col(key), F.col(digest).alias("l")).join(right.select(F.col(key), F.col(digest).alias("r")), key, "full_outer")
    status = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when(F.col("l") == F.col("r"), "ok").otherwise("mismatch")
    return joined.select(key, status.alias("status"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: node, other, weight. The edges are read once."""
    there, back = (F.struct(F.col(a).alias("node"), F.col(b).alias("other"), "weight") for a, b in (("src", "dst"), ("dst", "src")))
    return edges.select(F.inline(F.array(there, back)))


def common_neighbours(edges: DataFrame, least: int = 1, linked: bool = True) -> DataFrame:
    """Pairs a < b with their number of shared neighbours; those of a dense graph, whose edges stand once, are counted from rows of bits.

    Without ``linked`` pairs that are edges are left out; in a dense graph their bits tell, and no pair is moved for it.
    """
    from tradescope.operators import dense

    rows = dense.rows_of(edges, Steps(edges.sparkSession))
    if rows is not None:
        return dense.common_neighbours(rows, least, linked)
    both = undirected(edges)
    pairs = both.select("other", F.col("node").alias("a")).join(both.select("other", F.col("node").alias("b")), "other").filter(F.col("a") < F.col("b"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    return pairs if linked else unlinked(pairs, edges)


def unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not edges yet."""
    have = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.join(have, ["a", "b"], "left_anti")


def in_list(df: DataFrame, column: str, keys: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose value is (or is not) among the keys."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_anti" if negate else "left_semi")
