"""A Merkle manifest of a dataset, and proofs of its leaves by a recursive query.

Every row is a leaf; the leaves of a group, in order, form a tree of ARITY children a node, and
the subroots form a tree in turn. The built levels are stored as parent-linked node rows: a
node's place, its parent's and the digests beside it. A recursive common table expression then
climbs from the leaves to the root, appending the siblings it passes and folding each leaf's own,
possibly tampered, digest with them.

Leaves of one run meet the same siblings from the run's node on, so a row of the climb is such a
run: one list of siblings and a folded digest for every leaf of it. The upper nodes, which all
leaves pass, are stored once for each block of BLOCK runs, so that no join key has more rows than
a block; digests are kept as 32 bytes and written in hex where they are hashed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Children of a node, and runs of leaves for which an upper node is stored once.
ARITY, BLOCK = 8, 512
#: The fields of a leaf in order (fixed by the format of the manifest).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows up to this number (a row per partition and group, or per group) are broadcast.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, run, block, height, 1 AS level, run AS pos, folded, X'' AS proof FROM {runs}
  UNION ALL
  SELECT c.tree, c.run, c.block, c.height, c.level + 1, n.parent,
         transform(c.folded, f -> unhex(sha2(concat(lower(hex(n.before)), lower(hex(f)), lower(hex(n.after))), 256))),
         concat(c.proof, n.before, n.after)
  FROM climb c JOIN {nodes} n ON n.tree = c.tree AND n.block = c.block AND n.level = c.level AND n.pos = c.pos)
SELECT tree, run, folded, proof FROM climb WHERE level = height"""


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def written(digests: Column) -> Column:
    """Bytes in lower-case hex."""
    return F.lower(F.hex(digests))


def of_children(digests: Column) -> Column:
    """The digest of a node, from an array of its children's."""
    return digest(F.array_join(F.transform(digests, written), ""))


def joined(digests: Column) -> Column:
    """An array of digests as one run of bytes."""
    return F.aggregate(digests, F.lit(b""), lambda t, d: F.concat(t, d))


def sized(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table marked for broadcasting if it has at most ``most`` rows; else Spark joins as it sees fit."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def leaf_digests(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, tree, leaf and own (the leaf's digest after tampering) of every row.

    ``tampered`` says which rows are tampered with: the letters A-Z of their text become small.
    The tree is named so that the null language comes first and others follow by their bytes.
    """
    head = [field(F.col(c)) for c in FIELDS[:-1]]
    leaf = digest(F.concat(*head, field(F.col("text"))))
    changed = F.coalesce(tampered, F.lit(False)) & F.col("text").isNotNull()
    rows = docs.select("doc_id", "lang", F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree"), leaf.alias("leaf"),
        F.when(changed, digest(F.concat(*head, field(F.translate("text", UPPER, LOWER))))).alias("own"))
    return rows.withColumn("own", F.coalesce("own", "leaf"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add pos, the place of a row in its tree from 0, and n, the tree's number of rows.

    Rows are range-partitioned by tree, ``order`` and a unique number, so that neither a large
    tree nor equal rows meet in one task; places follow from each partition's count before.
    ``rows`` must be a stored table, as it is sampled first.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie")))
    rows = rows.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie"))).drop("_tie")
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).checkpoint()
    parts = rows.groupBy("tree", "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "n": F.sum("_rows").over(Window.partitionBy("tree"))})
    placed = rows.join(sized(parts.checkpoint()), ["tree", "_part"])
    return placed.withColumn("pos", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_rows", "_before")


def runs_of(nodes: DataFrame, *more: str) -> DataFrame:
    """Gather the nodes of each run of ARITY: tree, pos of the run, n of the level above, and ``kids``."""
    kids = F.sort_array(F.collect_list(F.struct("pos", "hash", *more))).alias("kids")  # ARITY entries at most
    return nodes.groupBy("tree", F.floor(F.col("pos") / ARITY).alias("_run")).agg(kids, F.ceil(F.max("n") / ARITY).alias("n")).withColumnRenamed("_run", "pos")


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From leaves (tree, pos, n, hash): runs of leaves, stored node rows and the tops of all trees.

    A node row is (tree, level, pos, parent, before, after), for levels of runs (1) and above; a
    top is (tree, hash, height), the tree's last node and its level. A lone leaf is its own top.
    """
    runs = runs_of(leaves, "doc_id", "own").withColumn("hash", F.when((F.col("n") == 1) & (F.size("kids") == 1),
        F.get("kids.hash", F.lit(0))).otherwise(of_children(F.col("kids.hash")))).checkpoint()
    level, below, nodes, tops = 1, runs.select("tree", "pos", "n", "hash"), [], []
    while True:
        tops.append(below.filter("n = 1").select("tree", "hash", F.lit(level).alias("height")))
        below = below.filter("n > 1")
        if below.isEmpty():
            break
        above = runs_of(below).withColumn("hash", of_children(F.col("kids.hash"))).checkpoint()
        nodes.append(node_rows(above, level))
        level, below = level + 1, above.select("tree", "pos", "n", "hash")
    empty = node_rows(runs_of(runs.select("tree", "pos", "n", "hash").limit(0)), 1)
    return runs, reduce(DataFrame.unionByName, nodes, empty), reduce(DataFrame.unionByName, tops)


def node_rows(runs: DataFrame, level: int) -> DataFrame:
    """The children of each run as rows that name their parent and hold the digests beside them."""
    rows = runs.select("tree", F.col("pos").alias("parent"), F.col("kids.hash").alias("all"), F.posexplode("kids").alias("i", "kid"))
    return rows.select("tree", F.lit(level).alias("level"), F.col("kid.pos").alias("pos"), "parent", joined(F.slice("all", F.lit(1), F.col("i"))).alias("before"),
        joined(F.slice("all", F.col("i") + 2, F.lit(ARITY))).alias("after"))


def with_root(tops: DataFrame) -> tuple[DataFrame, bytes, DataFrame]:
    """Stored tops with ``steps`` (levels up to the root), the root, and the nodes between them, by tree."""
    tops = tops.withColumnRenamed("tree", "name").checkpoint()
    placed = numbered(tops.withColumn("tree", F.lit("")), "name")
    level, at, rows = 0, placed.select("name", "pos", "hash", "n", "height"), []
    paths = at.select("name", "pos", "height")
    below = at.select(F.lit("").alias("tree"), "pos", "n", "hash")
    while below.first()["n"] > 1:
        above = runs_of(below).withColumn("hash", of_children(F.col("kids.hash"))).checkpoint()
        beside = node_rows(above, level).select(F.col("pos").alias("_pos"), "before", "after")
        step = paths.withColumn("_pos", F.floor(F.col("pos") / F.lit(float(ARITY**level))))
        rows.append(step.join(beside, "_pos").select(F.col("name").alias("tree"), (F.col("height") + level).alias("level"), F.lit(0).cast("long").alias("pos"),
            F.lit(0).cast("long").alias("parent"), "before", "after"))
        level, below = level + 1, above.select("tree", "pos", "n", "hash")
    tops = tops.select(F.col("name").alias("tree"), "hash", "height", (F.col("height") + level).alias("steps"))
    return tops, bytes(below.first()["hash"]), reduce(DataFrame.unionByName, rows) if rows else None


def climb(spark: SparkSession, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Run the recursive query; the number of rows it may make is not limited while it runs."""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return spark.sql(CLIMB, runs=runs, nodes=nodes).checkpoint()
    finally:
        spark.conf.set(limit, before)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of ``docs`` and the proof of every row: doc_id, leaf, subroot, root,
    proof_sha256, folded_root and verified; digests in lower-case hex.

    A leaf is the digest of FIELDS; per lang, leaves ascend by doc_id, and each ARITY consecutive
    nodes become their digest until one is left, the subroot; subroots, ordered by lang, likewise
    give the root. proof_sha256 is the digest of all siblings from the leaf to the root. Rows for
    which ``tampered`` is true are folded from the digest of their text with A-Z in small letters.

    Nulls: a null field is hashed as ``-``; a null lang is a tree of its own, the first; null ids
    come first in their tree; a null ``tampered`` is false; a null text cannot be tampered with.
    Rows with equal ids are ordered by their digests, so equal rows are interchangeable; each is
    a leaf. Long texts cost their own hashing. A lone leaf is a subroot, a lone subroot the root;
    an empty table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    leaves = numbered(leaf_digests(docs, tampered).checkpoint(), "doc_id", "leaf").withColumnRenamed("leaf", "hash")
    runs, nodes, tops = build(leaves)
    if runs.isEmpty():
        shape = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
        return spark.createDataFrame([], "doc_id long, " + shape + ", verified boolean")
    tops, root, upper = with_root(tops)
    nodes = nodes if upper is None else nodes.unionByName(upper)
    heights = sized(tops.select("tree", "steps"))
    size = sized(runs.groupBy("tree").agg(F.max("pos").alias("last")).checkpoint())
    cover = F.least(F.pow(F.lit(float(ARITY)), F.col("level") - 1), F.lit(float(1 << 60)))  # runs beneath a node
    first, last = F.floor(F.col("pos") * cover / BLOCK), F.floor(((F.col("pos") + 1) * cover - 1) / BLOCK)
    stored = nodes.join(size, "tree").withColumn("block", F.explode(F.sequence(first, F.least(last, F.floor(F.col("last") / BLOCK))))).drop("last").checkpoint()
    lone = (F.col("n") == 1) & (F.size("kids") == 1)
    hashes = F.col("kids.hash")
    beside = lambda i, own: F.concat(F.slice(hashes, F.lit(1), i), own, F.slice(hashes, i + 2, F.lit(ARITY)))
    folded = F.transform("kids", lambda k, i: F.when(lone, k["own"]).otherwise(of_children(beside(i, F.array(k["own"])))))
    start = runs.join(heights, "tree").select("tree", F.col("pos").alias("run"), F.floor(F.col("pos") / BLOCK).alias("block"), F.col("steps").alias("height"),
        folded.alias("folded"))
    climbed = climb(spark, start, stored)
    rows = runs.select("tree", F.col("pos").alias("run"), "kids").join(climbed, ["tree", "run"]).join(sized(tops.select("tree", F.col("hash").alias("subroot"))), "tree")
    rows = rows.select("subroot", "folded", "proof", F.col("kids.hash").alias("all"), F.posexplode("kids").alias("i", "kid"))
    siblings = F.concat(joined(F.slice("all", F.lit(1), F.col("i"))), joined(F.slice("all", F.col("i") + 2, F.lit(ARITY))), F.col("proof"))
    up = F.get("folded", F.col("i"))
    return rows.select(F.col("kid.doc_id").alias("doc_id"), written(F.col("kid.hash")).alias("leaf"), written(F.col("subroot")).alias("subroot"),
        F.lit(root.hex()).alias("root"), F.sha2(written(siblings), 256).alias("proof_sha256"), written(up).alias("folded_root"), (up == F.lit(root)).alias("verified"))
