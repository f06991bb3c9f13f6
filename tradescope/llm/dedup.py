"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Trees branch the documents recursively by minwise
tokens: a node picks one of its level's minwise tokens by a hash of its path, and a second one
with probability BRANCH, and a document goes to the child of each picked token's value. Small
nodes are compared exhaustively, large ones branch on, and independent trees are repeated. A pair
at a similarity of 0.8 meets in a tree with probability 0.8 where nodes are small at once, and
still with 0.51 where nodes stay large to the last level, so that 12 trees miss it with
probability 0.2^12 at best and 0.49^12 (0.0002) at worst.

What keeps this linear on groups of copies:
* documents with equal sets are one class from the start;
* before any node is compared exhaustively, every member is checked against the node's first
  member only; classes linked so are one component, and a node that lies in one component has
  nothing left to find, however large it is;
* pairs are first compared by their sketches (far below the threshold, so that none is lost to
  the estimate), then confirmed on full sets;
* nodes that stay large to the last level are compared in blocks with exact set intersections;
  blocks inside the node's largest component are not compared with each other, and only links
  between different components leave a pair of blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, hash_words, mix, release, slices
from .components import connected_components

#: Trees, further levels of each, the size of a small node, and of a block of a large one.
TREES, LEVELS, SMALL, BLOCK = 12, 3, 24, 512
SLOTS = TREES * (LEVELS + 1)
#: Share of nodes that branch on a second token: 1 / similarity - 1, which keeps a pair at the threshold alive.
BRANCH = 0.25
#: Pairs whose sketches agree in fewer slots than so many deviations below the threshold are not confirmed.
DEVIATIONS = 5
#: Documents to fetch full sets of are broadcast by key up to this number.
BROADCAST_IDS = 2_000_000

#: Bytes of text that are cut into shingles together.
SLICE_BYTES = 1_000_000

_ODD = np.random.default_rng(20).integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = np.random.default_rng(21).integers(1, 1 << 63, SLOTS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as sorted 64-bit hashes.

    Words are runs of characters other than a blank and 9 to 13, with A-Z in small letters. A
    text with fewer than n words has its whole sequence as one shingle; one without words, none.
    """
    words = [t.encode("utf-8").lower().split() if t else [] for t in texts]
    h = hash_words([w for one in words for w in one])
    out, at = [], 0
    with np.errstate(over="ignore"):
        for one in words:
            own, size = h[at : at + len(one)], len(one)
            at += size
            width = min(n, size)
            if not size:
                out.append(np.empty(0, dtype=np.uint64))
                continue
            rolled = np.zeros(size - width + 1, dtype=np.uint64)
            for j in range(width):
                rolled = rolled * _STEP + own[j : size - width + 1 + j]
            out.append(np.unique(mix(rolled + np.uint64(width))))
    return out


def row_key(docs: DataFrame) -> Column:
    """A 128-bit key of a row by all its columns; rows with one key are the same in every column."""
    values = [*(F.col(c).isNull() for c in docs.columns), *map(F.col, docs.columns)]
    return F.concat_ws("-", *(F.hex(F.xxhash64(F.lit(seed), *values)) for seed in (1, 2)))


def sketch(n: int):
    """A function for mapInArrow: documents in; size, fingerprint and minwise values of their sets out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            values = np.zeros((len(sets), SLOTS), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i, s in enumerate(sets):
                    for part in np.array_split(s, len(s) // 4096 + 1) if len(s) else ():
                        least = (part[:, None] * _ODD + _PLUS).min(axis=0)
                        values[i] = least if part[0] == s[0] else np.minimum(values[i], least)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            slots = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SLOTS, pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array([len(s) for s in sets],
                pa.int64()), pa.array(prints, pa.binary()), slots], names=["doc_id", "row_key", "n_shingles", "class", "slots"])
        release()

    return run


def full_sets(n: int):
    """A function for mapInArrow: documents of chosen classes in, their sets out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            starts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.ListArray.from_arrays(starts, pa.array(flat))], names=["class", "shingles"])
        release()

    return run


def sketch_share(percent: int) -> float:
    """The share of slots that sketches of a pair at the threshold agree in, less DEVIATIONS."""
    p = percent / 100
    return max(0.0, p - DEVIATIONS * math.sqrt(p * (1 - p) / SLOTS))


class Corpus:
    """Classes of documents, with their sketches and, on demand, their full sets."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs.select("doc_id", "text", row_key(docs).alias("row_key")), n, percent
        ensure_checkpoint_dir(docs.sparkSession)
        self.rows = self.docs.mapInArrow(sketch(n), "doc_id long, row_key string, n_shingles long, class binary, slots array<int>").checkpoint()
        self.classes = self.rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"),
            "doc_id", "row_key")).alias("choice"), F.first("n_shingles").alias("size"), F.first("slots").alias("slots")).checkpoint()

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(class, shingles) of the classes in ``wanted`` (class), from one document of each."""
        keys = self.classes.join(wanted.distinct(), "class", "left_semi").select("choice.row_key").checkpoint()
        few = keys.count() <= BROADCAST_IDS
        found = self.docs.join(F.broadcast(keys) if few else keys, "row_key", "left_semi").select("text").mapInArrow(full_sets(self.n),
            "class binary, shingles array<bigint>")
        return found.filter(F.col("class").isNotNull()).dropDuplicates(["class"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose sets are similar enough; sketches first, then sets."""
        side = lambda x: self.classes.select(F.col("class").alias(x), F.col("size").alias(f"n_{x}"), F.col("slots").alias(f"s_{x}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b")
        agree = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, v: t + v)
        near = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent) & (agree >= sketch_share(self.percent) * SLOTS)
        likely = likely.filter(near).select("a", "b").checkpoint()
        sets = self.sets(likely.select(F.col("a").alias("class")).union(likely.select("b"))).checkpoint()
        full = likely.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")),
            "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
        full = full.withColumn("both", F.size(F.array_intersect("x", "y")))
        return full.filter(F.col("both") * 100 >= (F.size("x") + F.size("y") - F.col("both")) * self.percent).select("a", "b").checkpoint()


def block_links(percent: int):
    """A function for groups: two blocks of a large node in, links between components out."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("class")
        sets = [np.asarray(s, dtype=np.int64) for s in block["shingles"]]
        names, parent = block["class"].tolist(), {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        labels = [x if x is not None else c for x, c in zip(block["label"], names, strict=True)]
        sizes = np.array([len(s) for s in sets])
        both = intersections(sets)
        hit = (both * 100 >= (sizes[:, None] + sizes[None, :] - both) * percent) & (block["half"].to_numpy()[:, None] <= block["half"].to_numpy()[None, :])
        found = []
        for i, j in zip(*np.nonzero(np.triu(hit | hit.T, 1)), strict=True):
            a, b = top(labels[i]), top(labels[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((names[i], names[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, from shingles that two sets or more share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[shingle] > 1
    owner, shingle = owner[shared], np.unique(shingle[shared], return_inverse=True)[1]
    total = np.diag([float(len(s)) for s in sets])
    own = np.zeros((len(sets), len(sets)))
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    for at in range(0, int(shingle.max()) + 1 if len(shingle) else 0, columns):
        lo, hi = np.searchsorted(shingle, [at, at + columns])
        x = np.zeros((len(sets), columns), dtype=np.float32)
        x[owner[lo:hi], shingle[lo:hi] - at] = 1.0
        own += x @ x.T
    np.fill_diagonal(own, 0.0)
    return own + total


def nodes_of(members: DataFrame) -> DataFrame:
    """Members (tree, path, class, label) of nodes of more than one component, with the node's size."""
    found = members.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    return members.join(found.filter(F.col("low") != F.col("high")).select("tree", "path", "members"), ["tree", "path"])


def children(large: DataFrame, classes: DataFrame, level: int, trees: int) -> DataFrame:
    """Members of the children of large nodes (tree, path, class, label), one look-up a class.

    A node picks its tokens among the ``trees`` minwise values of its level.
    """
    inside = large.groupBy("class").agg(F.first("label").alias("label"), F.collect_list(F.struct("tree", "path")).alias("nodes"))
    inside = inside.join(classes.select("class", F.slice("slots", trees * level + 1, trees).alias("tokens")), "class")
    pick = lambda x, k: F.pmod(F.xxhash64(x["path"], F.lit(k)), F.lit(trees)).cast("int")
    child = lambda x, k: F.struct(x["tree"].alias("tree"), F.xxhash64(x["path"], pick(x, k), F.get("tokens", pick(x, k))).alias("path"))
    second = lambda x: (F.pmod(F.xxhash64(x["path"], F.lit(2)), F.lit(1000)) < int(1000 * BRANCH)) & (pick(x, 0) != pick(x, 1))
    reached = F.concat(F.transform("nodes", lambda x: child(x, 0)), F.transform(F.filter("nodes", second), lambda x: child(x, 1)))
    return inside.select("class", "label", F.explode(F.array_distinct(reached)).alias("node")).select("node.tree", "node.path", "class", "label")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, trees: int = TREES, levels: int = LEVELS,
    small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Group documents (doc_id, text) whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles, class (the fingerprint of the set), component_id (the smallest
    doc_id that links reach, itself included), kept (whether it is that document), row_key (of
    all columns of ``docs``) and first_row (the row key of the component's first row: that with
    the smallest doc_id, then the smallest key).

    Nulls: documents without words or text have an empty set, are linked with nothing and are
    kept; rows with a null doc_id take part, but have no id to give, and are not kept unless
    nothing with an id is linked with them; of a component without ids the first row is kept.
    Repeated rows are documents of one class; each gets its row, with equal ids all of them kept,
    as the rule on ids says. Empty tables give no rows; further columns only enter the key.
    """
    corpus = Corpus(docs, shingle_words, percent)
    members = corpus.classes.select("class", F.posexplode(F.slice("slots", 1, trees)).alias("tree", "token")).select("class",
        "tree", F.col("token").cast("long").alias("path"))
    found = members.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("members"), F.min("class").alias("first")).filter("members > 1")
    shared = members.join(found.select("tree", "path", "first"), ["tree", "path"]).checkpoint()
    links = corpus.links(shared.filter(F.col("class") != F.col("first")).select(F.col("first").alias("a"), F.col("class").alias("b")).distinct())
    labels = connected_components(links)
    labelled = shared.select("tree", "path", "class").join(labels.select(F.col("node").alias("class"), "label"), "class", "left")
    open_nodes = nodes_of(labelled.withColumn("label", F.coalesce("label", "class"))).checkpoint()
    pairs = small_pairs(open_nodes, small)
    large = open_nodes.filter(F.col("members") > small)
    for level in range(1, levels + 1):
        if large.limit(1).count() == 0:
            break
        deeper = nodes_of(children(large, corpus.classes, level, trees)).checkpoint()
        pairs = pairs.union(small_pairs(deeper, small))
        large = deeper.filter(F.col("members") > small)
    links = links.union(corpus.links(pairs.distinct()))
    if large.limit(1).count():
        links = links.union(large_links(corpus, large, block))
    labels = connected_components(links)
    least = corpus.classes.join(labels, F.col("class") == F.col("node")).groupBy("label").agg(F.min("choice").alias("choice"))
    linked = labels.join(least, "label").select(F.col("node").alias("class"), "choice")
    alone = corpus.classes.select("class", "choice").join(linked, "class", "left_anti")
    found = corpus.rows.select("doc_id", "row_key", "n_shingles", "class").join(linked.union(alone), "class", "left")
    found = found.withColumns({"component_id": F.coalesce("choice.doc_id", "doc_id"), "first_row": F.coalesce("choice.row_key", "row_key")})
    kept = F.when(F.col("component_id").isNull(), F.col("row_key") == F.col("first_row")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "class", "component_id", kept.alias("kept"), "row_key", "first_row")


def small_pairs(nodes: DataFrame, small: int) -> DataFrame:
    """All pairs of different components inside nodes of at most ``small`` members."""
    gathered = nodes.filter(F.col("members") <= small).groupBy("tree", "path").agg(F.sort_array(F.collect_list(F.struct("class", "label"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice(F.col("m"), i + 2, F.size("m")),
        lambda y: y["label"] != x["label"]), lambda y: F.struct(x["class"].alias("a"), y["class"].alias("b")))))
    return gathered.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def large_links(corpus: Corpus, large: DataFrame, block: int) -> DataFrame:
    """Links inside nodes that stayed large, from pairs of blocks of about ``block`` members.

    The node's largest component has blocks of its own, which meet the others' blocks only.
    """
    node = ["tree", "path"]
    sizes = large.groupBy(*node, "label").agg(F.count(F.lit(1)).alias("n"))
    majors = sizes.groupBy(*node).agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("members"))
    majors = majors.select(*node, F.col("m.label").alias("major"), F.ceil(F.col("m.n") / block).alias("inner"),
        F.ceil((F.col("members") - F.col("m.n")) / block).alias("outer"))
    dealt = large.select(*node, "class", "label").join(majors, node).withColumn("within", F.col("label") == F.col("major"))
    dealt = dealt.withColumn("own", F.when(F.col("within"), F.col("outer") + F.pmod(F.xxhash64("class"),
        "inner")).otherwise(F.pmod(F.xxhash64("class"), "outer")))
    met = F.when(F.col("within"), F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0).cast("long"),
        F.col("outer") + F.col("inner") - 1))
    dealt = dealt.withColumn("other", F.explode(met))
    dealt = dealt.select(*node, "class", "label", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
        (F.col("own") > F.col("other")).cast("int").alias("half"))
    sets = corpus.sets(large.select("class"))
    return dealt.join(sets, "class").groupBy(*node, "left", "right").applyInPandas(block_links(corpus.percent), "a binary, b binary").distinct().checkpoint()
