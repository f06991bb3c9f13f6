"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import sys
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word count here: a blank and the characters 9 to 13.
BLANKS = " \t\n\x0b\f\r"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let checkpoint() write to the folder that the cluster names in spark.checkpoint.dir.

    A folder of this machine is used only where that setting is absent and the master is local,
    as in tests; on a cluster a missing setting is an error, as executors share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "tradescope-checkpoints"))


def split_words(text: str | None) -> list[bytes]:
    """The maximal runs of characters outside BLANKS, as UTF-8; none for null."""
    return text.encode("utf-8").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    array = np.empty(len(words), dtype=object)
    array[:] = words
    return pd.util.hash_array(array, categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def release() -> None:
    """Give a worker's free memory back to the system, as Spark uses its workers again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(F.coalesce(column, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def uniform(*columns: str) -> Column:
    """A number from 0 to 1 by a hash of the columns, the same in every run."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)


def parts_for(rows: int, rows_per_part: int) -> int:
    """How many partitions hold ``rows`` at ``rows_per_part`` each; 1 at least."""
    return max(1, math.ceil(rows / rows_per_part))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], most: dict[bool, int]) -> DataFrame | None:
    """Documents to learn from: _u, text and the categories, or None where not both kinds are found.

    Of documents for which the last category is 1 (True) and others (False), at most ``most`` of
    each kind, different ones, by hashes of id and text. Labels of documents that are not in
    ``docs`` are left out before anything is counted or drawn, so they don't thin the sample; for
    this only ids are compared. A category of a document is 1 if one of its labels says so.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    last = F.col(categories[-1])
    votes = labels.filter(F.col("doc_id").isNotNull() & last.isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        *[F.max((F.col(c) > 0).cast("int")).alias(f"_y{k}") for k, c in enumerate(categories)])
    ids = docs.select(F.col("doc_id").alias("_id")).distinct()
    found = votes.join(ids, "_id", "left_semi").checkpoint()
    y = F.col(f"_y{len(categories) - 1}") > 0
    counts = {r["y"]: r["n"] for r in found.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return None
    share = F.when(y, min(1.0, 2 * most[True] / counts[True])).otherwise(min(1.0, 2 * most[False] / counts[False]))
    drawn = found.filter(uniform("_id") <= share)  # about twice as many ids as are wanted
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    texts = texts.withColumn("_u", uniform("doc_id", "text")).dropDuplicates(["_u"])
    picked = texts.filter(y).orderBy("_u").limit(most[True]).unionByName(texts.filter(~y).orderBy("_u").limit(most[False]))
    return picked.select("_u", "text", *[F.col(f"_y{k}").alias(c) for k, c in enumerate(categories)])
