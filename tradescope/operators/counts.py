"""Counts of terms inside documents: counted where a document's text lies, so that no row for each word is moved."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def _counted(key: str, kind: pa.DataType):
    """A function for mapInArrow: the terms of each list with their number and first place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                terms, counts, firsts, ends, lengths = [], [], [], [0], []
                for words in part.column("w"):
                    words, own, first = words.as_py() or [], {}, {}
                    for i, w in enumerate(words):
                        if w in own:
                            own[w] += 1
                        else:
                            own[w], first[w] = 1, i
                    terms += own
                    counts += own.values()
                    firsts += first.values()
                    ends.append(len(terms))
                    lengths.append(len(words))
                found = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int32())], ["term", "n", "first"])
                yield pa.record_batch({key: part.column(key).cast(kind), "l": pa.array(lengths, pa.int64()), "terms": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)})

    return run


def term_lists(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, l, terms): a document's number of tokens and its terms (term, n, first place), one row for each key.

    Documents are moved once, to be dealt evenly; of terms, only those of keys that stand several times are. Their counts add up.
    """
    kind = docs.schema[key].dataType
    made = docs.repartition(key).select(key, tokens.alias("w")).mapInArrow(_counted(key, to_arrow_type(kind)),
        f"{key} {kind.simpleString()}, l bigint, terms array<struct<term: string, n: bigint, first: int>>")
    several = docs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_key")
    if several.isEmpty():
        return made
    same = F.col(key).eqNullSafe(F.col("_key"))
    again = made.join(several, same, "left_semi")
    terms = again.select(key, F.explode("terms").alias("x")).groupBy(key, "x.term").agg(F.sum("x.n").alias("n"), F.min("x.first").alias("first"))
    terms = terms.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("term", "n", "first")).alias("terms"))
    merged = again.groupBy(key).agg(F.sum("l").alias("l")).join(terms, same, "left")
    none = F.array().cast("array<struct<term: string, n: bigint, first: int>>")
    return made.join(several, same, "left_anti").union(merged.select(key, "l", F.coalesce("terms", none).alias("terms")))


def postings(lists: DataFrame, key: str) -> DataFrame:
    """(key, l, term, n, first) of ``term_lists``."""
    return lists.select(key, "l", F.explode("terms").alias("x")).select(key, "l", "x.term", "x.n", "x.first")


def _led(key: str, k: int):
    """A function for mapInArrow: the k rows of the highest score, ties by term, of each run of rows of one key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, scores, terms = (batch.column(c).to_pylist() for c in (key, "score", "term"))
            kept, low = [], 0
            for _, group in groupby(keys):
                high = low + sum(1 for _ in group)
                kept += sorted(range(low, high), key=lambda i: (-scores[i], terms[i]))[:k]
                low = high
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def best_terms(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best (key, term, score) of each key, ties to the smaller term; rows of a key that lie beside each other are thinned before they are moved."""
    led = scored.select(key, "term", "score").mapInArrow(_led(key, k), scored.select(key, "term", "score").schema)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))
    return led.withColumn("k", rank).filter(F.col("k") <= k).drop("k")
