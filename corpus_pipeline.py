"""A training-data pipeline over ``documents``: five operators one after the other.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of ``documents``; the last returns packed pieces. Stages are joined by tables: each
one's result is written as Parquet and read again as the next one's input.

Nulls, empty and very long texts, ties, repeated rows and empty tables are treated as the
operators say; each stage adds its own rule below. Further columns may have any name: they are
set aside under numbers while an operator works, and come back as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradescope.llm import dedup, language, mixing, packing, queries, toxicity
from tradescope.llm.common import ensure_checkpoint_dir, read

#: A language must be this much likelier than a guess among all languages, as a share of what is left to certainty.
LEAST_LEAD = 0.25
BROADCAST_IDS = 2_000_000


def aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame], *needed: str) -> DataFrame:
    """``work`` on ``docs`` with every column but ``needed`` under a number; then the columns of ``docs``."""
    names = {c: c if c in needed else f"column_{i}_set_aside" for i, c in enumerate(docs.columns)}
    done = work(docs.toDF(*names.values()))
    return done.select([F.col(new).alias(old) for old, new in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic.

    A null or empty text is judged by the models' biases; every row of repeated ones is judged
    alike; without labels of both kinds all documents stay; an empty table stays empty.
    """
    labels = queries.with_poor(read(spark, sf_dir, "labels"))
    judge = lambda d: toxicity.classify_toxicity(d, labels, ("poor", "toxic"), keep_text=True).filter(~F.col("toxic"))
    return aside(docs, judge, "doc_id", "text")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the table names; texts without letters go, null and empty ones too.

    The predicted language must lead a guess by LEAST_LEAD: with K languages a score of
    1/K + LEAST_LEAD (1 - 1/K) is asked for. Repeated rows are judged alike; where the table names
    no language every text is undetermined and goes; an empty table stays empty.
    """
    n = F.lit(max(1, docs.filter(F.col("text").isNotNull()).select(F.count_distinct("lang")).first()[0]))
    known = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= 1 / n + LEAST_LEAD * (1 - 1 / n))
    return aside(docs, lambda d: language.identify_languages(d, keep_text=True).filter(known), "text", "lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, or of those without ids one.

    Rows are told apart by all their columns, so that rows that share an id are judged each by
    its own text. Of rows that are the same in every column one stays. Texts without words, null
    ones too, are in no group and stay; an empty table stays empty.
    """
    ensure_checkpoint_dir(spark)
    found = dedup.near_duplicates(docs, shingle_words=5, percent=80).select("row_key", "first_row").checkpoint()
    gone = found.filter(F.col("row_key") != F.col("first_row")).select("row_key").distinct().checkpoint()
    small = gone.count() <= BROADCAST_IDS
    rows = docs.select(dedup.row_key(docs).alias("row_key"), F.struct("*").alias("row"))
    kept = rows.join(F.broadcast(gone) if small else gone, "row_key", "left_anti")
    repeated = found.groupBy("row_key").count().filter("count > 1").select("row_key").checkpoint()
    if repeated.limit(1).count():
        once = kept.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"])
        kept = kept.join(repeated, "row_key", "left_anti").unionByName(once)
    return kept.select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source of its own; null and empty texts have no words and come as often as
    their source has whole epochs; ties and repeated rows are ordered by key, size and text; an
    empty table stays empty.
    """
    labels = read(spark, sf_dir, "labels")

    def taken(rows: DataFrame) -> DataFrame:
        mixed = mixing.mix_sources(queries.with_weights(rows, labels), F.col("quality_weight")).filter(F.col("times") > 0)
        return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))

    return aside(docs, taken, "doc_id", "text", "source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens.

    A null text is an empty one; every row of repeated ones is packed; an empty table gives no rows.
    """
    return packing.pack_documents(docs, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unknown_language), ("near_dedup", drop_near_duplicates), ("mixing", mix), ("packing", pack)]
#: Learned classifiers cannot be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, by the rules of each."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{name}")
        docs = spark.read.parquet(f"{shared}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
