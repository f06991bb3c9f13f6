"""Files and topics as DataFrames: each reader keeps what it cannot read, so that it can be counted."""

from __future__ import annotations

import datetime
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The column that holds a line which does not fit the schema.
BAD = "_bad_line"


def read_delimited(spark: SparkSession, path: str, schema: StructType, separator: str = ",", header: bool = True) -> DataFrame:
    """Delimited files with a schema; a line that does not fit keeps its fields that do, and the whole line in BAD."""
    kept = StructType([*schema.fields, StructField(BAD, StringType())])
    return spark.read.schema(kept).options(sep=separator, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD).csv(path)


def scan_counts(rows: DataFrame, key: Sequence[str], valid: Column) -> DataFrame:
    """One row: total, bad lines, invalid ones, repeats of a valid key, and valid ones without repeats."""
    good = F.col(BAD).isNull() & F.coalesce(valid, F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    by_key = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), n(F.col(BAD).isNotNull()).alias("bad"), n(good).alias("good"))
    return by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
            F.coalesce(F.sum(F.col("n") - F.col("bad") - F.col("good")), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.greatest(F.col("good") - 1, F.lit(0))), F.lit(0)).alias("repeats"), n(F.col("good") > 0).alias("valid"),
    )


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """Some rows, as they come."""
    return rows.limit(n)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A labelled dataset (text, label) from JSON lines or CSV, by the ending of the path."""
    shape = "text string, label string"
    kind = os.path.splitext(path.rstrip("/"))[1]
    if kind in (".json", ".jsonl"):
        return spark.read.schema(shape).json(path)
    if kind == ".csv":
        return spark.read.schema(shape).options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    raise ValueError(f"no reader for {kind or 'a path without an ending'}")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of text files; bytes that are no UTF-8 become the replacement character."""
    return spark.read.text(path).select(F.col("value").alias("line")).filter(F.trim("line") != "")


def read_days(spark: SparkSession, path: str, first: datetime.date, last: datetime.date, column: str = "date") -> DataFrame:
    """A table that is partitioned by day, from one day through another: other days' files are not opened."""
    return spark.read.parquet(path).filter(F.col(column).between(F.lit(first), F.lit(last)))


def unwrap_changes(messages: DataFrame, schema: str, tables: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """Change messages (topic, key, value) as rows: table, op, deleted, ts and the fields of ``schema``.

    A topic is ``server.schema.table``; only ``tables`` are let in, and their names lose the
    server's. A delete has the fields that it had before. Tombstones, with a null value, are kept
    as deletes of unknown fields. It reads streams and tables alike.
    """
    shape = StructType.fromDDL(f"op string, ts_ms long, before struct<{schema}>, after struct<{schema}>")
    rows = messages.select(F.regexp_replace("topic", r"^[^.]+\.", "").alias("table"), "key", F.from_json("value",
        shape).alias("m"), F.col("value").isNull().alias("tombstone"))
    rows = rows.filter(F.col("table").isin(*tables))
    deleted = F.col("tombstone") | (F.col("m.op") == "d")
    fields = F.when(F.col("m.op") == "d", F.col("m.before")).otherwise(F.col("m.after"))
    rows = rows.select("table", "key", F.coalesce("m.op", F.lit("tombstone")).alias("op"), F.coalesce(deleted,
        F.lit(False)).alias("deleted"), F.col("m.ts_ms").alias("ts_ms"), fields.alias("f"))
    return rows.select("table", "key", "op", "deleted", "ts_ms", "f.*").drop(*excluded)


#: Fields of an exported message.
MESSAGE = "id long, date string, text string, views long, forwards long, replies long, sender_id long, media string"


def normalise_messages(exported: DataFrame) -> DataFrame:
    """Exported messages (channel, payload as JSON) with typed fields; missing counts are 0, missing text is empty."""
    m = exported.select("channel", F.from_json("payload", MESSAGE).alias("m")).select("channel", "m.*")
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("views", "forwards", "replies")}
    text = F.coalesce("text", F.lit(""))
    return m.withColumns({**counts, "text": text, "date": F.to_timestamp("date"), "has_media": F.col("media").isNotNull(),
        "text_length": F.length(text).cast("long")}).drop("media")
