"""Tables as targets: append what is new, replace by key, partition by day, rebuild, register.

A target is a folder of Parquet files. What replaces a target is written beside it, under the next
version number, and then named in its own small folder of versions, so that readers and reruns
never see half a table; only the driver lists versions, and rows stay on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(rows: DataFrame, path: str, key: str | Sequence[str] = "op_hash", derived: Mapping[str, Column] | None = None) -> DataFrame:
    """Append rows whose key the target does not hold, each key once; returns what the target then holds.

    Of rows with one key the smallest counts. Rows without a key are left out; in a key of several columns null is a value.
    A rerun adds nothing. Columns ``derived`` from the others are made as rows are written, so that they are not moved; of
    the target only keys are, together with the rows.
    """
    spark, keys, derived = rows.sparkSession, [key] if isinstance(key, str) else list(key), derived or {}
    shape = rows.withColumns(dict(derived)).schema
    others = F.struct(*[c for c in rows.columns if c not in keys])
    given = rows.select(*keys, others.alias("r"), F.lit(False).alias("held"))
    held = read_or_empty(spark, path, shape).select(*keys, F.lit(None).cast(given.schema["r"].dataType).alias("r"), F.lit(True).alias("held"))
    both = given.unionByName(held)
    both = both.filter(F.col(keys[0]).isNotNull()) if len(keys) == 1 else both
    once = both.groupBy(*keys).agg(F.min("r").alias("r"), F.max("held").alias("held")).filter("NOT held").select(*keys, "r.*").select(rows.columns)
    once.withColumns(dict(derived)).write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path)


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of a versioned table's newest version; 0 where there is none."""
    found = read_or_empty(spark, f"{path}/versions", "version int").agg(F.max("version")).first()[0]  # a number a version
    return found or 0


def read_latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of a table, or an empty table."""
    return read_or_empty(spark, f"{path}/v={latest_version(spark, path)}", schema)


def replace(rows: DataFrame, path: str) -> DataFrame:
    """Write a table's next version and name it; returns it."""
    spark = rows.sparkSession
    version = latest_version(spark, path) + 1
    rows.write.mode("overwrite").parquet(f"{path}/v={version}")
    spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{path}/versions")
    return spark.read.schema(rows.schema).parquet(f"{path}/v={version}")


def upsert(rows: DataFrame, path: str, key: str, order: Sequence[str]) -> DataFrame:
    """Replace rows by key: of a key's rows, old and new, the last by ``order`` stays, ties by the other columns."""
    others = [c for c in rows.columns if c != key and c not in order]
    both = read_latest(rows.sparkSession, path, rows.schema).unionByName(rows)
    last = both.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("r")).select(key, "r.*")
    return replace(last.select(rows.columns), path)


def vector_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vectors as upserted: key, vector, and op_hash of the key and the first ten components."""
    head = F.array_join(F.transform(F.slice(vector, 1, 10), lambda x: F.round(x.cast("double"), 6).cast("string")), ",")
    return vectors.select(key, vector, F.sha2(F.concat_ws(":", F.col(key).cast("string"), head), 256).alias("op_hash"))


def write_days(rows: DataFrame, path: str, day: Column, column: str = "log_date") -> None:
    """Append rows into a folder per day; rows of a day come from few tasks, and a large day from several."""
    dated = rows.withColumn(column, day)
    dated.repartition(column, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("append").partitionBy(column).parquet(path)


def dead_letters(rows: DataFrame, record: str, error: Column, target: str, operation: str = "insert") -> DataFrame:
    """Rows that fail, with why: record_id, target_db, operation, error_message, retry_count."""
    failed = rows.withColumn("error_message", error).filter(F.col("error_message").isNotNull())
    return failed.select(F.col(record).cast("string").alias("record_id"), F.lit(target).alias("target_db"),
        F.lit(operation).alias("operation"), "error_message", F.lit(0).alias("retry_count"))


def rebuild(records: DataFrame, targets: Mapping[str, Callable[[DataFrame], DataFrame]], path: str) -> dict[str, DataFrame]:
    """Derive every target again from the records and put it in the old one's place."""
    return {name: replace(make(records), f"{path}/{name}") for name, make in targets.items()}


def registry_row(table: DataFrame, name: str, kind: str) -> DataFrame:
    """One row about a dataset: name, type, row_count, schema as JSON and a checksum that no order changes."""
    digest = F.xxhash64(*table.columns).cast("decimal(38,0)")
    found = table.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("sum"))
    return found.select(F.lit(name).alias("name"), F.lit(kind).alias("type"), "row_count", F.lit(table.schema.json()).alias("schema"),
        F.sha2("sum", 256).alias("checksum"))


def graph_tables(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (type, id, name) and relations (type, src, dst, record_id) of declarations; the last name of a company wins."""
    firms = records.groupBy(F.col("edrpou").alias("id")).agg(F.max_by("company_name", F.struct("date",
        "pk")).alias("name")).select(F.lit("Company").alias("type"), "id", "name")
    others = records.select(F.explode(F.array(F.struct(F.lit("Product").alias("type"), F.col("hs_code").alias("id")),
        F.struct(F.lit("Country").alias("type"), F.col("country_code").alias("id")))).alias("n"))
    nodes = firms.unionByName(others.select("n.*").distinct().withColumn("name", F.lit(None).cast("string")))
    imports = records.select(F.lit("IMPORTS").alias("type"), F.col("edrpou").alias("src"), F.col("hs_code").alias("dst"), F.col("pk").alias("record_id"))
    origins = records.select(F.lit("FROM_COUNTRY").alias("type"), F.col("hs_code").alias("src"), F.col("country_code").alias("dst"),
        F.lit(None).cast("string").alias("record_id")).distinct()
    return nodes, imports.unionByName(origins)


def counters(records: DataFrame) -> DataFrame:
    """Counters (key, value): declarations by product and country, amount by company."""
    one = F.lit(1.0)
    keys = F.array(
        F.struct(F.concat(F.lit("count:hs:"), "hs_code").alias("key"), one.alias("value")),
        F.struct(F.concat(F.lit("count:country:"), "country_code").alias("key"), one.alias("value")),
        F.struct(F.concat(F.lit("amount:company:"), "edrpou").alias("key"), F.col("amount").alias("value")),
    )
    return records.select(F.explode(keys).alias("c")).select("c.*").groupBy("key").agg(F.sum("value").alias("value"))
