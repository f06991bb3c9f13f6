"""An outbox as a stream: micro-batches of its files, routed by type, each written once under its batch's number."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def process_outbox(spark: SparkSession, inbox: str, schema, handlers: Mapping[str, Callable[[DataFrame], DataFrame]],
    target: str, column: str = "aggregate_type", files_per_batch: int = 2, seconds: int = 600) -> None:
    """Work off the files of ``inbox`` and stop: each handler gets the events of its type and gives rows to keep.

    What a batch gives is written to ``target``/type/batch=N in place of what an earlier try of
    that batch wrote, so events count once even if a batch is run again. Types without a handler
    go to ``target``/unrouted.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        routed = dict(handlers) | {"unrouted": lambda d: d}
        for name, handle in routed.items():
            mine = batch.filter(~F.coalesce(F.col(column).isin(*handlers), F.lit(False)) if name == "unrouted" else F.col(column) == name)
            handle(mine).write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")

    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    query = events.writeStream.foreachBatch(run).option("checkpointLocation", f"{target}/_progress").trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the outbox was not worked off in {seconds} seconds")


def lag_gauge(log: DataFrame, created: Column, pending: Column, as_of: Column, stuck_after: int) -> DataFrame:
    """One row: pending events, their mean and greatest age in seconds, and those older than ``stuck_after``."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(created)
    mine = log.filter(pending).select(age.alias("age"))
    return mine.agg(F.count(F.lit(1)).alias("pending"), F.avg("age").alias("mean_age"), F.max("age").alias("max_age"),
        F.count_if(F.col("age") > stuck_after).alias("stuck"))
