"""The registry of queries: a name, a function of (spark, sf_dir), and SQL to check it by."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[["Tables"], DataFrame]


class Tables:
    """Tables of a folder and the domain views over them, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._stored = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        from tradescope.plans import views

        if name in views.VIEWS:
            return views.VIEWS[name](self)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` from a table in the shared folder, written when a query asks for ``name`` first: made once, of known size."""
        if name not in self._stored:
            path = f"{self.scratch()}/{name}"
            rows.write.parquet(path)
            self._stored[name] = self.spark.read.schema(rows.schema).parquet(path)
        return self._stored[name]

    def scratch(self) -> str:
        """A new folder that all executors share."""
        return f"{shared_dir(self.spark)}/tradescope-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; of this machine only where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "tradescope")


class Steps:
    """Tables that the rounds of a loop write to the shared folder and read again.

    Unlike a checkpoint, a table that is read again has the sizes of its files: estimates of
    sizes don't multiply from round to round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.written = spark, f"{shared_dir(spark)}/tradescope-{uuid.uuid4().hex}", 0

    def store(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a table that is read again."""
        self.written += 1
        path = f"{self.folder}/{self.written}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        """Remove the tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name domain views, whose definitions are put in front."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            from tradescope.plans import views

            ORACLES[name] = views.with_views(sql)
        return f

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries as functions of (spark, sf_dir)."""

    def bound(f: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(Tables(spark, sf_dir))

    return {name: bound(f) for name, f in QUERIES.items()}
