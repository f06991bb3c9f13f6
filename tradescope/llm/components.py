"""Connected components of a graph of links, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b): label is the least node of its component.

    Each round every node takes the least label among its neighbours and then that label's own
    label, so that chains shrink by halves. Rounds are cut by checkpoint().
    """
    ensure_checkpoint_dir(links.sparkSession)
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).filter(F.col("node") != F.col("other")).distinct().checkpoint()
    labels = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")).checkpoint()
    while True:
        ends = labels.select(F.col("node").alias("other"), F.col("label").alias("seen"))
        least = both.join(ends, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        met = labels.join(least, "node").select("node", "label", F.least("label", "seen").alias("met"))
        jumped = met.join(labels.select(F.col("node").alias("met"), F.col("label").alias("far")), "met").select("node",
            "label", F.least("met", "far").alias("next")).checkpoint()
        moved = jumped.filter(F.col("next") != F.col("label")).limit(1).count()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
