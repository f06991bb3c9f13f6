"""Peaks of series by distance and prominence, where one long series is many tasks.

Rows of a series are numbered and cut in segments of FAN values; segments are gathered to nodes of
FAN segments with their greatest and least values, and so on up. The nearest greater value to the
left or right of a peak is found by climbing from its segment to the first node that holds one and
going down again, which also gives the least value in between. A step of that search is one join
for all peaks; there are about two for each level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradescope.operators.joins import checked_broadcast
from tradescope.operators.ordered import numbered
from tradescope.registry import Steps

#: Values of a segment, and children of a node.
FAN = 64


def _local_maxima(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, _pos, x of the middles of runs of equal values that are higher than the runs on both sides."""
    before = rows.select(*key, (F.col("_pos") + 1).alias("_pos"), F.col("x").alias("_x"))
    starts = rows.join(before, [*key, "_pos"], "left").filter(F.col("_x").isNull() | (F.col("_x") != F.col("x"))).select(*key, "_pos", "x")
    runs = numbered(starts, key, ["_pos"], "_run")
    left = runs.select(*key, (F.col("_run") + 1).alias("_run"), F.col("x").alias("_l"))
    right = runs.select(*key, (F.col("_run") - 1).alias("_run"), F.col("x").alias("_r"), F.col("_pos").alias("_next"))
    met = runs.join(left, [*key, "_run"]).join(right, [*key, "_run"]).filter((F.col("_l") < F.col("x")) & (F.col("_r") < F.col("x")))
    return met.select(*key, F.floor((F.col("_pos") + F.col("_next") - 1) / 2).alias("_pos"), "x")


def _kept_apart(peaks: DataFrame, key: Sequence[str], distance: int, steps: Steps) -> DataFrame:
    """Peaks less those that lie within ``distance`` of a higher one that stays; of equal ones the first is higher.

    A peak stays once every higher one near it has gone, and goes once one of them stays; each
    round settles at least the highest that are left.
    """
    peaks = steps.store(peaks)
    bucket = F.floor(F.col("_pos") / distance)
    near = peaks.select(*key, F.col("_pos").alias("_q"), F.col("x").alias("_y"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    higher = (F.col("_y") > F.col("x")) | ((F.col("_y") == F.col("x")) & (F.col("_q") < F.col("_pos")))
    pairs = peaks.withColumn("_b", bucket).join(near, [*key, "_b"]).filter((F.abs(F.col("_pos") - F.col("_q")) < distance) & (F.col("_pos") != F.col("_q")) & higher)
    pairs = steps.store(pairs.select(*key, "_pos", "_q"))
    left, stays = peaks, []
    while True:
        free = steps.store(left.join(pairs.select(*key, "_pos"), [*key, "_pos"], "left_anti"))
        if free.isEmpty():
            return reduce(DataFrame.unionByName, stays, free)
        stays.append(free)
        gone = pairs.join(free.select(*key, F.col("_pos").alias("_q")), [*key, "_q"], "left_semi").select(*key, "_pos").distinct()
        left = steps.store(left.join(free, [*key, "_pos"], "left_anti").join(gone, [*key, "_pos"], "left_anti"))
        alive = left.select(*key, F.col("_pos").alias("_q"))
        pairs = steps.store(pairs.join(gone, [*key, "_pos"], "left_anti").join(alive, [*key, "_q"], "left_semi"))


def _tree(rows: DataFrame, key: Sequence[str], steps: Steps) -> tuple[DataFrame, DataFrame | None, int]:
    """Segments, the nodes above them and the highest level: key, level, idx, his and los, the children's greatest and least values."""
    sort = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("_at", c))), lambda s: s[c])  # noqa: E731 - FAN entries
    level, below, nodes = 0, rows.select(*key, F.col("_pos").alias("_at"), F.col("x").alias("hi"), F.col("x").alias("lo")), []
    while True:
        made = below.groupBy(*key, F.floor(F.col("_at") / FAN).alias("idx")).agg(sort("hi").alias("his"), sort("lo").alias("los"))
        nodes.append(steps.store(made.withColumn("level", F.lit(level))))
        if nodes[-1].filter("idx > 0").isEmpty():
            upper = reduce(DataFrame.unionByName, nodes[1:]) if level else None
            return nodes[0], upper, level
        below = nodes[-1].select(*key, F.col("idx").alias("_at"), F.array_max("his").alias("hi"), F.array_min("los").alias("lo"))
        level += 1


def _bases(peaks: DataFrame, key: Sequence[str], segments: DataFrame, upper: DataFrame | None, top: int, steps: Steps) -> DataFrame:
    """key, _pos, x, base: the higher of the least values between a peak and higher ground, or the end, on each side."""
    state = peaks.select(*key, "_pos", "x", F.explode(F.array(F.lit(True), F.lit(False))).alias("left"), F.lit(0).alias("level"),
        F.floor(F.col("_pos") / FAN).alias("idx"), (F.col("_pos") % FAN).cast("int").alias("k"), F.col("x").alias("low"))
    done = []
    x, k, size = F.col("x"), F.col("k"), F.size("his")
    seen = F.when(F.col("left"), F.reverse(F.slice("his", F.lit(1), F.least(k, size)))).otherwise(F.slice("his", k + 2, F.greatest(size - k - 1, F.lit(0))))
    lows = F.when(F.col("left"), F.reverse(F.slice("los", F.lit(1), F.least(k, size)))).otherwise(F.slice("los", k + 2, F.greatest(size - k - 1, F.lit(0))))
    hit = F.array_position(F.transform("seen", lambda v: v > x), True)  # 0 if none is greater
    while True:
        met = state.filter("level = 0").join(segments, [*key, "level", "idx"])
        if upper is not None:
            met = met.unionByName(state.filter("level > 0").join(checked_broadcast(upper), [*key, "level", "idx"]))
        met = met.withColumns({"seen": seen, "lows": lows, "size": size}).withColumn("hit", hit)
        passed = F.when(F.col("hit") > 0, F.slice("lows", F.lit(1), (F.col("hit") - 1).cast("int"))).otherwise(F.col("lows"))
        low = F.least("low", F.array_min(passed))  # least() skips the null of an empty array
        child = F.when(F.col("left"), F.least(k, F.col("size")) - F.col("hit")).otherwise(k + F.col("hit"))
        met = met.withColumns({"low": low, "over": F.when(F.col("hit") > 0, F.col("level") == 0).otherwise(F.col("level") >= top)})
        down = F.col("hit") > 0
        after = steps.store(met.select(*key, "_pos", "x", "left", "low", "over", (F.col("level") + F.when(down, -1).otherwise(1)).alias("level"),
            F.when(down, F.col("idx") * FAN + child).otherwise(F.floor(F.col("idx") / FAN)).alias("idx"),
            F.when(down, F.when(F.col("left"), FAN).otherwise(-1)).otherwise(F.col("idx") % FAN).cast("int").alias("k")))
        done.append(after.filter("over").select(*key, "_pos", "x", "low"))
        state = after.filter("NOT over").drop("over")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).groupBy(*key, "_pos", "x").agg(F.max("low").alias("base"))


def find_peaks(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, distance: int = 5, deviations: float = 1.0) -> DataFrame:
    """The rows of each series that are peaks, with their ``prominence``.

    A peak is higher than its neighbours (the middle of a plateau), lies ``distance`` or more
    from higher peaks that stay, and rises by ``deviations`` times the series' population
    deviation over the higher of the two bases on its sides. Rows with a null value are left out;
    the ends of a series are no peaks; keys and ``order`` must not be null.
    """
    steps, names = Steps(df.sparkSession), [f"_g{i}" for i in range(len(key))]
    kept = df.filter(F.col(value).isNotNull())
    placed = numbered(kept.select(F.struct("*").alias("row"), *[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], *[F.col(c).alias(f"_o{i}") for i,
        c in enumerate(order)], F.col(value).cast("double").alias("x")), names, [f"_o{i}" for i in range(len(order))], "_pos")
    rows = steps.store(placed.select("row", *names, "_pos", "x"))
    kept = steps.store(_kept_apart(_local_maxima(rows.select(*names, "_pos", "x"), names), names, distance, steps))
    segments, upper, top = _tree(rows, names, steps)
    found = _bases(kept, names, segments, upper, top, steps).withColumn("prominence", F.col("x") - F.col("base"))
    spread = rows.groupBy(*names).agg(F.stddev_pop("x").alias("_spread"))
    high = found.join(checked_broadcast(spread), names).filter(F.col("prominence") >= deviations * F.col("_spread")).select(*names, "_pos", "prominence")
    result = rows.join(high, [*names, "_pos"]).select("row.*", "prominence").checkpoint()
    steps.clear()
    return result
