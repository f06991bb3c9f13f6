"""Orders over whole tables without a single task: places, running sums, exact quantiles, two-sample tests and exponential means.

Rows are range-partitioned and sorted where they lie; a partition's offset is what the partitions
before it sum up to, a row for each partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.operators.graph import shared_checkpoints
from tradescope.operators.joins import checked_broadcast
from tradescope.registry import Steps

#: Bins of an interval, parts of an octave in the first bins, and rows of an interval that are put in order in one array.
BINS, OCTAVE, GATHERED = 1024, 16, 10_000
#: Rows of a block of an exponential mean; what has decayed by exp(-FADED) is nothing in a double.
BLOCK, FADED = 128, 42.0


def _sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows dealt by range and sorted: _id ascends in order, _part is the partition. Equal rows may lie apart."""
    shared_checkpoints(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in (*order, "_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).checkpoint()  # dealing by range samples its input first
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    return rows.withColumn("_part", F.shiftright("_id", 33)).checkpoint()


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Add the place of each row among those of its key, from 0; a key's rows may lie in any number of partitions."""
    rows = _sorted(df, [*key, *order])
    parts = rows.groupBy(*key, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").checkpoint()
    given = parts.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(checked_broadcast(given), same).withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).select(*df.columns, name)


def running_sums(df: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add place (from 1) and through_<value>, the sum up to and with each row, over the whole table in ``order``."""
    rows = _sorted(df, order)
    sums = [F.sum(F.coalesce(F.col(v), F.lit(0))).alias(v) for v in values]
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *sums).collect()  # a row per partition
    real = {v for v, t in rows.dtypes if t in ("double", "float")}
    before, total = [], {"_n": 0} | {v: 0.0 if v in real else 0 for v in values}
    for part in sorted(parts, key=lambda p: p["_part"]):
        before.append((part["_part"], *total.values()))
        total = {k: v + (part[k] or 0) for k, v in total.items()}
    types = [("_n", "long"), *((v, "double" if v in real else "long") for v in values)]
    offsets = df.sparkSession.createDataFrame(before, "_p long, " + ", ".join(f"`_before_{c}` {t}" for c, t in types))
    w = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, (F.col("_before__n") + F.row_number().over(w)).alias("place"),
        *[(F.col(f"_before_{v}") + F.sum(F.coalesce(F.col(v), F.lit(0))).over(w)).alias(f"through_{v}") for v in values])


def exact_quantiles(df: DataFrame, value: Column | str, fractions: Sequence[float], by: Sequence[str] = (), gathered: int = GATHERED) -> DataFrame:
    """(by..., q): the exact quantiles of a column at ``fractions``, as ``percentile`` gives them, for each group.

    Values are counted in bins of a part of an octave; the bin that holds a rank becomes its
    interval, which is divided further until it holds at most ``gathered`` rows or one value.
    Then the rows of the interval are put in order. Values between two ranks are interpolated.
    The state of a group is its bins, never its rows. Nulls and NaN are left out; a null is a
    group of its own; groups without values have no row. The values are stored once for the scans.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    steps = Steps(spark)
    x = F.col(value) if isinstance(value, str) else value
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    own = [F.col(c).alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(0).alias("_g0")]
    rows = df.select(*own, x.cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    rows = steps.store(rows.withColumn("x", F.col("x") + F.lit(0.0)))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]

    def narrowed(bins: DataFrame, wanted: DataFrame, scope: Sequence[str]) -> DataFrame:
        """For each wanted rank the bin that holds it: its bounds, rows and the rank's place inside."""
        w = Window.partitionBy(*scope).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # bins, not rows
        placed = bins.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in scope]
        inside = (F.col("a.inner") >= F.col("b.before")) & (F.col("a.inner") < F.col("b.before") + F.col("b.n"))
        return checked_broadcast(wanted).alias("a").join(placed.alias("b"), [*on, inside]).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.rank",
            (F.col("a.inner") - F.col("b.before")).alias("inner"), "b.lo", "b.hi", "b.n")

    size = F.log2(F.greatest(F.abs("x"), F.lit(5e-324))) + 1100
    figures = (F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    bins = steps.store(rows.groupBy(*keys, F.floor(F.signum("x") * size * OCTAVE).alias("bin")).agg(*figures))
    sizes = steps.store(bins.groupBy(*keys).agg(F.sum("n").alias("total")))
    at = F.transform(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: f * (F.col("total") - 1))
    ranks = F.array_distinct(F.concat(F.transform(at, lambda p: F.floor(p)), F.transform(at, lambda p: F.ceil(p))))
    wanted = sizes.select(*keys, F.explode(ranks).alias("rank")).withColumn("inner", F.col("rank"))
    targets = steps.store(narrowed(bins, wanted, keys))
    open_, done = targets.filter((F.col("n") > gathered) & (F.col("lo") < F.col("hi"))), []
    done.append(targets.filter(~((F.col("n") > gathered) & (F.col("lo") < F.col("hi")))))
    while not open_.isEmpty():
        spans = open_.select(*keys, F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        inside = rows.alias("a").join(checked_broadcast(spans).alias("b"), [*same("a", "b"), F.col("a.x").between(F.col("b.from"), F.col("b.to"))])
        inside = inside.select(*[F.col(f"a.{k}").alias(k) for k in keys], "x", "from", "to")
        bin_ = F.floor((F.col("x") - F.col("from")) / (F.col("to") - F.col("from")) * BINS)
        bins = inside.groupBy(*keys, "from", "to", bin_.alias("bin")).agg(*figures)
        wanted = open_.select(*keys, "rank", "inner", F.col("lo").alias("from"), F.col("hi").alias("to"))
        targets = steps.store(narrowed(bins, wanted, [*keys, "from", "to"]))
        wide = (F.col("n") > gathered) & (F.col("lo") < F.col("hi"))
        open_ = targets.filter(wide)
        done.append(targets.filter(~wide))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    spans = found.filter("lo < hi").select(*keys, "lo", "hi").distinct()
    lists = rows.alias("a").join(checked_broadcast(spans).alias("b"), [*same("a", "b"), F.col("a.x").between(F.col("b.lo"), F.col("b.hi"))])
    lists = lists.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], "lo", "hi").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # ``gathered`` values
    met = found.alias("a").join(lists.alias("b"), [*same("a", "b"), F.col("a.lo") == F.col("b.lo"), F.col("a.hi") == F.col("b.hi")], "left")
    value_of = met.select(*[F.col(f"a.{k}").alias(k) for k in keys], "rank", F.when(F.col("a.lo") == F.col("a.hi"),
        F.col("a.lo")).otherwise(F.get("xs", F.col("inner").cast("int"))).alias("v"))
    maps = value_of.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))  # two ranks a fraction
    q = F.transform(at, lambda p: F.when(F.floor(p) == F.ceil(p), F.element_at("m", F.floor(p))).otherwise((F.ceil(p) - p) * F.element_at("m", F.floor(p)) + (p
        - F.floor(p)) * F.element_at("m", F.ceil(p))))
    result = maps.alias("a").join(sizes.alias("b"), same("a", "b")).select(*[F.col(f"a.{k}").alias(c) for k, c in zip(keys, by, strict=False)], q.alias("q")).checkpoint()
    steps.clear()
    return result


def quantile_figures(df: DataFrame, value: Column | str, **named: float) -> DataFrame:
    """One row of exact quantiles under their names; nulls for an empty column."""
    found = exact_quantiles(df, value, list(named.values()))
    return found.agg(*[F.get(F.max("q"), F.lit(i)).alias(n) for i, n in enumerate(named)])


def two_sample_ks(df: DataFrame, value: str, first: Column, second: Column) -> DataFrame:
    """One row: d, the largest gap between the distributions of two samples, and p, its asymptotic probability if they are one.

    Rows count as equal values are met: values are counted first, then summed up in order.
    """
    counts = df.groupBy(value).agg(F.count_if(first).alias("a"), F.count_if(second).alias("b")).filter(F.col(value).isNotNull() & (F.col("a") + F.col("b") > 0))
    sums = running_sums(counts, [value], ["a", "b"])
    totals = sums.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("through_a") / F.col("na") - F.col("through_b") / F.col("nb"))
    found = sums.join(F.broadcast(totals)).agg(F.max(gap).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    scaled = F.col("d") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda t, k: t + F.when(k % 2 == 1,
        2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled))
    return found.select("d", F.when(scaled < 0.1, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0))).alias("p"))


def ewm_means(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, spans: Sequence[int]) -> DataFrame:
    """Add ewm_<span> for each span: the exponentially weighted mean with all weights kept, sum(k^i x) / sum(k^i), k = 1 - 2 / (span + 1).

    A key's rows are numbered and cut in blocks. Inside a block the decayed sum is a running sum
    of scaled values; what the blocks before hand on is the sum of their ends, each decayed, as
    far back as a double can show. So a row costs constant work, and a long series is many
    tasks. Rows with a null value are left out.
    """
    rows = numbered(df.filter(F.col(column).isNotNull()), key, order, "_pos")
    rows = rows.withColumn("_block", F.floor(F.col("_pos") / BLOCK)).withColumn("_k", F.col("_pos") % BLOCK)
    w = Window.partitionBy(*key, "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)  # BLOCK rows
    x = F.col(column).cast("double")
    keep = {s: 1 - 2.0 / (s + 1) for s in spans}
    for s, k in keep.items():
        rows = rows.withColumn(f"_s{s}", x if k <= 0 else F.pow(F.lit(k), F.col("_k")) * F.sum(x * F.pow(F.lit(1 / k), F.col("_k"))).over(w))
    rows = rows.checkpoint()
    far = max([1, *(math.ceil(FADED / (-math.log(k) * BLOCK)) for k in keep.values() if k > 0)])
    ends = rows.filter(F.col("_k") == BLOCK - 1).select(*key, "_block", *[f"_s{s}" for s in spans], F.explode(F.sequence(F.lit(1), F.lit(far))).alias("_d"))
    sums = [F.sum(F.col(f"_s{s}") * F.pow(F.lit(max(k, 0.0)), BLOCK * (F.col("_d") - 1))).alias(f"_c{s}") for s, k in keep.items()]
    carried = ends.groupBy(*[F.col(c).alias(f"_k_{c}") for c in key], (F.col("_block") + F.col("_d")).alias("_at")).agg(*sums)
    same = F.col("_block") == F.col("_at")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    met = rows.join(carried, same, "left")
    mean = lambda s, k: x if k <= 0 else (F.col(f"_s{s}") + F.pow(F.lit(k), F.col("_k") + 1) * F.coalesce(f"_c{s}", F.lit(0.0))) * (1 - k) / (1 - F.pow(F.lit(k), F.col("_pos") + 1))
    return met.select(*df.columns, *[mean(s, k).alias(f"ewm_{s}") for s, k in keep.items()])
