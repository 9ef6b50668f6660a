"""Effect sizes: Cliff's delta, bootstrap intervals of a difference of means."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import finite


CELLS = 256  # ranges of values that are counted one by one


def cliffs_delta(df: DataFrame, value: str, high: Column, low: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_high, n_low, delta): share of pairs where a value of `high` is above one of `low`
    less the share where it is below. Values are counted first and compared by running
    counts in value order, so there are no pairs. Running counts are taken in CELLS ranges of
    values (cut at approximate percentiles), each a task, and over the ranges; null without
    values on either side."""
    d = df.select(*keys, finite(F.col(value)).alias("v"), high.cast("int").alias("h"), low.cast("int").alias("l")).where("v is not null")
    c = d.groupBy(*keys, "v").agg(F.sum(F.coalesce("h", F.lit(0))).alias("h"), F.sum(F.coalesce("l", F.lit(0))).alias("l"))
    edges = d.groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), 10_000).alias("edges"))
    c = c.join(edges, list(keys)) if keys else c.join(F.broadcast(edges))  # one row
    c = c.withColumn("cell", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    cells = c.groupBy(*keys, "cell").agg(F.sum("l").alias("n"))
    part = Window.partitionBy(*keys)  # CELLS rows a key
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(part.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(part)).drop("n")
    own = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("lt", F.coalesce(F.sum("l").over(own), F.lit(0))).join(cells, [*keys, "cell"]).withColumn("lt", F.col("lt") + F.col("before"))
    win = F.sum(F.col("h") * (F.col("lt") - (F.col("all") - F.col("lt") - F.col("l"))))
    return c.groupBy(*keys).agg(F.sum("h").alias("n_high"), F.sum("l").alias("n_low"), F.try_divide(win.cast("double"), F.sum("h").cast("double") * F.sum("l")).alias("delta"))


def generator_indices(spark: SparkSession, n_high: int, n_low: int, b: int, seed: int = 0) -> DataFrame:
    """(b, grp, idx): the resamples that a numpy generator draws, high before low each time. For
    bounded groups, such as an ablation's."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(b):
        rows += [(i, 1, int(x)) for x in rng.integers(0, n_high, n_high)]
        rows += [(i, 0, int(x)) for x in rng.integers(0, n_low, n_low)]
    return spark.createDataFrame(rows, "b int, grp int, idx long")


def counter_indices(spark: SparkSession, sizes: DataFrame, b: int, seed: int = 1) -> DataFrame:
    """(b, grp, idx) from sizes (grp, n; a few groups of any size): resamples from a counter-based
    generator, made on the executors, a range of slots a task. Draw s of resample b is a
    fixed function of both."""
    slots = None
    for r in sizes.collect():
        one = spark.range(r["n"]).select(F.lit(r["grp"]).alias("grp"), F.lit(r["n"]).alias("n"), F.col("id").alias("slot"))
        slots = one if slots is None else slots.unionByName(one)
    slots = sizes.limit(0).withColumn("slot", F.lit(0).cast("long")) if slots is None else slots
    reps = spark.range(b).select(F.col("id").alias("b"))
    x = (F.col("b") * 7919 + F.col("slot") * 104729 + F.col("grp") * 1299709 + seed) % 2147483647
    for step in (48271, 69621, 39373):  # three rounds of multiplicative congruence
        x = (x * step + 12345) % 2147483647
    return slots.join(F.broadcast(reps)).select("b", "grp", (x % F.col("n")).alias("idx"))


def bootstrap_difference(values: DataFrame, indices: DataFrame, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """(mean_difference, ci_low, ci_high) of mean(grp 1) - mean(grp 0) from values (grp, idx from
    0, v) and resamples (b, grp, idx): percentiles of the resampled differences."""
    m = indices.join(values, ["grp", "idx"]).groupBy("b", "grp").agg(F.avg("v").alias("m"))
    d = m.groupBy("b").agg((F.max(F.when(F.col("grp") == 1, F.col("m"))) - F.max(F.when(F.col("grp") == 0, F.col("m")))).alias("d"))
    q = d.agg(F.percentile("d", F.array(F.lit(lo), F.lit(hi))).alias("q"))
    mean = values.agg((F.avg(F.when(F.col("grp") == 1, F.col("v"))) - F.avg(F.when(F.col("grp") == 0, F.col("v")))).alias("mean_difference"))
    return mean.join(q).select("mean_difference", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
