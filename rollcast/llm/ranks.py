"""Distributed ranks within groups of any size.

A group's rows are dealt to cells by a hash, cells are counted with map-side combining,
and a row's rank is its cell's offset plus its row number in the cell. A group that holds
a third of all rows is spread over CELLS tasks like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 1024


def ranked(df: DataFrame, group: list[str], point: Column, order: list, name: str = "rank", cells: int = CELLS) -> DataFrame:
    """`df` with a gapless 0-based rank in each group, in order of (point, *order). `point`
    is a non-negative 63-bit hash of the row; rows that tie on everything get adjacent
    ranks in some order. Groups compare null-safe."""
    width = (1 << 63) // cells
    d = df.withColumn("__p", point).withColumn("__cell", F.floor(F.col("__p") / F.lit(width)).cast("int"))
    # a double quotient may round up at the top of the range
    d = d.withColumn("__cell", F.least("__cell", F.lit(cells - 1)))
    counts = d.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    for g in [*group, "__cell"]:
        counts = counts.withColumnRenamed(g, f"__k_{g}")
    own = Window.partitionBy(*group, "__cell").orderBy("__p", *order)
    d = d.withColumn("__r", F.row_number().over(own) - 1)
    on = [d[g].eqNullSafe(counts[f"__k_{g}"]) for g in [*group, "__cell"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = d.join(counts, cond).withColumn(name, F.col("__from") + F.col("__r"))
    return out.drop("__p", "__cell", "__from", "__r", *[f"__k_{g}" for g in [*group, "__cell"]])


def by_range(stash, df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with a gapless 0-based rank over all rows, in `order`, which should tell any two rows
    apart: a range exchange deals and sorts them, and a row's rank is its place in its
    partition behind the sizes of those before. The ranges are written, so that
    both passes see the same ones; one row a partition is summed in one task."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    dealt = stash.put(dealt, "ranges")
    part = F.shiftright("__m", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    out = dealt.withColumn("__part", part).join(F.broadcast(sizes), "__part")  # a row a partition
    return out.withColumn(name, F.col("__from") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__part", "__m", "__from")


def hash63(*cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)
