"""Ordered operations on one long series in many tasks.

A series is cut into ranges of its order column: whole numbers and dates by SIZE steps,
times by SIZE minutes. What runs along a series (numbers, sums, the last known value) is
worked out in each range, and one row a range carries it on, so no window holds a series,
and the window over the ranges has one row for up to SIZE rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE = 1 << 16


def range_of(df: DataFrame, order: str, size: int | None = None) -> Column:
    """The range of a row by its order column."""
    kind, size = df.schema[order].dataType.typeName(), size or SIZE
    if kind == "date":
        at = F.unix_date(order).cast("long")
    elif kind in ("timestamp", "timestamp_ntz"):
        at = F.floor(F.unix_micros(F.col(order).cast("timestamp")) / 60_000_000)
    else:
        at = F.col(order)
    return F.floor(at / size).cast("long")


def _carry(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` with what `totals` has for its (keys, __r); null keys are equal."""
    on = [*keys, "__r"]
    named = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[c for c in totals.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(on)]
    return df.join(named, cond, "left").drop(*[f"__k{i}" for i in range(len(on))])


def running(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], size: int | None = None, cell: Column | None = None) -> DataFrame:
    """`df` with, for each name of `values`, the sum of that whole-number column over the rows of
    its series up to each row. `order` tells the rows of a series apart. `cell` is the range
    where the order column gives none, and must not fall along it."""
    d = df.withColumn("__r", range_of(df, order, size) if cell is None else cell).withColumns({f"__v{n}": v for n, v in values.items()})
    totals = d.groupBy(*keys, "__r").agg(*[F.sum(f"__v{n}").alias(f"__s{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__r", *[F.coalesce(F.sum(f"__s{n}").over(before), F.lit(0)).alias(f"__b{n}") for n in values])
    inner = Window.partitionBy(*keys, "__r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__s{n}": F.sum(f"__v{n}").over(inner) for n in values})
    d = _carry(d, totals, keys).withColumns({n: F.col(f"__b{n}") + F.col(f"__s{n}") for n in values})
    return d.drop("__r", *[f"__{a}{n}" for a in "vsb" for n in values])


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str = "i", size: int | None = None) -> DataFrame:
    """`df` with row numbers from 1 in each series, in order."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, size)


def known(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], size: int | None = None) -> DataFrame:
    """`df` with, for each name of `values`, <name>_before and <name>_after: the nearest value that
    is not null at the row or before it, and at the row or behind it."""
    d = df.withColumn("__r", range_of(df, order, size)).withColumns({f"__v{n}": v for n, v in values.items()})
    ends = {}
    for n in values:
        there = F.col(f"__v{n}").isNotNull()
        ends |= {f"__l{n}": F.max_by(f"__v{n}", F.when(there, F.col(order))), f"__f{n}": F.min_by(f"__v{n}", F.when(there, F.col(order)))}
    totals = d.groupBy(*keys, "__r").agg(*[e.alias(n) for n, e in ends.items()])
    at = Window.partitionBy(*keys).orderBy("__r")
    behind, ahead = at.rowsBetween(Window.unboundedPreceding, -1), at.rowsBetween(1, Window.unboundedFollowing)
    totals = totals.select(*keys, "__r", *[F.last(f"__l{n}", True).over(behind).alias(f"__p{n}") for n in values], *[F.first(f"__f{n}", True).over(ahead).alias(f"__q{n}") for n in values])
    inner = Window.partitionBy(*keys, "__r").orderBy(order)
    up, down = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({f"__l{n}": F.last(f"__v{n}", True).over(up) for n in values} | {f"__f{n}": F.first(f"__v{n}", True).over(down) for n in values})
    d = _carry(d, totals, keys)
    d = d.withColumns({f"{n}_before": F.coalesce(f"__l{n}", f"__p{n}") for n in values} | {f"{n}_after": F.coalesce(f"__f{n}", f"__q{n}") for n in values})
    return d.drop("__r", *[f"__{a}{n}" for a in "vlfpq" for n in values])


def spread(df: DataFrame, before: int, after: int, size: int | None = None, order: str = "t", name: str = "block") -> DataFrame:
    """`df` with `block`, ranges of `size` rows by a gapless row number; the `before` rows ahead of
    a range and the `after` behind it stand in it too, with `inside` false. Windows by (keys,
    block) then see what windows over a whole series would."""
    size = size or SIZE
    first, last = F.floor((F.col(order) - after) / size), F.floor((F.col(order) + before) / size)
    d = df.withColumn(name, F.explode(F.sequence(first, last)))
    return d.withColumn("inside", F.floor(F.col(order) / size) == F.col(name))
