"""Benjamini-Hochberg control of the false discovery rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import settle
from .ranges import running

CELLS = 4096  # ranges of p-values for each halving


def benjamini_hochberg(df: DataFrame, over: Sequence[str], alpha: float = 0.05, p: str = "p", name: str = "sig", count_missing: bool = False) -> DataFrame:
    """`df` with the flag `name`: among the p-values of one family (equal columns `over`) all
    up to the largest p(k) <= alpha k / m are rejected. Null p-values are not; they count
    in m only if count_missing. A family may have any size: ranks come from ranges of its
    values. What is compared is read several times, so it is written first."""
    df = settle(df)
    names = [f"__o{i}" for i in range(len(over))]
    of = [F.col(c).alias(n) for c, n in zip(over, names)]
    # the rank of a value is the number of p-values up to it, so equal ones are one row
    values = df.groupBy(*of, F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(values.where("__p is not null"), names, "__p", {"__k": F.col("__n")}, cell=_cell(F.col("__p")))
    m = values.groupBy(*names).agg(F.sum("__n" if count_missing else F.when(F.col("__p").isNotNull(), F.col("__n"))).alias("__m"))
    same = lambda a, b: [a[n].eqNullSafe(b[n]) for n in names]
    reached = ranked.join(m, same(ranked, m)).where(F.col("__p") <= F.lit(alpha) * F.col("__k") / F.col("__m"))
    cut = reached.groupBy(*[ranked[n].alias(f"{n}c") for n in names]).agg(F.max("__p").alias("__cut"))
    d = df.join(cut, [F.col(c).eqNullSafe(F.col(f"{n}c")) for c, n in zip(over, names)], "left")
    return d.withColumn(name, F.coalesce(F.col(p) <= F.col("__cut"), F.lit(False))).drop("__cut", *[f"{n}c" for n in names])


def _cell(p):
    """Ranges of p-values that get finer towards 0."""
    return F.when(p <= 0, F.lit(-(1 << 40))).otherwise(F.floor(F.log2(p) * CELLS)).cast("long")


def pointwise(scores: DataFrame, alpha: float = 0.05, keys: Sequence[str] = ("series_id",), t: str = "t_src") -> DataFrame:
    """A family is all features of one time, few rows, which one window holds."""
    family = Window.partitionBy(*keys, t)
    d = scores.withColumns({"__k": F.row_number().over(family.orderBy(F.col("p").asc_nulls_last())), "__m": F.count("p").over(family)})
    d = d.withColumn("__cut", F.max(F.when(F.col("p") <= F.lit(alpha) * F.col("__k") / F.col("__m"), F.col("p"))).over(family))
    return d.withColumn("sig", F.coalesce(F.col("p") <= F.col("__cut"), F.lit(False))).drop("__k", "__m", "__cut")


def over_time(scores: DataFrame, alpha: float = 0.05, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """A family is all times of one feature."""
    return benjamini_hochberg(scores, [*keys, "feature"], alpha)
