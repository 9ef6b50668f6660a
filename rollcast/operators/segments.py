"""Contiguous significant intervals and seasonal summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, season
from ..functions.tables import settle
from .ranges import running

BY = ("series_id", "feature")


def islands(scores: DataFrame, by: Sequence[str] = BY, flag: str = "sig", date: str = "date_src") -> DataFrame:
    """Rows of maximal runs of true flags, with the run's number `island`. Runs are of adjacent
    rows, not of adjacent dates; rows without a date are passed over, null flags are false."""
    d = settle(scores.dropna(subset=[date]).withColumn("__f", F.coalesce(flag, F.lit(False))))  # read twice
    # a run's number: how many rows before it are not flagged
    d = running(d, by, date, {"island": F.when(F.col("__f"), 0).otherwise(1).cast("long")})
    return d.where("__f").drop("__f")


def intervals(scores: DataFrame, by: Sequence[str] = BY, flag: str = "sig", date: str = "date_src", value: str = "g") -> DataFrame:
    """(by, start_date, end_date, n, mean, median, min, max) of each significant interval."""
    d = islands(scores, by, flag, date)
    return d.groupBy(*by, "island").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
    ).drop("island")


def by_season(scores: DataFrame, by: Sequence[str] = BY, flag: str = "sig", date: str = "date_src", value: str = "g") -> DataFrame:
    """Over finite scores of each season: timepoints, significant ones and their share, median
    sign, mean score of all and of the significant ones."""
    d = scores.withColumn("season", season(F.col(date))).withColumn("__v", finite(F.col(value))).where("__v is not null").withColumn("__f", F.coalesce(flag, F.lit(False)))
    return d.groupBy(*by, "season").agg(
        F.count(F.lit(1)).alias("n_timepoints"), F.count_if("__f").alias("n_significant"), F.avg(F.col("__f").cast("double")).alias("prop_significant"),
        F.median(F.signum("__v")).alias("median_sign_all"), F.avg("__v").alias("mean_contribution_all"), F.avg(F.when(F.col("__f"), F.col("__v"))).alias("mean_contribution_significant"),
    )
