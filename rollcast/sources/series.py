"""Series tables: (series_id, t, date, variables...), one row a time step.

Every builder returns long-lived conventions: series_id is a string, t a 1-based BIGINT,
date a DATE or TIMESTAMP_NTZ, variables DOUBLE, and missing values null."""

from __future__ import annotations

import os
import shutil
import urllib.request
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import finite, timestamp_of


def fetch(sources: Sequence[str], dest: str) -> str:
    """A driver-side cache of one file: `dest` if it is there and not empty, else the first
    source (URL or local path) that can be read. Raises the last error if none can."""
    if os.path.exists(dest) and os.path.getsize(dest) > 0:
        return dest
    error: Exception = FileNotFoundError("no source given")
    for s in sources:
        try:
            os.makedirs(os.path.dirname(os.path.abspath(dest)), exist_ok=True)
            if os.path.exists(s):
                shutil.copyfile(s, dest)
            else:
                with urllib.request.urlopen(s, timeout=60) as r, open(dest, "wb") as f:
                    shutil.copyfileobj(r, f)
            return dest
        except Exception as e:  # noqa: BLE001 the next mirror is tried
            error = e
    raise error


def unzip(path: str, member: str, folder: str) -> str:
    """The member of a zip file as a file in `folder`."""
    with zipfile.ZipFile(path) as z:
        return z.extract(member, folder)


def number(df: DataFrame, order: str = "date", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """t = 1, 2, ... in order of date: gaps vanish."""
    return df.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))


def number_by_calendar(df: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """t = days since the series' first date + 1: gaps stay."""
    return df.withColumn("t", (F.datediff("date", F.min("date").over(Window.partitionBy(*keys))) + 1).cast("long"))


def daily_csv(spark: SparkSession, path: str, date_col: str, variables: Sequence[str], *, time_index: str = "ordinal", series_id: str = "all") -> tuple[DataFrame, DataFrame]:
    """(series, raw) of a daily CSV file with a header: the date column and the variables, and
    the unprojected table with the date as `date`."""
    raw = spark.read.csv(path, header=True, inferSchema=False).withColumnRenamed(date_col, "date").withColumn("date", F.to_date("date"))
    s = raw.select(F.lit(series_id).alias("series_id"), "date", *[finite(F.expr(f"try_cast(`{v}` as double)")).alias(v) for v in variables])
    s = number(s) if time_index == "ordinal" else number_by_calendar(s)
    return s.select("series_id", "t", "date", *variables), raw


def hourly_csv(spark: SparkSession, path: str, variables: Sequence[str], *, parts: Sequence[str] = ("year", "month", "day", "hour"), null_value: str = "NA", series_id: str = "all") -> DataFrame:
    """(series_id, date, variables) of an hourly CSV file whose time is in four columns.
    `operators.calendar.regularise` makes it a series."""
    raw = spark.read.csv(path, header=True, nullValue=null_value)
    ts = timestamp_of(*[F.col(p).cast("int") for p in parts])
    return raw.select(F.lit(series_id).alias("series_id"), ts.alias("date"), *[finite(F.expr(f"try_cast(`{v}` as double)")).alias(v) for v in variables])


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table that a sink wrote."""
    return spark.read.csv(path, header=True, inferSchema=True)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue y and mean discount x1, quantity x2 and tax x3 of the shipped lines."""
    s = _table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_extendedprice").alias("y"), F.avg("l_discount").alias("x1"), F.avg("l_quantity").alias("x2"), F.avg("l_tax").alias("x3")
    )
    return number(s.where("date is not null").withColumn("series_id", F.lit("all"))).select("series_id", "t", "date", "y", "x1", "x2", "x3")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, y, n) by order day; days without orders are missing."""
    s = _table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("y"), F.count(F.lit(1)).alias("n"))
    return s.where("date is not null").select(F.lit("all").alias("series_id"), "date", "y", "n")


def hour_index(ts) -> F.Column:
    """Whole hours since 1970 of a timestamp without a zone."""
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / 3600).cast("long")


def hourly_events(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """(series_id, h, y, n): sum of values and count of events by hour since 1970, of all
    events or of each value of column `by`. Hours without events are missing."""
    e = _table(spark, sf_dir, "events").where("ts is not null")
    key = F.lit("all") if by is None else F.coalesce(F.col(by).cast("string"), F.lit(""))
    return e.groupBy(key.alias("series_id"), hour_index(F.col("ts")).alias("h")).agg(F.sum("value").alias("y"), F.count(F.lit(1)).alias("n"))
