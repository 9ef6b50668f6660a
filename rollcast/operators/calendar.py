"""Regular calendars, limited interpolation, calendar cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import known, numbered

KEYS = ("series_id",)


def complete(df: DataFrame, time: str, step, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every step between a series' first and last time, missing rows with null variables.
    step: 1 for whole numbers, or an interval expression for dates and timestamps. A repeated
    time raises an error when it is read."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    grid = ends.select(*keys, F.explode(F.sequence("__a", "__b", F.lit(step) if isinstance(step, int) else F.expr(step))).alias(time))
    once = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, time)))
    once = once.withColumn(time, F.when(F.col("__n") == 1, F.col(time)).otherwise(F.raise_error(F.lit(f"repeated {time}")).cast(dict(df.dtypes)[time]))).drop("__n")
    return grid.join(once, [*keys, time], "left")


def interpolate(df: DataFrame, variables: Sequence[str], limit: int | None, order: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear interpolation along `order`, a whole number of steps on a complete grid. A null
    is filled if a value stands at most `limit` steps away on either side; ends take the
    nearest value; the middle of longer gaps stays null. No limit: all is filled."""
    at, columns = F.col(order), df.columns
    df = known(df, keys, order, {f"__{v}": F.when(F.col(v).isNotNull(), F.struct(at.alias("t"), F.col(v).cast("double").alias("v"))) for v in variables})
    for v in variables:
        df = df.withColumns({"__p": F.col(f"__{v}_before"), "__q": F.col(f"__{v}_after")})
        near = F.lit(True) if limit is None else F.coalesce(at - F.col("__p.t") <= limit, F.lit(False)) | F.coalesce(F.col("__q.t") - at <= limit, F.lit(False))
        line = F.col("__p.v") + (F.col("__q.v") - F.col("__p.v")) * (at - F.col("__p.t")) / (F.col("__q.t") - F.col("__p.t"))
        filled = F.coalesce(F.when(F.col("__p").isNotNull() & F.col("__q").isNotNull() & (F.col("__p.t") < F.col("__q.t")), line), F.col("__p.v"), F.col("__q.v"))
        df = df.withColumn(v, F.when(F.col(v).isNotNull(), F.col(v).cast("double")).when(near, filled)).drop("__p", "__q")
    return df.select(*columns)


def drop_incomplete(df: DataFrame, variables: Sequence[str], order: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows with all variables, with t numbered anew: long gaps vanish."""
    return numbered(df.dropna(subset=list(variables)).drop("t"), keys, order, "t")


def first_years(df: DataFrame, years: int | None, date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows before a series' first date plus so many calendar years; None keeps all."""
    if years is None:
        return df
    end = F.min(date).over(Window.partitionBy(*keys)) + F.make_interval(F.lit(years))
    return df.withColumn("__end", end).where(F.col(date) < F.col("__end")).drop("__end")


def regularise(df: DataFrame, variables: Sequence[str], *, limit: int | None = 6, years: int | None = None) -> DataFrame:
    """An hourly table (series_id, date, variables) as a series: complete hours, limited
    interpolation, complete rows only, the first years, t numbered in order."""
    hour = F.floor(F.unix_timestamp(F.col("date").cast("timestamp")) / 3600).cast("long")
    whole = complete(df.select("series_id", hour.alias("h"), *variables), "h", 1)
    whole = interpolate(whole, variables, limit, "h")
    whole = whole.withColumn("date", F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz"))
    return drop_incomplete(first_years(whole.dropna(subset=list(variables)), years), variables, "h").select("series_id", "t", "date", *variables)
