"""Alignment of features x(t) with forecasts of t + tp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("series_id",)


def by_source_time(series: DataFrame, preds: DataFrame, features: Sequence[str], tp: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_src, date_src, t_pred, obs, pred, features): forecasts without a value go, and
    each other one joins the row it was made from."""
    have = [c for c in ("obs",) if c in preds.columns]
    p = preds.dropna(subset=["t_pred", "pred"]).select(*keys, "t_pred", (F.col("t_pred") - tp).alias("t_src"), *have, "pred")
    x = series.select(*keys, F.col("t").alias("t_src"), F.col("date").alias("date_src"), *features)
    return p.join(x, [*keys, "t_src"]).dropna(subset=["date_src"]).select(*keys, "t_src", "date_src", "t_pred", *have, "pred", *features)


def by_prediction_time(series: DataFrame, preds: DataFrame, features: Sequence[str], tp: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """As by_source_time on the forecast's time axis: forecasts without a value stay, and a
    time that occurs twice on either side raises an error when it is read."""

    def once(df: DataFrame, t: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys, t))
        return df.withColumn("__n", n).withColumn(t, F.when(F.col("__n") == 1, F.col(t)).otherwise(F.raise_error(F.lit(f"repeated {t}")).cast("long"))).drop("__n")

    p = once(preds, "t_pred").select(*keys, "t_pred", "pred")
    x = once(series, "t").select(*keys, F.col("t").alias("t_src"), (F.col("t") + tp).alias("t_pred"), *features)
    return x.join(p, [*keys, "t_pred"]).select(*keys, "t_src", "t_pred", "pred", *features)


def with_dates(preds: DataFrame, series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Forecasts with the date of t_pred; times beyond the series have none."""
    return preds.join(series.select(*keys, F.col("t").alias("t_pred"), F.col("date").alias("date_pred")), [*keys, "t_pred"], "left")


def long(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row a feature: (keep, feature, x)."""
    return df.unpivot(list(keep), [F.col(f).cast("double").alias(f) for f in features], "feature", "x")


def wide(df: DataFrame, value: str, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One column a feature, for sinks."""
    return df.groupBy(*keep).pivot("feature", list(features)).agg(F.first(value))


def truth(scores: DataFrame, series: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Scores (t_src) with known coefficients of the series, suffixed _truth where names clash."""
    named = [F.col(c).alias(f"{c}_truth" if c in scores.columns else c) for c in columns]
    return scores.join(series.select(*keys, F.col("t").alias("t_src"), *named), [*keys, "t_src"], "left")
