"""Descriptive statistics of series: one aggregation over long rows each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, season, season_order
from ..functions.stats import kurtosis, safe_corr, skewness
from .align import long

KEYS = ("series_id",)


def _long(df: DataFrame, variables: Sequence[str], keep: Sequence[str]) -> DataFrame:
    d = long(df, variables, keep)
    return d.withColumnRenamed("feature", "variable").withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))


def primary(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, moments and quantiles of each variable. The sample deviation needs two values,
    skewness three, kurtosis four; they are null below that."""
    x = F.col("x")
    return _long(df, variables, keys).groupBy(*keys, "variable").agg(
        F.count(F.lit(1)).alias("n_total"), F.count(x).alias("n_nonmissing"), F.count_if(x.isNull()).alias("n_missing"), F.count_if(x == 0).alias("n_zero"),
        F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("sd"), F.min(x).alias("min"), F.median(x).alias("median"), F.max(x).alias("max"),
        skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"),
    )


def overview(df: DataFrame, variables: Sequence[str], raw: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Used and raw date ranges, rows used, raw rows, missing raw values and zeros used. A
    variable that the raw table lacks has null raw counts."""
    raw = df if raw is None else raw
    x = F.col("x")
    used = _long(df, variables, [*keys, "date"]).groupBy(*keys, "variable").agg(F.min("date").alias("time_start"), F.max("date").alias("time_end"), F.count(x).alias("n_used"), F.count_if(x == 0).alias("zero_used"))
    there = [v for v in variables if v in raw.columns]
    ends = raw.groupBy(*keys).agg(F.min("date").alias("raw_start"), F.max("date").alias("raw_end"))
    out = used.join(ends, list(keys), "left")
    if there:
        counts = _long(raw, there, [*keys, "date"]).groupBy(*keys, "variable").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(x.isNull()).alias("missing_raw"))
        return out.join(counts, [*keys, "variable"], "left")
    return out.withColumn("n_raw", F.lit(None).cast("long")).withColumn("missing_raw", F.lit(None).cast("long"))


def seasonal(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Moments by season, with season_order for sorting (DJF first)."""
    x = F.col("x")
    d = _long(df.withColumn("season", season(F.col("date"))), variables, [*keys, "season"])
    out = d.groupBy(*keys, "variable", "season").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("sd"), F.median(x).alias("median"), skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis")
    )
    return out.withColumn("season_order", season_order(F.col("season")))


def autocorrelation(df: DataFrame, variables: Sequence[str], lags: Mapping[str, int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of each variable with itself `lag` rows before, and the pairs it is from; a
    lag of 0 or beyond the series has 0 pairs and no correlation. t numbers the rows."""
    d = _long(df, variables, [*keys, "t"])
    names = df.sparkSession.createDataFrame([(k, int(v)) for k, v in lags.items()], "lag string, lag_steps long")
    all_lags = d.select(*keys, "variable").distinct().join(F.broadcast(names))
    later = d.join(F.broadcast(names.where("lag_steps > 0"))).select(*keys, "variable", "lag", (F.col("t") - F.col("lag_steps")).alias("t"), F.col("x").alias("a"))
    pairs = later.join(d.withColumnRenamed("x", "b"), [*keys, "variable", "t"])
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    r = pairs.groupBy(*keys, "variable", "lag").agg(F.count_if(ok).alias("n_pairs"), safe_corr(F.col("a"), F.col("b")).alias("autocorr"))
    return all_lags.join(r, [*keys, "variable", "lag"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def crosscorrelation(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairwise complete correlations of all ordered pairs of variables, from one aggregation."""
    cols = [finite(F.col(v)).alias(v) for v in variables]
    pairs = [(a, b) for a in variables for b in variables]
    wide = df.select(*keys, *cols).groupBy(*keys).agg(*[safe_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def design_snr(df: DataFrame, x1: str, x2: str, y: str, signal: str, noise: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of the drivers, population variances of signal and noise, their ratio, and the
    correlation of the target with the signal."""
    c = F.col
    s, n = F.var_pop(signal), F.var_pop(noise)
    return df.groupBy(*keys).agg(
        safe_corr(c(x1), c(x2)).alias("corr_x1_x2"), s.alias("signal_variance"), n.alias("noise_variance"), F.try_divide(s, n).alias("snr"), safe_corr(c(y), c(signal)).alias("corr_y_signal")
    )


def recovery(scores: DataFrame, truth: DataFrame, pairs: Mapping[str, str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, feature, corr_with_truth): each feature's score against its known coefficient, a
    column of the series `truth`, at the source time."""
    known = long(truth.withColumnRenamed("t", "t_src"), list(pairs.values()), [*keys, "t_src"])
    back = F.create_map(*[F.lit(x) for f, c in pairs.items() for x in (c, f)])
    known = known.select(*keys, "t_src", back[F.col("feature")].alias("feature"), F.col("x").alias("coefficient"))
    d = scores.join(known, [*keys, "feature", "t_src"], "left")
    return d.groupBy(*keys, "feature").agg(safe_corr(F.col("g"), F.col("coefficient")).alias("corr_with_truth"))
