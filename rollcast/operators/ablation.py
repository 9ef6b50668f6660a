"""Ablation: how much worse a one-step forecast gets when one feature is permuted, where its
score is high against where it is low."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from ..functions.scalar import finite
from ..functions.tables import settle
from . import effects

HIGH, LOW = "high_abs_contribution", "low_abs_contribution"


def groups(scores: DataFrame, feature: str, last_t: int, k: int, *, high_q: float = 0.75, low_q: float = 0.25, seed: int = 0) -> DataFrame:
    """(series_id, grp, t_src, date_src, abs_g): up to k source times of each group, as many in
    both, by a seeded order among those whose |score| is in the top or bottom quantile."""
    d = settle(scores.where(F.col("feature") == feature))  # read several times
    d = d.withColumn("abs_g", F.abs(finite(F.col("g")))).where((F.col("abs_g").isNotNull()) & (F.col("t_src") <= last_t))
    q = d.groupBy("series_id").agg(F.percentile("abs_g", F.array(F.lit(high_q), F.lit(low_q))).alias("q"))
    d = d.join(q, "series_id")
    d = d.where(F.col("abs_g") >= F.col("q")[0]).withColumn("grp", F.lit(HIGH)).unionByName(d.where(F.col("abs_g") <= F.col("q")[1]).withColumn("grp", F.lit(LOW)))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("series_id", "grp").orderBy(F.xxhash64("t_src", F.lit(seed)), "t_src")))
    n = d.groupBy("series_id").agg(F.count_if(F.col("grp") == HIGH).alias("h"), F.count_if(F.col("grp") == LOW).alias("w"))
    return d.join(n, "series_id").where(F.col("r") <= F.least(F.lit(k), "h", "w")).select("series_id", "grp", "t_src", "date_src", "abs_g")


def window_plus_next(series: DataFrame, ends: DataFrame, window: int) -> DataFrame:
    """Rows of `series` in each window of `window` rows that ends at t_src, and the next one;
    ends without a whole window or a next row have none."""
    s = series.withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("t")))
    at = ends.join(s.select("series_id", F.col("t").alias("t_src"), F.col("i").alias("end")), ["series_id", "t_src"])
    at = at.withColumn("i", F.explode(F.sequence(F.col("end") - (window - 1), F.col("end") + 1)))
    d = at.join(s, ["series_id", "i"]).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("series_id", "grp", "t_src")))
    return d.where(F.col("__n") == window + 1).drop("__n", "end")


def permuted_errors(series: DataFrame, picked: DataFrame, target: str, features: Sequence[str], feature: str, *, window: int = 90, theta: float = 0.0, repeats: int = 5, seed: int = 0) -> DataFrame:
    """A row a picked time with absolute and squared errors of the endpoint forecast as it is
    and, on average, with `feature` permuted inside the window's source rows. A generator
    per (time, repeat) makes results independent of order."""
    d = window_plus_next(series, picked, window).select("series_id", "grp", "t_src", "date_src", "abs_g", "i", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([target, *features])])
    cols = [target, *features]
    at = cols.index(feature)

    def one(key, pdf):
        pdf = pdf.sort_values("i")
        states, nexts = pdf[cols].to_numpy(float)[:window], pdf[target].to_numpy(float)[1:]
        variants = np.repeat(states[None], repeats + 1, 0)  # as it is, then permuted
        for r in range(repeats):
            variants[r + 1, :, at] = np.random.default_rng([seed, int(key[2]), r]).permutation(states[:, at])
        obs, forecasts = kernels.endpoint(variants, nexts, theta)
        p, errors = forecasts[0], forecasts[1:] - obs
        errors = errors[np.isfinite(errors)]
        if not np.isfinite(p - obs) or not len(errors):
            return pd.DataFrame(columns=out)
        ae, se, pae, pse = abs(p - obs), (p - obs) ** 2, np.abs(errors).mean(), (errors**2).mean()
        return pd.DataFrame([(*key, pdf["date_src"].iloc[0], pdf["abs_g"].iloc[0], ae, pae, pae - ae, se, pse, pse - se, len(errors))], columns=out)

    out = ["series_id", "grp", "t_src", "date_src", "abs_g", "ae_original", "ae_permuted_mean", "delta_ae", "se_original", "se_permuted_mean", "delta_se", "n_permutations"]
    date = dict(picked.dtypes)["date_src"]
    schema = f"series_id string, grp string, t_src long, date_src {date}, abs_g double, ae_original double, ae_permuted_mean double, delta_ae double, se_original double, se_permuted_mean double, delta_se double, n_permutations int"
    return d.groupBy("series_id", "grp", "t_src").applyInPandas(one, schema)


def summary(errors: DataFrame) -> DataFrame:
    """Moments of the error increase by group."""
    return errors.groupBy("series_id", "grp").agg(
        F.avg("delta_ae").alias("mean_delta_ae"), F.stddev_samp("delta_ae").alias("sd_delta_ae"), F.median("delta_ae").alias("median_delta_ae"),
        F.avg("delta_se").alias("mean_delta_se"), F.median("abs_g").alias("median_abs_g"), F.count("delta_ae").alias("n"),
    )


def effect(errors: DataFrame, b: int = 3000, seed: int = 1) -> DataFrame:
    """Difference of mean increases, high less low, its bootstrap interval, and Cliff's delta."""
    v = errors.select(F.when(F.col("grp") == HIGH, 1).otherwise(0).alias("grp"), "t_src", F.col("delta_ae").alias("v"))
    v = v.withColumn("idx", (F.row_number().over(Window.partitionBy("grp").orderBy("t_src")) - 1).cast("long"))
    v = settle(v)  # a row a picked time
    sizes = v.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    ci = effects.bootstrap_difference(v.select("grp", "idx", "v"), effects.counter_indices(errors.sparkSession, sizes, b, seed))
    return ci.join(effects.cliffs_delta(v, "v", F.col("grp") == 1, F.col("grp") == 0))
