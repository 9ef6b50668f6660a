"""The three analyses: the synthetic system, a daily series, an hourly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAILY_LAGS, HOURLY_LAGS
from ..operators import ablation, align, describe, fdr, forecast, nulls, rolling, segments
from ..sources.synthetic import synthetic


def attribution(spark: SparkSession, aligned: DataFrame, features: Sequence[str], *, window: int, replicates: int, period: int, n: int, step: int = 1, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Rolling scores with envelope, p-value and pointwise flag; n: rows of the aligned series."""
    observed = rolling.scores(aligned, features, window, step)
    shifts = nulls.periodic_shifts(n, replicates, period, seed) if replicates else []
    if not shifts:
        return observed.withColumns({c: F.lit(None).cast("double") for c in ("lo", "hi", "p")}).withColumn("sig", F.lit(False))
    return fdr.pointwise(nulls.series_envelope(spark, aligned, observed, features, window, shifts), alpha)


def tables(series: DataFrame, variables: Sequence[str], lags, raw: DataFrame | None = None) -> dict[str, DataFrame]:
    return {
        "overview": describe.overview(series, variables, raw), "primary": describe.primary(series, variables), "seasonal": describe.seasonal(series, variables),
        "autocorr": describe.autocorrelation(series, variables, lags), "crosscorr": describe.crosscorrelation(series, variables),
    }


def synthetic_pipeline(spark: SparkSession, n: int = 900, seed: int = 0, window: int = 90, replicates: int = 1000, period: int = 7) -> dict[str, DataFrame]:
    """The forecast is the known noise-free signal, so the scores must follow the coefficients."""
    s = synthetic(spark, n, seed)
    preds = s.select("series_id", F.col("t").alias("t_pred"), F.col("y").alias("obs"), F.col("deterministic_signal").alias("pred"))
    aligned = align.by_source_time(s, preds, ["x1", "x2"], 1)
    scores = attribution(spark, aligned, ["x1", "x2"], window=window, replicates=replicates, period=period, n=n - 1, seed=seed)
    return {
        **tables(s, ["y", "x1", "x2"], DAILY_LAGS), "snr": describe.design_snr(s, "x1", "x2", "y", "deterministic_signal", "noise"), "scores": scores,
        "recovery": describe.recovery(scores, s, {"x1": "true_alpha", "x2": "true_beta"}), "seasons": segments.by_season(scores), "intervals": segments.intervals(scores),
    }


def series_pipeline(spark: SparkSession, series: DataFrame, target: str, features: Sequence[str], *, model_features: Sequence[str] | None = None, tps=(1, 3, 7, 14), window: int = 90, replicates: int = 1000, period: int = 7, step: int = 1, lags=None, fraction: float = 0.2, seed: int = 0, ablate: str | None = None) -> dict[str, DataFrame]:
    """Tables, forecasts by horizon, scores of in-sample forecasts, intervals, seasons, agreement
    with the map's coefficients and, for the feature `ablate`, the ablation. The model may
    have more features than are attributed. `series` holds one series; a cached or stored one
    is read several times."""
    model = list(model_features or features)
    n = series.count()
    metrics, preds, params = forecast.horizons(series, target, model, tps, fraction=fraction)
    tp = tps[0]
    first = params.where(params["tp"] == tp)
    full = forecast.full_series(series, target, model, "theta_mv", tp, params=first.drop("tp"))
    aligned = align.by_source_time(series, full, features, tp)
    scores = attribution(spark, aligned, features, window=window, replicates=replicates, period=period, n=n, step=step, seed=seed)
    out = {
        **tables(series, [target, *model], lags or DAILY_LAGS), "metrics": metrics, "predictions": preds, "scores": scores, "intervals": segments.intervals(scores), "seasons": segments.by_season(scores),
        "agreement": forecast.coefficient_agreement(scores, forecast.coefficients(full, [target, *model])),
    }
    if ablate:
        theta = first.first()["theta_mv"]  # of the one series
        picked = ablation.groups(scores, ablate, n - 1, 60, seed=seed)
        errors = ablation.permuted_errors(series, picked, target, features, ablate, window=window, theta=theta, seed=seed)
        out |= {"ablation": errors, "ablation_summary": ablation.summary(errors), "ablation_effect": ablation.effect(errors)}
    return out


def daily_pipeline(spark: SparkSession, series: DataFrame, target: str, features: Sequence[str], **options) -> dict[str, DataFrame]:
    return series_pipeline(spark, series, target, features, **{"ablate": features[0], "lags": DAILY_LAGS, **options})


def hourly_pipeline(spark: SparkSession, series: DataFrame, target: str, features: Sequence[str], **options) -> dict[str, DataFrame]:
    return series_pipeline(spark, series, target, features, **{"tps": (1, 6, 24, 72), "window": 24 * 28, "replicates": 400, "period": 168, "lags": HOURLY_LAGS, **options})
