"""Every operator as a query over the driver's tables, with DuckDB SQL where SQL can say it.

The daily series is revenue by ship day (y) with mean discount, quantity and tax (x1, x2, x3);
its default forecast is persistence, so at source time t the forecast of t + 1 is y(t). Both
sides round to fixed digits and add 0.0, so no result is a negative zero."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import THETA_GRID, AttributionConfig
from ..functions import scalar
from ..operators import ablation, align, calendar, describe, effects, fdr, forecast, nulls, report, rolling, segments, windowed
from ..sources import series as src
from ..sources.synthetic import synthetic

X = ["x1", "x2", "x3"]
W, R, PERIOD, ALPHA = 90, 20, 7, 0.2
REPLICATES = 1000  # of the `_whole` queries, which are too many for SQL
LAGS = {"day": 1, "week": 7, "month": 30, "decade": 3650}


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def text(c: str) -> Column:
    return F.col(c).cast("string")


def _daily(spark, sf) -> DataFrame:
    """One row a day whatever the table's size. Both sides of an alignment read it, with other
    columns, so it is kept: else the lines would be scanned and summed for each."""
    return src.daily_sales(spark, sf).cache()


def _aligned(spark, sf) -> DataFrame:
    d = _daily(spark, sf)
    return align.by_source_time(d, forecast.persistence(d, "y", 1, beyond=True), X, 1)


def _days(spark, sf) -> int:
    return _daily(spark, sf).count()


def _shifts(spark, sf, replicates: int = R) -> list[int]:
    return nulls.periodic_shifts(_days(spark, sf), replicates, PERIOD, 0)


def _observed(spark, sf, step: int = 1) -> DataFrame:
    return rolling.scores(_aligned(spark, sf), X, W, step)


def _significant(spark, sf) -> DataFrame:
    a = _aligned(spark, sf)
    null = nulls.series_null(spark, a, X, W, _shifts(spark, sf))
    return fdr.pointwise(nulls.compare(rolling.scores(a, X, W), null, ["series_id", "feature", "t_src"], R), ALPHA)


def _significant_whole(spark, sf) -> DataFrame:
    a = _aligned(spark, sf)
    return fdr.pointwise(nulls.series_envelope(spark, a, rolling.scores(a, X, W), X, W, _shifts(spark, sf, REPLICATES)), 0.05)


def daily_series(spark, sf):
    return rounded(rounded(_daily(spark, sf).select("t", text("date").alias("d"), "y", *X), *X), "y", digits=2)


def hourly_series(spark, sf):
    d = src.number(src.hourly_events(spark, sf), "h")
    return rounded(d.select("t", "h", "y", "n"), "y", digits=4)


def hourly_by_type(spark, sf):
    d = src.number(src.hourly_events(spark, sf, "event_type"), "h")
    return rounded(d.select("series_id", "t", "h", "y", "n"), "y", digits=4)


def regular_calendar(spark, sf):
    d = calendar.complete(src.daily_orders(spark, sf), "date", "interval 1 day")
    return rounded(d.select(text("date").alias("d"), "y", F.coalesce("n", F.lit(0)).alias("n"), F.col("y").isNull().alias("missing")), "y", digits=2)


def interpolate_limited(spark, sf):
    d = calendar.interpolate(calendar.complete(src.hourly_events(spark, sf, "event_type"), "h", 1), ["y"], 2, "h")
    return rounded(d.select("series_id", "h", "y", F.col("n").isNull().alias("filled_or_missing")), "y", digits=7)


def regularised_series(spark, sf):
    d = calendar.interpolate(calendar.complete(src.hourly_events(spark, sf, "event_type"), "h", 1), ["y"], 1, "h")
    return rounded(calendar.drop_incomplete(d, ["y"], "h").select("series_id", "t", "h", "y"), "y", digits=7)


def time_index_modes(spark, sf):
    d = src.number(src.daily_orders(spark, sf)).withColumnRenamed("t", "t_ordinal")
    return src.number_by_calendar(d).select(text("date").alias("d"), "t_ordinal", F.col("t").alias("t_calendar"))


def first_k_years(spark, sf):
    return calendar.first_years(_daily(spark, sf), 2).select("t", text("date").alias("d"))


def season_label(spark, sf):
    s = scalar.season(F.col("date"))
    return _daily(spark, sf).select("t", s.alias("season"), scalar.season_order(s).alias("season_order"))


def block_labels(spark, sf):
    return _daily(spark, sf).select("t", *[scalar.block_label(F.col("date"), m).alias(m) for m in ("month", "quarter", "season")])


def ordinal_dates(spark, sf):
    d = src.number(src.daily_orders(spark, sf))
    first = F.min("date").over(Window.partitionBy("series_id"))
    return d.select("t", scalar.date_of(F.col("t"), first).cast("string").alias("d"))


def clean_labels(spark, sf):
    e = spark.read.parquet(f"{sf}/orders.parquet")
    return e.groupBy(scalar.clean_label(F.col("o_orderpriority")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def prediction_columns(spark, sf):
    d = _daily(spark, sf).select(F.col("t").cast("string").alias("Time"), F.col("x1").cast("string").alias("Observations"), F.when(F.col("t") % 5 == 0, "n/a").otherwise(F.col("x2").cast("string")).alias("Predictions"))
    return rounded(scalar.predictions(d), "obs", "pred")


def zscore(spark, sf):
    w = Window.partitionBy("series_id")
    d = _daily(spark, sf)
    return d.select("t", *[r(scalar.z(F.col(c), F.avg(c).over(w), F.stddev_pop(c).over(w))).alias(f"z_{c}") for c in ("y", "x1")])


def rolling_mean_std(spark, sf):
    d = rolling.rolling_moments(_daily(spark, sf), ["x1"], 30, "t", ["series_id"])
    return rounded(d.select("t", "x1_mean", "x1_sd"), "x1_mean", "x1_sd")


def align_source_time(spark, sf):
    return rounded(rounded(_aligned(spark, sf).select("t_src", text("date_src").alias("d"), "t_pred", "obs", "pred", *X), *X), "obs", "pred", digits=2)


def align_prediction_time(spark, sf):
    d = _daily(spark, sf)
    a = align.by_prediction_time(d, forecast.persistence(d, "y", 7), X, 7)
    a = align.with_dates(a, d).select("t_src", "t_pred", text("date_pred").alias("d"), "pred", "x1")
    return rounded(rounded(a, "x1"), "pred", digits=2)


def persistence(spark, sf):
    return rounded(forecast.persistence(_daily(spark, sf), "y", 7).select("t_pred", "obs", "pred"), "obs", "pred", digits=2)


def mean_baseline(spark, sf):
    end = forecast.split(_days(spark, sf))[0][1]
    d = forecast.mean_state(_daily(spark, sf), "y", 1, end).where(F.col("t_pred") > end)
    return rounded(d.select("t_pred", "obs", "pred"), "obs", "pred", digits=2)


def _baselines(spark, sf) -> DataFrame:
    d, out, end = _daily(spark, sf), None, forecast.split(_days(spark, sf))[0][1]
    for tp in (1, 3, 7, 14):
        for f in (forecast.mean_state(d, "y", tp, end), forecast.persistence(d, "y", tp)):
            out = f if out is None else out.unionByName(f)
    return forecast.evaluate(out.where(F.col("t_pred") > end))


def forecast_metrics(spark, sf):
    d = _baselines(spark, sf)
    return rounded(rounded(d.select("model", "tp", "n", "rho", "mae", "rmse", "bias"), "rho"), "mae", "rmse", "bias", digits=2)


def skill_scores(spark, sf):
    d = forecast.skill(_baselines(spark, sf))
    return rounded(d.select("model", "tp", "skill_vs_b1", "skill_vs_b2"), "skill_vs_b1", "skill_vs_b2")


def rolling_score(spark, sf):
    return rounded(_observed(spark, sf).select("feature", "t_src", text("date_src").alias("d"), "g"), "g")


def local_score(spark, sf):
    return rounded(_observed(spark, sf).select("feature", "t_src", "l"), "l")


def endpoint_stride(spark, sf):
    return rounded(_observed(spark, sf, 7).select("feature", "t_src", "g"), "g")


def multi_series_score(spark, sf):
    d = src.number(src.hourly_events(spark, sf, "event_type").withColumn("n", F.col("n").cast("double")), "h").withColumn("date", F.col("h"))
    a = align.by_source_time(d, forecast.persistence(d, "y", 1, beyond=True), ["n"], 1)
    return rounded(rolling.scores(a, ["n"], 48).select("series_id", "t_src", "g"), "g", digits=5)


def inverse_operator_raw(spark, sf):
    d = _aligned(spark, sf).withColumn("pred", F.col("pred") / 1e6)
    out = rolling.inverse_operator(rolling.windows(d, W), X, normalize_y=False)
    return rounded(out.select("e", "feature", "g", "l"), "g", "l")


def equivalence(spark, sf):
    d = rolling.equivalence(_aligned(spark, sf), X, W)
    return rounded(d.select("feature", "n_windows", "mean", "sd", "max_difference"), "mean", "sd", "max_difference")


def circular_null(spark, sf, replicates=R):
    d = nulls.series_null(spark, _aligned(spark, sf), X, W, _shifts(spark, sf, replicates))
    return rounded(d.select("feature", "perm", "t_src", "gr"), "gr")


def envelope(spark, sf, scores=_significant):
    return rounded(scores(spark, sf).select("feature", "t_src", "lo", "hi"), "lo", "hi")


def pvalues(spark, sf, scores=_significant):
    return rounded(scores(spark, sf).select("feature", "t_src", "p"), "p")


def _window_null(cfg: AttributionConfig) -> Callable:
    def run(spark, sf):
        d = windowed.rolling_nulls(_aligned(spark, sf), X, cfg)
        return rounded(d.select("e", "feature", "g", "lo", "hi", "p"), "g", "lo", "hi", "p")

    return run


UNIFORM = AttributionConfig(window=W, replicates=R, seed=1)
WEEKLY = AttributionConfig(window=W, replicates=R, seed=2, preserve_weekly=True)
BLOCKS = AttributionConfig(window=W, replicates=R, seed=3, block_null="month", date_column="date_src")


def fdr_pointwise(spark, sf, scores=_significant):
    return scores(spark, sf).select("feature", "t_src", "sig")


def fdr_over_time(spark, sf):
    d = fdr.over_time(_significant(spark, sf).drop("sig"), 0.5)
    return fdr.benjamini_hochberg(d.withColumn("q", F.when(F.col("t_src") % 10 > 0, F.col("p"))), ["feature"], 0.5, "q", "sig_all", count_missing=True).select("feature", "t_src", "sig", "sig_all")


def segment_rows(spark, sf):
    return segments.islands(_significant(spark, sf)).select("feature", "t_src", "island")


def interval_table(spark, sf, scores=_significant):
    d = segments.intervals(scores(spark, sf))
    return rounded(d.select("feature", text("start_date").alias("start_date"), text("end_date").alias("end_date"), "n", "mean", "median", "min", "max"), "mean", "median", "min", "max")


def significance_by_season(spark, sf, scores=_significant):
    d = segments.by_season(scores(spark, sf)).drop("series_id")
    return rounded(d, "prop_significant", "median_sign_all", "mean_contribution_all", "mean_contribution_significant")


def _holes(spark, sf) -> DataFrame:
    """The daily series with some values missing and some zero."""
    d = _daily(spark, sf)
    return d.withColumn("x1", F.when(F.col("t") % 11 == 0, None).otherwise(F.col("x1"))).withColumn("x3", F.when(F.col("t") % 13 == 0, 0.0).otherwise(F.col("x3")))


def primary_stats(spark, sf):
    d = describe.primary(_holes(spark, sf), X).drop("series_id")
    return rounded(rounded(d, "mean", "sd", "min", "median", "max"), "skewness", "kurtosis", digits=5)


def overview(spark, sf):
    d = describe.overview(calendar.first_years(_holes(spark, sf), 1), X, _holes(spark, sf)).drop("series_id")
    return d.withColumns({c: text(c) for c in ("time_start", "time_end", "raw_start", "raw_end")})


def seasonal_stats(spark, sf):
    d = describe.seasonal(_holes(spark, sf), X).drop("series_id")
    return rounded(rounded(d, "mean", "sd", "median"), "skewness", "kurtosis", digits=5)


def autocorr(spark, sf):
    return rounded(describe.autocorrelation(_holes(spark, sf), X, LAGS).drop("series_id"), "autocorr")


def crosscorr(spark, sf):
    return rounded(describe.crosscorrelation(_holes(spark, sf), ["y", *X]).drop("series_id"), "corr")


def design_snr(spark, sf):
    d = describe.design_snr(_daily(spark, sf), "x1", "x2", "y", "x2", "x3").drop("series_id")
    return rounded(rounded(d, "corr_x1_x2", "signal_variance", "noise_variance", "corr_y_signal"), "snr", digits=2)


def lag_embed(spark, sf):
    d = forecast.lag_embed(_daily(spark, sf), "x2", 3)
    return rounded(d.select("t", "s0", "s1", "s2"), "s0", "s1", "s2")


def simplex(spark, sf, lib, pred):
    d = forecast.lag_embed(_daily(spark, sf), "x2", 2).select("series_id", "t", "x2", "s0", "s1")
    out = forecast.simplex_pairs(d, ["s0", "s1"], "x2", lib, pred, 1, 3)
    return rounded(out.select("t_pred", "obs", "pred"), "obs", "pred", digits=5)


def embed_dimension(spark, sf, lib, pred, most=10):
    return rounded(forecast.embed_dimension(_daily(spark, sf), "x2", lib, pred, most).drop("series_id"), "rho", digits=5)


def smap_theta0(spark, sf, lib, pred):
    d = forecast.smap_line(_daily(spark, sf), "x2", "x2", lib, pred, 1, 0.0)
    return rounded(d.select("t_pred", "obs", "pred", "slope"), "obs", "pred", "slope")


def smap_1d(spark, sf, lib, pred):
    d = forecast.smap_line(_daily(spark, sf), "x2", "x2", lib, pred, 1, 2.0)
    return rounded(d.select("t_pred", "obs", "pred", "slope"), "obs", "pred", "slope", digits=5)


def smap(spark, sf, lib, pred):
    d = forecast.run_models(_daily(spark, sf), [{"model": "smap", "kind": "univariate", "e": 1, "theta": 2.0, "tp": 1}], "x2", [], lib, pred)
    return rounded(d.select("t_pred", "obs", "pred", F.col("coefficients")[1].alias("slope")), "obs", "pred", "slope", digits=5)


def smap_coefficients(spark, sf, lib, pred):
    d = _daily(spark, sf)
    full = forecast.run_models(d, [{"model": "smap", "theta": 1.0, "tp": 1}], "y", ["x1", "x2"], lib, pred)
    out = forecast.coefficient_agreement(_observed(spark, sf), forecast.coefficients(full, ["y", "x1", "x2"]))
    return rounded(out, "corr")


def smap_multivariate(spark, sf, lib, pred):
    d = forecast.run_models(_daily(spark, sf), [{"model": "smap", "theta": 2.0, "tp": 1}], "x2", ["x1"], lib, pred)
    c = {n: F.col("coefficients")[i + 1].alias(n) for i, n in enumerate(("slope_x2", "slope_x1"))}
    return rounded(d.select("t_pred", "obs", "pred", *c.values()), "obs", "pred", "slope_x2", "slope_x1", digits=4)


def theta_sweep(spark, sf, lib, pred, grid=THETA_GRID):
    d = forecast.theta_sweep(_daily(spark, sf), "x2", [], lib, pred, kind="univariate", e=1, grid=grid)
    return rounded(d.drop("series_id"), "rho", "mae", "rmse", "bias", digits=5)


def param_select(spark, sf, lib, pred, most=10):
    d = forecast.embed_dimension(_daily(spark, sf), "x2", lib, pred, most)
    return rounded(forecast.best(d, "e").drop("series_id"), "rho", digits=5)


def _held_out(query: Callable, **options) -> Callable:
    """A forecast query on the library and all held-out rows of the series."""

    def run(spark, sf):
        lib, pred = forecast.split(_daily(spark, sf).count())
        return query(spark, sf, lib=lib, pred=pred, **options)

    return run


def horizon_evaluation(spark, sf):
    d = _daily(spark, sf)
    return forecast.horizons(d, "y", ["x1", "x2"], (1, 3, 7, 14))[0]


def windowed_attribution(spark, sf):
    cfg = AttributionConfig(window=W, replicates=REPLICATES, seed=0)
    return windowed.rolling_windows(_daily(spark, sf), ["x1", "x2"], "y", cfg, theta=1.0)


def _labels(spark, sf) -> DataFrame:
    t = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    return t.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("n_chars").cast("double").alias("v")), "doc_id")


def cliffs_delta(spark, sf):
    d = effects.cliffs_delta(_labels(spark, sf), "v", F.col("toxic") == 1, F.col("toxic") == 0)
    return rounded(d, "delta")


def bootstrap_ci(spark, sf):
    d = _labels(spark, sf).where("toxic in (0, 1)").select(F.col("toxic").cast("int").alias("grp"), "doc_id", "v")
    d = d.withColumn("idx", (F.row_number().over(Window.partitionBy("grp").orderBy("doc_id")) - 1).cast("long")).drop("doc_id")
    sizes = d.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return rounded(effects.bootstrap_difference(d, effects.counter_indices(spark, sizes, 200)), "mean_difference", "ci_low", "ci_high", digits=4)


def ablation_errors(spark, sf):
    d = _daily(spark, sf)
    picked = ablation.groups(_observed(spark, sf), "x2", _days(spark, sf) - 1, 60)
    return ablation.permuted_errors(d, picked, "y", ["x2", "x1"], "x2", window=W, theta=0.5, repeats=5).drop("date_src")


def ablation_effect(spark, sf):
    return ablation.effect(ablation_errors(spark, sf).withColumn("date_src", F.lit(None).cast("date")))


def ccm(spark, sf):
    d = _daily(spark, sf)
    return forecast.cross_map(d, "x1", "x2", 2, range(10, d.count() - 4, 10))


def synthetic_series(spark, sf):
    d = synthetic(spark).withColumn("date", text("date"))
    return rounded(d, "y", "x1", "x2", "true_alpha", "true_beta", "deterministic_signal", "noise")


def synthetic_recovery(spark, sf):
    s = synthetic(spark)
    preds = s.select("series_id", F.col("t").alias("t_pred"), F.col("y").alias("obs"), F.col("deterministic_signal").alias("pred"))
    scores = rolling.scores(align.by_source_time(s, preds, ["x1", "x2"], 1), ["x1", "x2"], W)
    return rounded(describe.recovery(scores, s, {"x1": "true_alpha", "x2": "true_beta"}), "corr_with_truth")


def manifest_guard(spark, sf):
    files = report.manifest(spark, sf, "*.parquet").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return report.guard(spark, synthetic_recovery(spark, sf)).join(files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q_daily_series": daily_series, "q_hourly_series": hourly_series, "q_hourly_by_type": hourly_by_type, "q_regular_calendar": regular_calendar,
    "q_interpolate_limited": interpolate_limited, "q_regularised_series": regularised_series, "q_time_index_modes": time_index_modes, "q_first_k_years": first_k_years,
    "q_season_label": season_label, "q_block_labels": block_labels, "q_ordinal_dates": ordinal_dates, "q_clean_labels": clean_labels, "q_prediction_columns": prediction_columns,
    "q_zscore": zscore, "q_rolling_mean_std": rolling_mean_std, "q_align_source_time": align_source_time, "q_align_prediction_time": align_prediction_time,
    "q_persistence": persistence, "q_mean_baseline": mean_baseline, "q_forecast_metrics": forecast_metrics, "q_skill_scores": skill_scores,
    "q_rolling_score": rolling_score, "q_local_score": local_score, "q_endpoint_stride": endpoint_stride, "q_multi_series_score": multi_series_score,
    "q_inverse_operator_raw": inverse_operator_raw, "q_equivalence": equivalence, "q_circular_null": circular_null, "q_envelope": envelope, "q_pvalues": pvalues,
    "q_window_null_uniform": _window_null(UNIFORM), "q_window_null_weekly": _window_null(WEEKLY), "q_window_null_block": _window_null(BLOCKS),
    "q_fdr_pointwise": fdr_pointwise, "q_fdr_over_time": fdr_over_time, "q_segments": segment_rows, "q_interval_table": interval_table, "q_significance_by_season": significance_by_season,
    "q_primary_stats": primary_stats, "q_overview": overview, "q_seasonal_stats": seasonal_stats, "q_autocorr": autocorr, "q_crosscorr": crosscorr, "q_design_snr": design_snr,
    "q_lag_embed": lag_embed, "q_simplex": _held_out(simplex), "q_embed_dimension": _held_out(embed_dimension), "q_smap_theta0": _held_out(smap_theta0), "q_smap_1d": _held_out(smap_1d), "q_smap": _held_out(smap),
    "q_smap_multivariate": _held_out(smap_multivariate), "q_smap_coefficients": _held_out(smap_coefficients), "q_theta_sweep": _held_out(theta_sweep), "q_param_select": _held_out(param_select), "q_horizon_evaluation": horizon_evaluation,
    "q_windowed_attribution": windowed_attribution, "q_cliffs_delta": cliffs_delta, "q_bootstrap_ci": bootstrap_ci, "q_ablation": ablation_errors, "q_ablation_effect": ablation_effect,
    "q_circular_null_whole": partial(circular_null, replicates=REPLICATES), "q_window_null_uniform_whole": _window_null(replace(UNIFORM, replicates=REPLICATES)),
    "q_window_null_weekly_whole": _window_null(replace(WEEKLY, replicates=REPLICATES)), "q_window_null_block_whole": _window_null(replace(BLOCKS, replicates=REPLICATES)),
    **{f"{name}_whole": partial(q, scores=_significant_whole) for name, q in (("q_envelope", envelope), ("q_pvalues", pvalues), ("q_fdr_pointwise", fdr_pointwise), ("q_interval_table", interval_table), ("q_significance_by_season", significance_by_season))},
    "q_ccm": ccm, "q_synthetic_series": synthetic_series, "q_synthetic_recovery": synthetic_recovery, "q_manifest_guard": manifest_guard,
}
