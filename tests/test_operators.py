"""Operators on small series, with the edge cases that test data do not hold."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollcast.config import AttributionConfig
from rollcast.functions import kernels, scalar
from rollcast.operators import ablation, align, calendar, describe, effects, fdr, forecast, nulls, report, rolling, segments, windowed
from rollcast.plans import pipelines
from rollcast.sources import series as src
from rollcast.sources.synthetic import synthetic


def series(spark, n=120, seed=0, ids=("a",), **columns):
    rng = np.random.default_rng(seed)
    out = []
    for s in ids:
        y, x1, x2 = rng.normal(size=(3, n))
        out += [(s, i + 1, dt.date(2020, 1, 1) + dt.timedelta(i), float(y[i]), float(x1[i]), float(x2[i])) for i in range(n)]
    return spark.createDataFrame(out, "series_id string, t long, date date, y double, x1 double, x2 double")


def aligned(spark, df):
    return align.by_source_time(df, forecast.persistence(df, "y", 1, beyond=True), ["x1", "x2"], 1)


def test_interpolation_fixture(spark):
    gaps = {*range(0, 8), *range(10, 25), 28, 29}
    d = spark.createDataFrame([("a", i, None if i in gaps else float(i * i)) for i in range(30)], "series_id string, h long, v double")
    got = {r["h"]: r["v"] for r in calendar.interpolate(d, ["v"], 3, "h").collect()}
    want = {5: 64, 6: 64, 7: 64, 10: 115, 11: 149, 12: 183, 22: 523, 23: 557, 24: 591, 28: 729, 29: 729}
    assert {k: round(v) for k, v in got.items() if k in gaps and v is not None} == want
    whole = calendar.interpolate(d, ["v"], None, "h").where("v is null").count()
    assert whole == 0


def test_interpolation_against_pandas(spark):
    rng = np.random.default_rng(1)
    v = pd.Series(rng.normal(size=200))
    v[rng.random(200) < 0.6] = np.nan
    d = spark.createDataFrame([("a", i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)], "series_id string, h long, v double")
    for limit in (1, 3, 6):
        got = [r["v"] for r in calendar.interpolate(d, ["v"], limit, "h").orderBy("h").collect()]
        want = v.interpolate("linear", limit=limit, limit_direction="both")
        assert np.allclose(pd.Series(got, dtype=float), want, equal_nan=True)


def test_regularise_and_repeated_times(spark):
    at = lambda h: dt.datetime(2020, 2, 28, 22) + dt.timedelta(hours=h)
    d = spark.createDataFrame([("a", at(0), 1.0), ("a", at(3), 4.0), ("a", at(20), 5.0)], "series_id string, date timestamp_ntz, v double")
    got = calendar.regularise(d, ["v"], limit=1).orderBy("t").collect()
    assert [(r["t"], r["v"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4 + 1 / 17), (6, 5 - 1 / 17), (7, 5)]
    with pytest.raises(Exception, match="repeated"):
        calendar.regularise(d.unionByName(d.limit(1)), ["v"]).collect()
    leap = spark.createDataFrame([("a", dt.datetime(2020, 2, 29, 5)), ("a", dt.datetime(2022, 2, 28, 4)), ("a", dt.datetime(2022, 2, 28, 5))], "series_id string, date timestamp_ntz")
    assert calendar.first_years(leap, 2).count() == 2 and calendar.first_years(leap, None).count() == 3


def test_labels(spark):
    d = spark.createDataFrame([(dt.date(2020, 12, 31),), (dt.date(2021, 1, 1),), (None,)], "d date")
    got = d.select(scalar.season(F.col("d")), scalar.block_label(F.col("d"), "season"), scalar.block_label(F.col("d"), "quarter")).collect()
    assert [tuple(r) for r in got] == [("DJF", "2020-DJF", "2020Q4"), ("DJF", "2021-DJF", "2021Q1"), ("SON", None, None)]
    with pytest.raises(ValueError):
        scalar.block_label(F.col("d"), "week")
    one = spark.range(1).select(scalar.table_round(F.lit(0.125), 2), scalar.table_round(F.lit(float("inf"))), scalar.clean_label(F.lit("a b/ç-1.x"))).first()
    assert tuple(one) == (0.12, None, "a_b_ç-1.x")


def test_prediction_columns(spark):
    d = spark.createDataFrame([("1.2", "x", "3"), ("bad", "1", "2")], "TIME string, My_Observation string, Predictions string")
    assert [tuple(r) for r in scalar.predictions(d).collect()] == [(1, None, 3.0)]
    assert scalar.find_column(d, "time") == "TIME" and scalar.find_column(d, "rho") is None
    with pytest.raises(ValueError):
        scalar.predictions(d.select("TIME"))


def test_alignment_drops_and_checks(spark):
    d = series(spark, 5)
    p = spark.createDataFrame([("a", 2, None, 1.0), ("a", 3, 1.0, None), ("a", 99, 1.0, 1.0)], "series_id string, t_pred long, obs double, pred double")
    assert [r["t_src"] for r in align.by_source_time(d, p, ["x1"], 1).collect()] == [1]
    assert align.by_prediction_time(d, p, ["x1"], 1).count() == 2
    with pytest.raises(Exception, match="repeated"):
        align.by_prediction_time(d, p.unionByName(p), ["x1"], 1).collect()
    assert align.with_dates(p, d).where("date_pred is null").count() == 1
    assert align.truth(d.select("series_id", F.col("t").alias("t_src"), "x1"), d, ["x1", "y"]).columns == ["series_id", "t_src", "x1", "x1_truth", "y"]


def test_rolling_correlation_edges(spark):
    n, w = 60, 10
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=n) + 1e6, rng.normal(size=n)
    x[20:32] = x[20]
    rows = [("a", i, None if i == 45 else float(x[i]), float(y[i])) for i in range(n)]
    d = spark.createDataFrame(rows, "k string, i long, x double, y double")
    got = {r["i"]: r["g"] for r in rolling.rolling_corr(d, "x", "y", w, "i", ["k"]).collect()}
    for i in range(n):
        a, b = x[i - w + 1 : i + 1], y[i - w + 1 : i + 1]
        if i < w - 1 or i - w < 45 <= i or np.ptp(a) == 0:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)


def test_series_null_is_numpy_roll(spark):
    d = series(spark, 50)
    a = aligned(spark, d)
    got = {(r["perm"], r["t_src"]): r["gr"] for r in nulls.series_null(spark, a, ["x1"], 20, [7, 50, 3]).collect()}
    p = d.orderBy("t").toPandas()
    for k, s in enumerate([7, 50, 3]):
        y = np.roll(p["y"].to_numpy(), s)
        for t in (20, 35, 50):
            assert got[k, t] == pytest.approx(np.corrcoef(p["x1"][t - 20 : t], y[t - 20 : t])[0, 1], abs=1e-9)
    obs = rolling.scores(a, ["x1"], 20)
    same = nulls.compare(obs, nulls.series_null(spark, a, ["x1"], 20, [50] * 9), ["series_id", "feature", "t_src"], 9)
    assert {r["p"] for r in same.collect()} == {1.0}


@pytest.mark.parametrize("cfg", [AttributionConfig(window=40, replicates=9, seed=1), AttributionConfig(window=40, replicates=9, preserve_weekly=True), AttributionConfig(window=40, replicates=9, block_null="Month", date_column="date_src")])
def test_window_null_equals_kernel(spark, cfg):
    a = aligned(spark, series(spark, 100))
    m = rolling.windows(a, 40, 20)
    obs = rolling.inverse_operator(m, ["x1", "x2"], normalize_y=True)
    got = nulls.compare(obs, nulls.window_null(spark, m, ["x1", "x2"], cfg), ["series_id", "e", "feature"], 9)
    p = a.orderBy("t_src").toPandas()
    for e in (40, 60, 100):
        s = p.iloc[e - 40 : e]
        labels = pd.to_datetime(s["date_src"]).dt.strftime("%Y-%m").to_numpy() if cfg.block_null else None
        g, l, lo, hi, pv = windowed.attribute(s[["x1", "x2"]].to_numpy(), s["pred"].to_numpy(), labels, cfg)
        for j, f in enumerate(("x1", "x2")):
            r = got.where((F.col("e") == e) & (F.col("feature") == f)).first()
            assert [r["g"], r["l"], r["lo"], r["hi"], r["p"]] == pytest.approx([g[j], l[j], lo[j], hi[j], pv[j]], abs=1e-9)


def test_windowed_attribution_against_loop(spark):
    d = series(spark, 110, ids=("a", "b"))
    cfg = AttributionConfig(window=40, replicates=5, seed=2)
    got = windowed.rolling_windows(d, ["x1", "x2"], "y", cfg, theta=0.7)
    assert got.count() == 2 * 71 * 2
    p = d.where("series_id = 'b'").orderBy("t").toPandas()
    for end in (40, 72, 110):
        s = p.iloc[end - 40 : end]
        x, y = s[["x1", "x2"]].to_numpy(), s["y"].to_numpy()
        ahead = np.append(y[1:], np.nan)
        yhat = []
        for i in range(40):
            use = np.isfinite(ahead) & (np.arange(40) != i)
            yhat.append(kernels.smap(x[use], ahead[use], x[i], 0.7)[0])
        want = windowed.attribute(x, np.array(yhat), None, cfg)
        r = got.where((F.col("series_id") == "b") & (F.col("t_pred") == end + 1) & (F.col("feature") == "x2")).first()
        assert [r["g"], r["l"], r["lo"], r["hi"], r["p"]] == pytest.approx([v[1] for v in want], abs=1e-9)
    assert windowed.rolling_windows(d.limit(5), ["x1"], "y", cfg).count() == 0


def test_benjamini_hochberg(spark):
    d = spark.createDataFrame([("a", f"x{i}", 1, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04, 0.50, None])], "series_id string, feature string, t_src long, p double")
    got = {r["p"]: r["sig"] for r in fdr.pointwise(d).collect()}
    assert got == {0.01: True, 0.02: True, 0.03: True, 0.04: True, 0.50: False, None: False}
    more = [fdr.benjamini_hochberg(d, ["t_src"], a).where("sig").count() for a in (0.001, 0.01, 0.05, 0.2, 1.0)]
    assert more == sorted(more)


def test_segments(spark):
    flags = [True, True, False, True, False, False, True, None]
    rows = [("a", "x", dt.date(2020, 1, 1) + dt.timedelta(3 * i), f, float(i)) for i, f in enumerate(flags)] + [("a", "x", None, True, 9.0)]
    d = spark.createDataFrame(rows, "series_id string, feature string, date_src date, sig boolean, g double")
    got = sorted((r["min"], r["max"], r["n"]) for r in segments.intervals(d).collect())
    assert got == [(0, 1, 2), (3, 3, 1), (6, 6, 1)]
    s = segments.by_season(d).collect()
    assert sum(r["n_timepoints"] for r in s) == 9


def test_describe_constant_and_missing(spark):
    d = spark.createDataFrame([("a", i + 1, dt.date(2020, 1, 1), 2.0, float("nan"), float(i)) for i in range(5)], "series_id string, t long, date date, c double, m double, v double")
    r = {x["variable"]: x for x in describe.primary(d, ["c", "m", "v"]).collect()}
    assert r["c"]["skewness"] is None and r["m"]["mean"] is None and r["m"]["n_missing"] == 5
    v = pd.Series(range(5), dtype=float)
    assert r["v"]["kurtosis"] == pytest.approx(v.kurtosis()) and r["v"]["skewness"] == pytest.approx(v.skew())
    ac = {(x["variable"], x["lag"]): (x["n_pairs"], x["autocorr"]) for x in describe.autocorrelation(d, ["v", "c"], {"1": 1, "far": 99, "none": 0}).collect()}
    assert ac["v", "1"] == (4, pytest.approx(1)) and ac["v", "far"] == (0, None) and ac["c", "1"] == (4, None) and ac["v", "none"] == (0, None)


def test_effects(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1), (0.0, 0), (2.0, 0), (None, 0)], "v double, g int")
    assert effects.cliffs_delta(d, "v", F.col("g") == 1, F.col("g") == 0).first()["delta"] == pytest.approx(0.5)
    assert effects.cliffs_delta(d, "v", F.col("g") == 7, F.col("g") == 0).first()["delta"] is None
    x, y, rng = np.array([1.0, 2, 3, 7]), np.array([0.0, 2, 5]), np.random.default_rng(4)
    diffs = [rng.choice(x, 4).mean() - rng.choice(y, 3).mean() for _ in range(50)]
    v = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(x)] + [(0, i, float(a)) for i, a in enumerate(y)], "grp int, idx long, v double")
    r = effects.bootstrap_difference(v, effects.generator_indices(spark, 4, 3, 50, 4)).first()
    assert list(r) == pytest.approx([x.mean() - y.mean(), *np.percentile(diffs, [2.5, 97.5])])


def test_models_and_searches(spark):
    t = np.arange(160)
    y = np.sin(2 * np.pi * t / 20)
    d = spark.createDataFrame([("a", int(i) + 1, dt.date(2020, 1, 1) + dt.timedelta(int(i)), float(y[i]), float(np.cos(i))) for i in t], "series_id string, t long, date date, y double, x1 double")
    p = forecast.select_parameters(d, "y", ["x1"], most=3, grid=(0.0, 1.0)).first()
    assert [p[c] for c in forecast.RANGES] == [1, 128, 129, 160] and p["e_mv"] == 2
    metrics, preds, params = forecast.horizons(d, "y", ["x1"], (1, 2), most=2, grid=(0.0, 1.0))
    assert params.count() == 2
    got = {(r["model"], r["tp"]): r for r in metrics.collect()}
    assert len(got) == 12 and got["smap_univariate", 1]["rho"] > 0.99
    assert got["B1_mean", 1]["skill_vs_b1"] == pytest.approx(0) and got["B2_persistence", 2]["skill_vs_b2"] == pytest.approx(0)
    full = forecast.full_series(d, "y", ["x1"], 0.5, 1)
    assert full.count() == 160 and full.where("obs is null").count() == 1
    coefs = forecast.coefficients(full, ["y", "x1"])
    assert coefs.count() == 320
    with pytest.raises(ValueError):
        forecast.run_models(d, [{"model": "other", "tp": 1}], "y", [], (1, 10), (11, 20))


def test_every_series_has_its_own_parameters(spark):
    """Two series searched together get what each gets alone; a model that fails has n = 0."""
    rng = np.random.default_rng(1)
    wave, walk = np.sin(2 * np.pi * np.arange(150) / 20), np.cumsum(rng.normal(size=90))
    rows = [("wave", i + 1, float(v), float(rng.normal())) for i, v in enumerate(wave)] + [("walk", i + 1, float(v), None) for i, v in enumerate(walk)]
    d = spark.createDataFrame(rows, "series_id string, t long, y double, x1 double")
    options = {"most": 4, "grid": (0.0, 1.0, 4.0)}
    both = {r["series_id"]: r for r in forecast.select_parameters(d, "y", ["x1"], **options).collect()}
    for s in ("wave", "walk"):
        assert both[s] == forecast.select_parameters(d.where(F.col("series_id") == s), "y", ["x1"], **options).first()
    assert both["wave"]["lib_last"] == 120 and both["walk"]["lib_last"] == 70 and both["walk"]["theta_mv"] == 0.0
    metrics = {(r["series_id"], r["model"]): r for r in forecast.horizons(d, "y", ["x1"], (1,), **options)[0].collect()}
    assert len(metrics) == 12 and metrics["walk", "smap_multivariate"]["n"] == 0 and metrics["walk", "smap_multivariate"]["rmse"] is None
    assert metrics["walk", "smap_univariate"]["n"] == 19 and metrics["wave", "smap_multivariate"]["n"] == 29


def test_rolling_score_after_a_spike(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=400), rng.normal(size=400)
    x[3] = 1e8
    d = spark.createDataFrame([("a", "f", i, float(x[i]), float(y[i])) for i in range(400)], "series_id string, feature string, t long, x double, y double")
    got = {r["t"]: r["g"] for r in rolling.rolling_corr(d, "x", "y", 30, "t").collect()}
    assert all(got[i] is None for i in range(29))
    assert all(got[i] == pytest.approx(np.corrcoef(x[i - 29 : i + 1], y[i - 29 : i + 1])[0, 1], abs=1e-9) for i in range(33, 400))


def test_cross_map_of_a_driven_pair(spark):
    n = 200
    x, y = np.zeros(n), np.zeros(n)
    x[0], y[0] = 0.4, 0.2
    for t in range(n - 1):
        x[t + 1] = x[t] * (3.8 - 3.8 * x[t])
        y[t + 1] = y[t] * (3.5 - 3.5 * y[t] - 0.1 * x[t])
    d = spark.createDataFrame([("a", i + 1, float(x[i]), float(y[i])) for i in range(n)], "series_id string, t long, x double, y double")
    r = {k["lib_size"]: k for k in forecast.cross_map(d, "y", "x", 2, (10, 150), samples=3).collect()}
    assert r[150]["rho_ab"] > r[10]["rho_ab"] and r[150]["rho_ab"] > 0.7  # the driven series knows its driver


def test_ablation_against_loop(spark):
    d = series(spark, 150)
    sc = rolling.scores(aligned(spark, d), ["x1"], 40)
    picked = ablation.groups(sc, "x1", 149, 5)
    e = ablation.permuted_errors(d, picked, "y", ["x1", "x2"], "x1", window=40, theta=0.5, repeats=2, seed=3)
    rows = e.collect()
    assert 0 < len(rows) <= 10
    p, r = d.orderBy("t").toPandas(), rows[0]
    s = p.iloc[r["t_src"] - 40 : r["t_src"] + 1]
    obs, pred = kernels.endpoint(s[["y", "x1", "x2"]].to_numpy()[None, :40], s["y"].to_numpy()[1:], 0.5)
    assert r["ae_original"] == pytest.approx(abs(pred[0] - obs))
    assert ablation.summary(e).count() == 2
    assert ablation.effect(e, 20).first()["n_high"] == sum(x["grp"] == ablation.HIGH for x in rows)


def test_synthetic_recovery_and_guard(spark):
    out = pipelines.synthetic_pipeline(spark, replicates=9)
    rec = out["recovery"]
    assert all(r["corr_with_truth"] >= 0.60 for r in rec.collect())
    assert report.guard(spark, rec).first()["status"] == "PASS"
    bad = report.guard(spark, rec.withColumn("corr_with_truth", F.lit(0.1)), out["scores"], excluded=["x1"], tables={"t": "a & NaN "}).first()
    assert bad["status"] == "FAIL" and bad["problems"].count(";") == 2
    assert report.guard(spark, None).first()["status"] == "FAIL"
    assert report.guard(spark, rec, attributed=True).first()["problems"] == "no attribution"
    files = spark.createDataFrame([("/o/pm_significant_intervals_Is/part-0.csv", "part-0.csv"), ("/o/pm_significant_intervals_Iws.csv", "pm_significant_intervals_Iws.csv")], "path string, file string")
    assert report.guard(spark, rec, out["scores"], excluded=["Ir"], files=files).first()["status"] == "PASS"
    stale = report.guard(spark, rec, out["scores"], excluded=["Is", "Ir"], files=files).first()
    assert stale["status"] == "FAIL" and "stale" in stale["problems"]
    with pytest.raises(report.NotReady):
        report.guard(spark, None, strict=True)
    from rollcast.sources.synthetic import ALPHA, system

    short = system(600)["true_alpha"]  # the regimes' rows do not depend on the length
    assert [short[i] for i in (179, 180, 539, 540)] == [ALPHA[0], ALPHA[1], ALPHA[2], ALPHA[3]]


def test_daily_pipeline(spark):
    d = series(spark, 120).cache()
    out = pipelines.daily_pipeline(spark, d, "y", ["x1", "x2"], tps=(1,), window=40, replicates=5)
    assert {"overview", "metrics", "scores", "intervals", "seasons", "agreement", "ablation_effect"} <= set(out)
    assert out["scores"].where("p is null").count() == 0 and out["metrics"].count() == 6


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("a_b", 0.12345, 1), ("c&", float("nan"), None)], "name string, v double, n int")
    tex = report.latex_table(d, "cap", "lab")
    assert r"a\_b & 0.1234 & 1 \\" in tex and r"c\& & -- & -- \\" in tex
    assert "longtable" in report.latex_table(d, "c", "l", longtable=True) and report.latex_table(d, "c", "l", max_rows=1).count(r"a\_b") == 1
    report.clear(str(tmp_path / "out"))
    report.save_csv(d, str(tmp_path / "out/t"))
    assert src.results_csv(spark, str(tmp_path / "out/t")).count() == 2
    assert report.manifest(spark, str(tmp_path / "out"), "*.csv").count() == 1
    assert json.loads(report.run_info({"a": 1}, str(tmp_path / "out/run.json")))["options"] == {"a": 1}
    assert report.bundle(str(tmp_path / "out"), str(tmp_path / "b.zip")).endswith("b.zip")
    box = report.boxplot_data(spark.createDataFrame([("g", float(i)) for i in (1, 2, 3, 4, 100)], "k string, v double"), "k", "v").first()
    assert (box["median"], box["high"]) == (3, 4)
    assert all(x.count() for x in report.definitions(spark))


def test_csv_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("dteday,cnt,extra\n2020-01-03,3,z\n2020-01-01,x,y\n")
    s, raw = src.daily_csv(spark, str(tmp_path / "d.csv"), "dteday", ["cnt"])
    assert [(r["t"], r["cnt"]) for r in s.orderBy("t").collect()] == [(1, None), (2, 3.0)] and "extra" in raw.columns
    assert [r["t"] for r in src.daily_csv(spark, str(tmp_path / "d.csv"), "dteday", ["cnt"], time_index="calendar")[0].orderBy("t").collect()] == [1, 3]
    (tmp_path / "h.csv").write_text("year,month,day,hour,pm\n2020,1,1,0,NA\n2020,1,1,1,5\n")
    h = src.hourly_csv(spark, str(tmp_path / "h.csv"), ["pm"]).orderBy("date").collect()
    assert [r["pm"] for r in h] == [None, 5.0]
    assert src.fetch([str(tmp_path / "none"), str(tmp_path / "d.csv")], str(tmp_path / "cache/d.csv")) == src.fetch([], str(tmp_path / "cache/d.csv"))
    with pytest.raises(Exception):
        src.fetch([str(tmp_path / "none")], str(tmp_path / "x"))


def test_empty_series(spark):
    d = series(spark, 5).where("t < 0")
    a = aligned(spark, d)
    assert rolling.scores(a, ["x1"], 3).count() == 0
    assert nulls.series_null(spark, a, ["x1"], 3, [1]).count() == 0
    assert describe.primary(d, ["y"]).count() == 0 and segments.intervals(rolling.scores(a, ["x1"], 3).withColumn("sig", F.lit(True))).count() == 0


def test_synthetic_frame(spark):
    assert synthetic(spark, 50).count() == 50


def test_bundles_and_plot_data(spark, tmp_path):
    d = series(spark, 60)
    sc = pipelines.attribution(spark, aligned(spark, d), ["x1", "x2"], window=20, replicates=5, period=7, n=60)
    paths = report.save_bundle(sc, ["x1", "x2"], str(tmp_path), "e")
    assert len(paths) == 4 and src.results_csv(spark, paths[0]).columns == ["series_id", "t_src", "date_src", "x1", "x2"]
    iv = segments.intervals(sc.withColumn("sig", F.col("feature") == "x1"))
    made = report.save_intervals(iv, str(tmp_path), "e", ["x1", "x2"])
    assert len(made) == 3 and all("x1" in m for m in made)
    preds = forecast.persistence(d, "y", 1)
    assert report.forecast_plot_data(preds, 1, ["B2_persistence"], last=10).count() == 10
    assert report.metric_plot_data(forecast.evaluate(preds)).columns == ["series_id", "model", "tp", "value"]
    assert report.score_plot_data(sc).count() == sc.count()
    none = pipelines.attribution(spark, aligned(spark, d), ["x1"], window=20, replicates=0, period=7, n=60)
    assert none.where("p is not null or sig").count() == 0
    assert report.save_latex(iv, str(tmp_path / "t/x.tex"), "c", "l").endswith("x.tex")
    assert src.unzip(report.bundle(str(tmp_path / "t"), str(tmp_path / "z.zip")), "x.tex", str(tmp_path / "u")).endswith("x.tex")


def test_endpoint_stride_and_periodic_scores(spark):
    d = series(spark, 60)
    a = aligned(spark, d)
    every = {r["t_src"]: r["g"] for r in rolling.scores(a, ["x1"], 20).collect()}
    some = {r["t_src"]: r["g"] for r in rolling.scores(a, ["x1"], 20, 7).collect()}
    assert sorted(some) == list(range(20, 61, 7)) and all(every[t] == g for t, g in some.items())
    assert all(abs(g) <= 1 + 1e-9 for g in every.values())
    eq = rolling.equivalence(a, ["x1", "x2"], 20, 5).collect()
    assert len(eq) == 2 and all(r["max_difference"] < 1e-9 and r["n_windows"] == 9 for r in eq)
