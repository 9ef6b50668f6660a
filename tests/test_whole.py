"""Queries that take all of a series, on a small table, against the definitions."""

import datetime

import numpy as np
import pytest

from rollcast.config import AttributionConfig
from rollcast.functions import kernels
from rollcast.operators import forecast, nulls, rolling, windowed
from rollcast.plans.catalogue import QUERIES, X, _aligned

DAYS = 410  # more than one block of prediction points


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with one line a day; x2 follows x1."""
    rng = np.random.default_rng(5)
    x1, x2 = np.zeros(DAYS), np.zeros(DAYS)
    x1[0], x2[0] = 0.4, 0.2
    for t in range(DAYS - 1):
        x1[t + 1], x2[t + 1] = x1[t] * (3.8 - 3.8 * x1[t]), x2[t] * (3.5 - 3.5 * x2[t] - 0.1 * x1[t])
    y, x3 = 1000 * (1 + x2) + rng.normal(0, 50, DAYS), rng.normal(0, 1, DAYS)
    day = [datetime.date(2001, 1, 1) + datetime.timedelta(days=i) for i in range(DAYS)]
    d = str(tmp_path_factory.mktemp("small"))
    rows = [tuple([day[i], *(float(c[i]) for c in (y, x1, x2, x3))]) for i in range(DAYS)]
    spark.createDataFrame(rows, "l_shipdate date, l_extendedprice double, l_discount double, l_quantity double, l_tax double").write.parquet(f"{d}/lineitem.parquet")
    return d, {"y": y, "x1": x1, "x2": x2, "x3": x3}


def brute_ccm(x, y, e, size, samples, seed=42):
    s = kernels.embed(x, e)
    ok = np.flatnonzero(np.isfinite(s).all(1) & np.isfinite(y))
    out = []
    for r in range(samples):
        lib = np.sort(np.random.default_rng([seed, size, r]).choice(ok, min(size, len(ok)), replace=False))
        p = np.array([kernels.simplex(s[lib[lib != i]], y[lib[lib != i]], s[i], e + 1) for i in ok])
        fine = np.isfinite(p)
        out.append(np.corrcoef(p[fine], y[ok][fine])[0, 1])
    return np.mean(out)


def test_cross_map_against_loop(spark, small):
    c = {k: v.copy() for k, v in small[1].items()}
    c["x1"][100:140] = c["x1"][60:100]  # states at distance 0
    c["x2"][300] = np.nan
    d = spark.createDataFrame([("a", i + 1, float(c["x1"][i]), None if np.isnan(c["x2"][i]) else float(c["x2"][i])) for i in range(DAYS)], "series_id string, t long, x1 double, x2 double").repartition(3)
    for r in forecast.cross_map(d, "x1", "x2", 2, (2, 30, 400), samples=3).collect():
        assert r["rho_ab"] == pytest.approx(brute_ccm(c["x1"], c["x2"], 2, r["lib_size"], 3), abs=1e-9)
        assert r["rho_ba"] == pytest.approx(brute_ccm(c["x2"], c["x1"], 2, r["lib_size"], 3), abs=1e-9)


def test_ccm_takes_the_whole_series(spark, small):
    got = {r["lib_size"]: r for r in QUERIES["q_ccm"](spark, small[0]).collect()}
    assert sorted(got) == list(range(10, DAYS - 4, 10))
    c = small[1]
    assert got[400]["rho_ab"] == pytest.approx(brute_ccm(c["x1"], c["x2"], 2, 400, 100), abs=1e-9)


def test_forecasts_of_all_held_out_rows(spark, small):
    d, c = small
    (_, end), (first, last) = forecast.split(DAYS)
    assert last == DAYS
    x = c["x2"]
    for name in ("q_simplex", "q_smap_theta0", "q_smap_1d", "q_smap"):
        assert sorted(r["t_pred"] for r in QUERIES[name](spark, d).collect()) == list(range(first + 1, last + 2))
    s = kernels.embed(x, 2)
    for r in QUERIES["q_simplex"](spark, d).collect():
        i = r["t_pred"] - 2
        assert r["pred"] == pytest.approx(kernels.simplex(s[1:end], x[2 : end + 1], s[i], 3), abs=1e-5)
    rho = {r["e"]: r["rho"] for r in QUERIES["q_embed_dimension"](spark, d).collect()}
    assert sorted(rho) == list(range(1, 11))
    s = kernels.embed(x, 7)
    p = [kernels.simplex(s[6:end], x[7 : end + 1], s[i], 8) for i in range(end, DAYS - 1)]
    assert rho[7] == pytest.approx(np.corrcoef(p, x[end + 1 :])[0, 1], abs=1e-5)
    best = QUERIES["q_param_select"](spark, d).first()
    assert best["rho"] == max(rho.values())
    sweep = QUERIES["q_theta_sweep"](spark, d).collect()
    assert len(sweep) == 8 and {r["n"] for r in sweep} == {DAYS - 1 - end}


def test_coefficients_of_all_held_out_rows(spark, small):
    (_, end), _ = forecast.split(DAYS)
    assert {r["n"] for r in QUERIES["q_smap_coefficients"](spark, small[0]).collect()} == {DAYS - end}


@pytest.mark.parametrize("options", [{}, {"preserve_weekly": True}, {"block_null": "month", "date_column": "date_src"}])
def test_rolling_nulls_equal_the_relational_form(spark, small, options):
    cfg = AttributionConfig(window=40, replicates=9, seed=4, **options)
    a = _aligned(spark, small[0]).where("t_src <= 120")
    m = rolling.windows(a, 40)
    want = nulls.compare(rolling.inverse_operator(m, X, normalize_y=True), nulls.window_null(spark, m, X, cfg), ["series_id", "e", "feature"], 9)
    want = {(r["e"], r["feature"]): [r[c] for c in ("g", "lo", "hi", "p")] for r in want.collect()}
    got = {(r["e"], r["feature"]): [r[c] for c in ("g", "lo", "hi", "p")] for r in windowed.rolling_nulls(a, X, cfg).collect()}
    assert set(got) == set(want) and len(got) == 81 * 3
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_every_window_end(spark, small):
    ends = list(range(90, DAYS + 1))
    for name in ("q_window_null_uniform_whole", "q_inverse_operator_raw"):
        assert sorted(r["e"] for r in QUERIES[name](spark, small[0]).where("feature = 'x1'").collect()) == ends
    null = QUERIES["q_circular_null_whole"](spark, small[0]).where("feature = 'x2'").groupBy("t_src").count().collect()
    assert sorted(r["t_src"] for r in null) == ends and {r["count"] for r in null} == {1000}
    assert {r["n_windows"] for r in QUERIES["q_equivalence"](spark, small[0]).collect()} == {len(ends)}
    t = [r["t_pred"] for r in QUERIES["q_windowed_attribution"](spark, small[0]).where("feature = 'x1'").collect()]
    assert len(t) == len(set(t)) == DAYS - 59
