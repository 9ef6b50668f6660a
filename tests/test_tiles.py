"""Tiles of states against the kernels; ranges of one series against whole windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcast.functions import kernels
from rollcast.operators import calendar, fdr, forecast, ranges, rolling, segments, tiles


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.round(np.cumsum(rng.normal(size=n)) * 0.1 + np.sin(np.arange(n) / 5), 2)


@pytest.fixture(scope="module")
def series(spark):
    values = {"a": walk(300), "b": walk(260, 1), "c": np.full(40, 2.5)}  # of equal states, too
    rows = [(s, i + 1, float(v)) for s, x in values.items() for i, v in enumerate(x)]
    return values, spark.createDataFrame(rows, "series_id string, t long, y double").repartition(3).cache()


def test_states_at_range_ends(series):
    values, d = series
    for lags, tp, size in ((3, 1, 50), (1, 7, 64), (4, 0, 7)):
        for r in tiles.states(d, "y", tp, lags=lags, size=size).collect():
            x = values[r["series_id"]]
            assert [np.nan if v is None else v for v in r["x"]] == pytest.approx(list(kernels.embed(x, lags)[r["t"] - 1]), nan_ok=True)
            assert r["y"] == (x[r["t"] - 1 + tp] if r["t"] - 1 + tp < len(x) else None)


@pytest.mark.parametrize("ks", [[(2, 3)], [(1, 2), (2, 3), (3, 9)]])
def test_neighbours_in_small_tiles(series, ks):
    values, d = series
    st = tiles.states(d, "y", 1, lags=3)
    lib, points = st.where("t <= 230 and y is not null"), st.where("t > 200 or t < 4")
    got = tiles.nearest(points, lib, ks, tile=20).collect()
    found = {}
    for r in got:
        found.setdefault((r["series_id"], r["t"], r["e"]), []).append((r["d"], r["t_lib"]))
    for s, x in values.items():
        for e, k in ks:
            emb = kernels.embed(x, e)
            lib_at = [i for i in range(e - 1, min(230, len(x) - 1))]
            for i in [*range(0, 3), *range(200, len(x))]:
                if not np.isfinite(emb[i]).all():
                    assert (s, i + 1, e) not in found
                    continue
                want = sorted((float(np.sqrt(((emb[j] - emb[i]) ** 2).sum())), j + 1) for j in lib_at if j != i)[:k]
                have = sorted(found.get((s, i + 1, e), []))
                assert [t for _, t in have] == [t for _, t in want], (s, i, e)
                assert [v for v, _ in have] == pytest.approx([v for v, _ in want])


def test_pruned_tiles_are_not_searched(spark):
    """On a long series of two coordinates few cells of the tiles are needed."""
    rng = np.random.default_rng(3)
    lo = rng.uniform(size=(400, 2))
    grid = np.stack(np.meshgrid(np.arange(20), np.arange(20)), -1).reshape(-1, 2) / 20
    valid, hi = np.full((400, 2), 500), grid + 0.05
    shares = []
    for p in lo[:50]:
        need, least = tiles.wanted(p, p + 0.05, grid, hi, valid, [(2, 3)])
        shares.append(len(need) / 400)
        inside = ((grid <= p + 0.05) & (hi >= p)).all(1)
        assert set(np.flatnonzero(inside)) <= set(need)
    assert np.mean(shares) < 0.1


def test_local_maps_in_small_tiles(series):
    values, d = series
    st = tiles.states(d, "y", 1, lags=2).where("t >= 2")
    lib, points = st.where("t <= 200 and y is not null"), st.where("t > 200 or t between 10 and 20").withColumn("thetas", F.array(F.lit(0.0), F.lit(3.0)))
    for power, weighting in ((2.0, "w"), (1.0, "sqrt")):
        for r in tiles.local_maps(points.where("series_id <> 'c'"), lib, 2, tile=64, power=power).collect():
            x = values[r["series_id"]]
            e, use = kernels.embed(x, 2), np.arange(1, 200)
            use = use[use != r["t"] - 1]
            pred, beta = kernels.smap(e[use], x[use + 1], e[r["t"] - 1], [0.0, 3.0][r["which"]], weighting)
            assert r["pred"] == pytest.approx(pred, abs=1e-8) and r["coefficients"] == pytest.approx(list(beta), abs=1e-7)
    same = tiles.local_maps(points.where("series_id = 'c'"), lib, 2, tile=64).collect()
    assert all(r["pred"] == pytest.approx(2.5) for r in same)


def test_forecast_of_a_short_series_is_null(spark):
    d = spark.createDataFrame([("a", i, float(i % 3)) for i in range(1, 5)], "series_id string, t long, y double")
    got = forecast.run_models(d, [{"model": "smap", "kind": "univariate", "e": 3, "theta": 1.0, "tp": 1}, {"model": "simplex", "kind": "univariate", "e": 2, "tp": 1}], "y", [], (1, 3), (4, 4)).collect()
    assert {(r["model"], r["t_pred"]) for r in got} == {("smap_univariate", 5), ("simplex_univariate", 5)}
    assert next(r for r in got if r["model"] == "smap_univariate")["pred"] is None


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(ranges, "SIZE", 16)
    monkeypatch.setattr(rolling, "SIZE", 16)


def test_ranges_equal_whole_windows(spark, small):
    rng = np.random.default_rng(5)
    rows = [(s, int(t), None if rng.random() < 0.4 else float(v)) for s in ("a", None) for t, v in zip(np.sort(rng.choice(400, 90, replace=False)) - 100, walk(90, 7))]
    d = spark.createDataFrame(rows, "series_id string, t long, v double").repartition(4)
    w = Window.partitionBy("series_id").orderBy("t")
    at = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    want = d.select("series_id", "t", "v", F.row_number().over(w).cast("long").alias("i"), F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("k_before"), F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("k_after"))
    got = ranges.known(ranges.numbered(d, ["series_id"], "t"), ["series_id"], "t", {"k": at}).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    dates = d.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t").cast("int"))).withColumn("ts", F.timestamp_seconds(F.col("t") * 300))
    for order in ("d", "ts"):
        assert sorted(r["i"] for r in ranges.numbered(dates, ["series_id"], order).where("series_id = 'a'").collect()) == list(range(1, 91))


def test_rolling_in_ranges(spark, small):
    x, y = walk(100, 2), walk(100, 3)
    rows = [("a", "f", int(i * 2), float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "series_id string, feature string, t_src long, x double, pred double").repartition(3)
    got = {r["t_src"] // 2: r for r in rolling.rolling_moments(rolling.rolling_corr(d, "x", "pred", 7, "t_src"), ["x"], 7, "t_src").collect()}
    assert len(got) == 100
    for i in range(100):
        if i < 6:
            assert got[i]["g"] is None and got[i]["x_mean"] is None
        else:
            assert got[i]["g"] == pytest.approx(np.corrcoef(x[i - 6 : i + 1], y[i - 6 : i + 1])[0, 1])
            assert got[i]["x_mean"] == pytest.approx(x[i - 6 : i + 1].mean()) and got[i]["x_sd"] == pytest.approx(x[i - 6 : i + 1].std())


def test_interpolation_and_islands_in_ranges(spark, small):
    rows = [("a", h, float(h) if h % 40 in (0, 3) else None) for h in range(200)]
    d = spark.createDataFrame(rows, "series_id string, h long, v double").repartition(4)
    got = {r["h"]: r["v"] for r in calendar.interpolate(d, ["v"], None, "h").collect()}
    assert all(got[h] == pytest.approx(min(h, 163)) for h in range(200))
    limited = {r["h"]: r["v"] for r in calendar.interpolate(d, ["v"], 2, "h").collect()}
    assert limited[5] == pytest.approx(5) and limited[20] is None and limited[38] == pytest.approx(38)
    flags = spark.createDataFrame([("a", "f", i, i % 30 < 20 and i % 7 != 0) for i in range(200)], "series_id string, feature string, date_src long, sig boolean").repartition(3)
    runs = {}
    for r in segments.islands(flags).collect():
        runs.setdefault(r["island"], []).append(r["date_src"])
    want, last = [], None
    for i in range(200):
        if i % 30 < 20 and i % 7:
            want.append([i]) if last != i - 1 else want[-1].append(i)
            last = i
    assert sorted(sorted(x) for x in runs.values()) == want


def test_fdr_of_a_large_family(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(size=150), np.round(rng.uniform(0, 0.02, 60), 3), [0.0, 0.0, 1.0]])
    rows = [("a", "f", i, float(v)) for i, v in enumerate(p)] + [("a", "f", 900, None), ("a", None, 1, 0.001), ("b", "f", 1, 0.9)]
    d = spark.createDataFrame(rows, "series_id string, feature string, t_src long, p double").repartition(4)
    for missing in (False, True):
        got = {(r["series_id"], r["feature"], r["t_src"]): r["sig"] for r in fdr.benjamini_hochberg(d, ["series_id", "feature"], 0.05, count_missing=missing).collect()}
        s = np.sort(p)
        ok = s <= 0.05 * np.arange(1, len(s) + 1) / (len(s) + missing)
        cut = s[np.flatnonzero(ok)[-1]]
        assert len(got) == len(rows) and all(got["a", "f", i] == (v <= cut) for i, v in enumerate(p))
        assert not got["a", "f", 900] and got["a", None, 1] and not got["b", "f", 1]


def test_envelope_of_all_replicates_at_once(spark, monkeypatch):
    """Equal to the relational null, replicate by replicate, with missing and constant values."""
    from rollcast.operators import align, nulls

    monkeypatch.setattr(nulls, "ENDS", 32)
    monkeypatch.setattr(nulls, "CELLS", 200)
    x, y = walk(90, 2), walk(90, 3)
    y[20:40] = 1.25
    rows = [(s, i + 1, None if i == 60 else float(u), float(v) * 1e6, None if s == "b" and i == 5 else float(v)) for s in ("a", "b") for i, (u, v) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "series_id string, t long, x1 double, x2 double, y double").withColumn("date", F.col("t")).repartition(3)
    a = align.by_source_time(d, forecast.persistence(d, "y", 1, beyond=True), ["x1", "x2"], 1).cache()
    shifts, on = nulls.periodic_shifts(90, 60, 7), ["series_id", "feature", "t_src"]
    observed = rolling.scores(a, ["x1", "x2"], 12).cache()
    want = nulls.compare(observed, nulls.series_null(spark, a, ["x1", "x2"], 12, shifts), on, 60)
    key = lambda r: (r["series_id"], r["feature"], r["t_src"])
    want = {key(r): r for r in want.collect()}
    got = {key(r): r for r in nulls.series_envelope(spark, a, observed, ["x1", "x2"], 12, shifts).collect()}
    assert set(got) == set(want) and len(got) == 2 * 79 + 2 * 78
    for k, r in want.items():
        for c in ("lo", "hi", "p"):
            assert got[k][c] == (None if r[c] is None else pytest.approx(r[c], abs=1e-8)), (k, c)
