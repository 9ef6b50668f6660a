"""Numpy kernels against plain definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcast.config import AttributionConfig, holdout
from rollcast.functions import kernels
from rollcast.operators import nulls, windowed
from rollcast.sources.synthetic import COLUMNS, system


def test_simplex_follows_a_periodic_series():
    x = np.sin(2 * np.pi * np.arange(200) / 25)
    s = kernels.embed(x, 3)
    got = [kernels.simplex(np.delete(s[2:-1], i - 2, 0), np.delete(x[3:], i - 2), s[i], 4) for i in range(100, 150)]
    assert np.corrcoef(got, x[101:151])[0, 1] > 0.999


def test_simplex_zero_distance_and_empty():
    assert kernels.simplex(np.array([[0.0], [1.0]]), np.array([5.0, 9.0]), np.array([0.0]), 2) == pytest.approx(5, abs=1e-4)
    assert np.isnan(kernels.simplex(np.zeros((0, 1)), np.zeros(0), np.zeros(1), 2))


def test_smap_theta_zero_is_least_squares():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    want = np.linalg.lstsq(np.column_stack([np.ones(50), x]), y, rcond=None)[0]
    pred, beta = kernels.smap(x, y, np.array([0.3, -0.2]), 0.0)
    assert np.allclose(beta, want) and pred == pytest.approx(want @ [1, 0.3, -0.2])


def test_smap_weights():
    rng = np.random.default_rng(1)
    x, y, at = rng.normal(size=(40, 1)), rng.normal(size=40), np.array([0.5])
    d = np.abs(x[:, 0] - 0.5)
    w = np.exp(-2 * d / d.mean())
    for weighting, power in (("w", 2), ("sqrt", 1)):
        a = np.column_stack([np.ones(40), x])
        beta = np.linalg.solve(a.T @ (a * w[:, None] ** power), a.T @ (y * w**power))
        assert np.allclose(kernels.smap(x, y, at, 2.0, weighting)[1], beta)
    assert np.isnan(kernels.smap(x[:1], y[:1], at, 1.0)[0])


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e13])
def test_smap_keeps_small_columns_beside_large_ones(scale):
    """A column of sums as large as a big table's leaves the coefficients of the others alone."""
    rng = np.random.default_rng(3)
    big, small = rng.normal(1, 0.1, 300), rng.normal(0.05, 0.003, 300)
    x, y = np.column_stack([scale * big, small]), scale * (0.5 * big + 3 * small + 0.2)
    pred, beta = kernels.smap(x, y, x[0], 1.0)
    block, betas = kernels.smap_block(x, y, x[:2], np.array([0, 1]), 1.0)
    assert np.allclose(beta / [scale, 1, scale], [0.2, 0.5, 3], atol=1e-6) and pred == pytest.approx(y[0])
    assert np.allclose(betas / [scale, 1, scale], [[0.2, 0.5, 3]] * 2, atol=1e-6) and np.allclose(block, y[:2])
    # a column of zeros and one repeated twice say nothing more, and do not break the map
    more = np.column_stack([x, x[:, 1], np.zeros(300)])
    assert kernels.smap(more, y, more[0], 1.0)[0] == pytest.approx(y[0])


def test_endpoint_needs_rows_and_predicts_a_line():
    t = np.arange(30.0)
    obs, pred = kernels.endpoint(np.column_stack([t, np.cos(t)])[None], 2 * t + 1, 0.5)
    assert obs == 59 and pred[0] == pytest.approx(59, abs=1e-3)
    assert np.isnan(kernels.endpoint(np.ones((1, 5, 2)), np.ones(5), 0.5)[1]).all()
    # a constant column and a repeated row say nothing, and do not break the system
    assert kernels.endpoint(np.ones((1, 30, 2)), np.full(30, 7.0), 0.5)[1][0] == pytest.approx(7)


def test_endpoint_minimises_its_penalised_squares():
    """Against the normal equations of the stated sum, variant by variant, with a missing row."""
    rng = np.random.default_rng(4)
    x, y, theta = rng.normal(size=(3, 41, 3)), rng.normal(size=41), 0.7
    x[1, 7, 0] = np.nan
    obs, got = kernels.endpoint(x, y, theta, ridge=0.01)
    for v in range(3):
        past, now = x[v, :-1], x[v, -1]
        fine = np.isfinite(past).all(1)
        past, nexts = past[fine], y[:-1][fine]
        z, here = (past - past.mean(0)) / past.std(0, ddof=1), (now - past.mean(0)) / past.std(0, ddof=1)
        d = np.linalg.norm(z - here, axis=1)
        k = np.exp(-theta * d / d.mean())
        a = np.column_stack([np.ones(len(z)), z])
        c = 0.01 * max(1, (k[:, None] * a**2).sum() / 4)
        beta = np.linalg.solve(a.T @ (k[:, None] * a) + c * np.diag([0, 1, 1, 1]), a.T @ (k * nexts))
        assert obs == y[-1] and got[v] == pytest.approx(beta[0] + here @ beta[1:], abs=1e-9)


@pytest.mark.parametrize("weighting", ["w", "sqrt"])
def test_blocks_of_points_are_points_one_by_one(weighting):
    rng = np.random.default_rng(6)
    states, targets = rng.normal(size=(60, 2)), rng.normal(size=60)
    states[20:23] = states[10]  # distance 0
    points, own = np.concatenate([states[:30], rng.normal(size=(5, 2))]), np.concatenate([np.arange(30), np.full(5, -1)])
    s, (p, beta) = kernels.simplex_block(states, targets, points, own, 4), kernels.smap_block(states, targets, points, own, 1.5, weighting)
    for i, (x, o) in enumerate(zip(points, own)):
        use = np.arange(60) != o
        want, b = kernels.smap(states[use], targets[use], x, 1.5, weighting)
        assert s[i] == pytest.approx(kernels.simplex(states[use], targets[use], x, 4)) and p[i] == pytest.approx(want) and np.allclose(beta[i], b)
    assert np.isnan(kernels.smap_block(states[:3], targets[:3], states[:3], np.arange(3), 1.0)[0]).all()


def test_synthetic_system():
    s = system()
    assert set(s) == set(COLUMNS) and len(s["y"]) == 900
    assert s["deterministic_signal"][0] == 0 and s["x1"].std() == pytest.approx(1)
    assert [s["true_alpha"][i] for i in (0, 179, 180, 360, 540, 720)] == [0.1, 0.1, 1.0, 0.3, -0.9, 0.2]
    assert np.allclose(s["y"][1:], (s["deterministic_signal"] + s["noise"])[1:])


@pytest.mark.parametrize("n,f,want", [(900, 0.2, 180), (50, 0.2, 16), (20, 0.2, 10)])
def test_holdout(n, f, want):
    assert holdout(n, f) == want


def test_shift_samplers():
    assert set(nulls.periodic_shifts(20, 50, 7)) == {7, 14}
    assert set(nulls.periodic_shifts(5, 50, 7)) <= {1, 2, 3, 4} and nulls.periodic_shifts(1, 5, 7) == []
    assert set(nulls.window_shifts(30, 99, 0, True)) == {7, 14, 21, 28}


@settings(max_examples=30, deadline=None)
@given(st.integers(20, 60), st.integers(0, 10**6))
def test_window_attribution_properties(n, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, 2)), rng.normal(size=n)
    g, l, lo, hi, p = windowed.attribute(x, y, None, AttributionConfig(replicates=19, seed=seed))
    assert np.allclose(g, [np.corrcoef(x[:, j], y)[0, 1] for j in range(2)])
    assert ((p >= 1 / 20) & (p <= 1)).all() and (lo <= hi).all()
    assert np.allclose(l, kernels.zscore(y[:, None])[-1, 0] * g * kernels.zscore(x)[-1])


def test_identity_permutations_count_as_extreme():
    # two runs: half of all orders are the identity, which must not be taken for less extreme
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 1)), rng.normal(size=40)
    labels = np.array(["a"] * 20 + ["b"] * 20)
    cfg = AttributionConfig(replicates=200, block_null="month", date_column="d")
    p = windowed.attribute(x, y, labels, cfg)[4][0]
    index = windowed.null_indices(labels, 40, cfg)
    same = (index == np.arange(40)).all(1).sum()
    assert p >= (same + 1) / 201 > 0.3


def test_constant_feature_scores_zero_in_a_window():
    y = np.arange(30.0)
    g = windowed.attribute(np.column_stack([np.full(30, 0.1), y]), y, None, AttributionConfig(pre_normalize_y=True))[0]
    assert g[0] == pytest.approx(0, abs=1e-9) and g[1] == pytest.approx(1)


def test_block_null_needs_a_date():
    with pytest.raises(ValueError):
        AttributionConfig(block_null="Season").block_mode()
    assert AttributionConfig(block_null="week").block_mode() is None
