"""Numpy kernels of the forecasters: the only parts that SQL cannot express well."""

from __future__ import annotations

import numpy as np


def distances(states: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((states - point) ** 2).sum(1))


def simplex(states: np.ndarray, targets: np.ndarray, point: np.ndarray, k: int) -> float:
    """Mean of the targets of the k nearest states, weighted by exp(-d / d_min), 1e-6 at least;
    if the nearest is at distance 0, such states weigh 1 and the others 1e-6."""
    d = distances(states, point)
    near = np.argsort(d, kind="stable")[:k]
    d = d[near]
    if not len(d):
        return np.nan
    w = np.maximum(np.exp(-d / d[0]), 1e-6) if d[0] > 0 else np.where(d == 0, 1.0, 1e-6)
    return float(w @ targets[near] / w.sum())


class Neighbours:
    """The rows of `states` by distance to each of the rows `at`, sorted once, so that the
    simplex of many libraries needs no further distances. A row is not its own neighbour."""

    def __init__(self, states: np.ndarray, at: np.ndarray):
        n = len(states)
        self.order = np.zeros((len(at), max(n - 1, 0)), np.int32)
        self.d = np.zeros(self.order.shape)
        for r, i in enumerate(at):
            d = distances(states, states[i])
            o = np.argsort(d, kind="stable")
            o = o[o != i]
            self.order[r], self.d[r] = o, d[o]

    def first(self, member: np.ndarray, k: int) -> np.ndarray:
        """(points, k): places in the order of the k nearest members; -1 where there are fewer."""
        points, n = self.order.shape
        out = np.full((points, k), -1)
        rows, size = np.arange(points), int(member.sum())
        c = min(n, 4 * k * (n + 1) // max(size, 1) + 1)
        while len(rows) and n:
            hit = member[self.order[rows, :c] if len(rows) < points else self.order[:, :c]]
            each = np.arange(len(rows))
            for j in range(k):
                place = hit.argmax(1)
                found = hit[each, place]
                out[rows, j] = np.where(found, place, -1)
                hit[each, place] = False
            if c == n:
                break
            rows, c = rows[out[rows, k - 1] < 0], min(n, 4 * c)
        return out

    def simplex(self, member: np.ndarray, targets: np.ndarray, k: int) -> np.ndarray:
        """`simplex` of each point with the members as its library."""
        place = self.first(member, k)
        if not self.order.shape[1]:
            return np.full(len(place), np.nan)
        there, each = place >= 0, np.arange(len(place))[:, None]
        d = self.d[each, place]
        d0 = d[:, :1]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(d0 > 0, np.maximum(np.exp(-d / d0), 1e-6), np.where(d == 0, 1.0, 1e-6)) * there
            return (w * targets[self.order[each, place]]).sum(1) / w.sum(1)


def smap(states: np.ndarray, targets: np.ndarray, point: np.ndarray, theta: float, weighting: str = "w", ridge: float = 0.0) -> tuple[float, np.ndarray]:
    """(forecast, coefficients with the intercept first) of the linear map that is fitted with
    weights exp(-theta * d / mean d). weighting `w` multiplies the rows by the weight, `sqrt`
    by its root. NaN without enough states."""
    p = states.shape[1] + 1
    if len(states) < p:
        return np.nan, np.full(p, np.nan)
    d = distances(states, point)
    mean = d.mean()
    w = np.exp(-theta * d / mean) if mean > 0 else np.ones(len(d))
    w = w if weighting == "w" else np.sqrt(w)
    a = np.column_stack([np.ones(len(states)), states]) * w[:, None]
    if ridge:
        beta = np.linalg.pinv(a.T @ a + ridge * np.diag([0.0] + [1.0] * (p - 1))) @ (a.T @ (targets * w))
    else:
        size = sizes(states)
        beta = np.linalg.lstsq(a / size, targets * w, rcond=None)[0] / size
    return float(beta[0] + point @ beta[1:]), beta


def sizes(states: np.ndarray) -> np.ndarray:
    """The largest absolute value of the intercept and each column (1 where all are 0). Columns
    divided by it are of one size, so none is lost as rounding beside a column of large
    values, such as sums that grow with the data. Columns that depend on each other have
    the least-norm coefficients of the divided ones."""
    most = np.abs(states).max(0)
    return np.concatenate([[1.0], np.where(most > 0, most, 1.0)])


def weights(d: np.ndarray, theta: float, weighting: str = "w") -> np.ndarray:
    """(points, states) from distances; infinite ones weigh nothing and are not in the mean."""
    there = np.isfinite(d)
    n = there.sum(1, keepdims=True)
    mean = np.where(there, d, 0).sum(1, keepdims=True) / np.maximum(n, 1)
    w = np.where(there, np.exp(-theta * np.where(there, d, 0) / np.where(mean > 0, mean, 1)), 0)
    w = np.where(mean > 0, w, there)
    return w if weighting == "w" else np.sqrt(w)


def apart(states: np.ndarray, points: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(points, states): distances; infinite from a point to the state `own` that is itself (-1:
    none)."""
    d = np.sqrt(((points[:, None] - states[None]) ** 2).sum(2))
    mine = own >= 0
    d[np.flatnonzero(mine), own[mine]] = np.inf
    return d


def simplex_block(states: np.ndarray, targets: np.ndarray, points: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """`simplex` of each point, without its own state."""
    d = apart(states, points, own)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(d, near, 1)
    if not d.shape[1]:
        return np.full(len(points), np.nan)
    there, d0 = np.isfinite(d), d[:, :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(d0 > 0, np.maximum(np.exp(-d / d0), 1e-6), np.where(d == 0, 1.0, 1e-6)) * there
        return np.where(there, w * targets[near], 0).sum(1) / w.sum(1)


def smap_block(states: np.ndarray, targets: np.ndarray, points: np.ndarray, own: np.ndarray, theta: float, weighting: str = "w") -> tuple[np.ndarray, np.ndarray]:
    """`smap` of each point, without its own state: one stacked least-squares solution."""
    p = states.shape[1] + 1
    if not len(points) or len(states) < p:
        return np.full(len(points), np.nan), np.full((len(points), p), np.nan)
    d, size = apart(states, points, own), sizes(states)
    w = weights(d, theta, weighting)
    rows = (np.column_stack([np.ones(len(states)), states]) / size)[None] * w[:, :, None]
    beta = (np.linalg.pinv(rows, rcond=np.finfo(float).eps * max(rows.shape[1:])) @ (w * targets)[:, :, None])[:, :, 0] / size
    beta[np.isfinite(d).sum(1) < p] = np.nan
    return beta[:, 0] + (points * beta[:, 1:]).sum(1), beta


# The fewest complete rows, and rows beyond the columns, of an endpoint forecast,
# and the deviation below which a column is constant.
ENDPOINT_ROWS, ENDPOINT_SPARE, CONSTANT = 8, 3, 1e-12


def endpoint(windows: np.ndarray, nexts: np.ndarray, theta: float, ridge: float = 1e-6) -> tuple[float, np.ndarray]:
    """(observed, forecasts) of the last row's next value, a forecast for each variant of a window
    in `windows` (variants, rows, columns), from the rows before the last.

    Each minimises sum k_i (y_i - b_0 - b z_i)^2 + c |b|^2 over the complete rows, where z are
    their z-scores (sample deviation), k = exp(-theta d / mean positive d) with d the
    distance to the last row, and c is `ridge` times the mean square of the weighted
    columns (1 at least). The penalty is written as more rows of a least-squares system,
    and the systems of all variants are solved at once. NaN with too few complete rows."""
    past, now, obs = windows[:, :-1], windows[:, -1], float(nexts[-1])
    variants, _, columns = past.shape
    fine = np.isfinite(past).all(2) & np.isfinite(nexts[:-1])
    enough = (fine.sum(1) >= max(ENDPOINT_ROWS, columns + ENDPOINT_SPARE)) & np.isfinite(now).all(1) & np.isfinite(obs)
    if not enough.any():
        return np.nan, np.full(variants, np.nan)
    n = np.maximum(fine.sum(1), 2)[:, None]
    centre = np.where(fine[:, :, None], past, 0).sum(1) / n
    z = np.where(fine[:, :, None], past - centre[:, None], 0)
    spread = np.sqrt((z**2).sum(1) / (n - 1))
    spread = np.where(spread > CONSTANT, spread, 1.0)
    z, here = z / spread[:, None], np.where(enough[:, None], (now - centre) / spread, 0)
    d = np.sqrt(((z - here[:, None]) ** 2).sum(2))
    far = fine & (d > 0)
    scale = np.where(far.any(1), np.where(far, d, 0).sum(1) / np.maximum(far.sum(1), 1), 1.0)
    k = np.exp(-theta * d / scale[:, None]) * fine
    root = np.sqrt(np.where(k.sum(1, keepdims=True) > 0, k, fine))
    data = np.concatenate([root[:, :, None], z * root[:, :, None]], 2)
    c = ridge * np.maximum(1.0, (data**2).sum((1, 2)) / (columns + 1))
    penalty = np.sqrt(c)[:, None, None] * np.eye(columns, columns + 1, 1)[None]
    right = np.concatenate([root * np.where(fine, nexts[:-1], 0), np.zeros((variants, columns))], 1)
    beta = (np.linalg.pinv(np.concatenate([data, penalty], 1)) @ right[:, :, None])[:, :, 0]
    return obs, np.where(enough, beta[:, 0] + (here * beta[:, 1:]).sum(1), np.nan)


def embed(x: np.ndarray, e: int) -> np.ndarray:
    """Rows (x_t, x_{t-1}, ..., x_{t-e+1}); the first e - 1 are NaN."""
    out = np.full((len(x), e), np.nan)
    for j in range(e):
        out[j:, j] = x[: len(x) - j]
    return out


def zscore(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
