"""Rolling attribution with a forecast refitted inside every window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import AttributionConfig
from ..functions import kernels
from ..functions.scalar import block_label
from .nulls import DIGITS, run_orders, window_shifts

BLOCK = 32  # window ends of one task


@lru_cache(64)
def _shifts(n: int, replicates: int, seed: int, weekly: bool) -> list[int]:
    return window_shifts(n, replicates, seed, weekly)


@lru_cache(64)
def _orders(k: int, replicates: int, seed: int) -> np.ndarray:
    return np.array([r[3] for r in run_orders(k, replicates, seed) if r[0] == k]).reshape(replicates, k)


def null_indices(labels: np.ndarray | None, n: int, cfg: AttributionConfig) -> np.ndarray:
    """(replicates, n): where each row of a permuted window comes from."""
    if labels is None:
        shifts = np.array(_shifts(n, cfg.replicates, cfg.seed, cfg.preserve_weekly), np.int64).reshape(-1, 1)
        return (np.arange(n)[None] - shifts) % n
    cut = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1], [True]]))
    runs = [np.arange(a, b) for a, b in zip(cut[:-1], cut[1:])]
    return np.array([np.concatenate([runs[i] for i in o]) for o in _orders(len(runs), cfg.replicates, cfg.seed)])


def attribute(x: np.ndarray, y: np.ndarray, labels: np.ndarray | None, cfg: AttributionConfig):
    """(g, l, lo, hi, p) by feature of one window's features (n, p) and forecasts (n,). Without
    parity the score and its null have one scale: both z-score the forecast."""
    zx = kernels.zscore(x)
    zy = kernels.zscore(y[:, None])[:, 0]
    own = zy if cfg.pre_normalize_y or (cfg.replicates and not cfg.parity) else y
    square = own @ own
    g = zx.T @ own / square if square > 0 else np.full(x.shape[1], np.nan)
    local = own[-1] * g * zx[-1]
    none = np.full(len(g), np.nan)
    if not cfg.replicates:
        return g, local, none, none, none
    null = zy[null_indices(labels, len(y), cfg)] @ zx / (zy @ zy + cfg.ridge)
    lo, hi = np.quantile(null, [0.025, 0.975], axis=0)
    if cfg.parity:
        count = (np.abs(null) >= np.abs(g)).sum(0)
        return g, local, lo, hi, (count + 1.0) / (cfg.replicates + 1.0)
    count = (np.abs(np.round(null, DIGITS)) >= np.abs(np.round(g, DIGITS))).sum(0)
    return g, local, lo, hi, np.where(np.isnan(g), np.nan, (count + 1.0) / (cfg.replicates + 1.0))


def rolling_windows(series: DataFrame, features: Sequence[str], target: str, cfg: AttributionConfig, *, e: int | None = None, theta: float = 0.0, embedded: bool = True, keys: Sequence[str] = ("series_id",), step: int = 1) -> DataFrame:
    """(keys, t_pred, feature, g, l, lo, hi, p) at every window end.

    In each window of cfg.window rows a local linear map of the features (embedded) or of e
    lags of the first of them forecasts the target cfg.tp steps on, leaving each row out of
    its own library. Features are aligned with these forecasts, z-scored, and scored; the
    result stands at the last forecast's time. Windows are dealt to tasks in blocks of
    BLOCK ends, with the rows that these need. lo, hi and p are null without replicates.
    Rows with missing values are left out of a window; a window without forecasts has no
    rows."""
    mode = cfg.block_mode()
    w = Window.partitionBy(*keys)
    d = series.withColumn("__i", F.row_number().over(w.orderBy("t"))).withColumn("__n", F.count(F.lit(1)).over(w))
    label = block_label(F.col(cfg.date_column), mode) if mode else F.lit(None).cast("string")
    # block b holds the ends window + b * span .. + span - 1, so rows from b * span + 1
    span, size = BLOCK * step, cfg.window
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - size - span + 1) / span)).cast("long")
    last = F.floor((F.col("__i") - 1) / span).cast("long")
    cols = list(dict.fromkeys([target, *features]))
    d = d.select(*keys, "t", "__i", "__n", label.alias("__label"), *[F.col(c).cast("double").alias(c) for c in cols], F.explode(F.sequence(first, last)).alias("__b"))
    types, options = dict(series.dtypes), asdict(cfg)

    def one(key, pdf):
        c = AttributionConfig(**options)
        pdf = pdf.sort_values("__i")
        i, t = pdf["__i"].to_numpy(), pdf["t"].to_numpy()
        x, y = pdf[list(features)].to_numpy(float), pdf[target].to_numpy(float)
        labels = pdf["__label"].to_numpy() if mode else None
        out = []
        begin = size + key[-1] * span
        for end in range(begin, min(begin + span - 1, int(pdf["__n"].iloc[0])) + 1, step):
            at = np.flatnonzero((i > end - size) & (i <= end))
            if len(at) < size:
                continue
            xs, ys = x[at], y[at]
            states = xs if embedded else kernels.embed(xs[:, 0], e or 1)
            ahead = np.full(size, np.nan)
            ahead[: size - c.tp] = ys[c.tp :]
            whole = np.isfinite(states).all(1)
            lib = whole & np.isfinite(ahead)
            yhat = np.full(size, np.nan)
            own = np.where(lib, np.cumsum(lib) - 1, -1)[whole]
            yhat[whole] = kernels.smap_block(states[lib], ahead[lib], states[whole], own, theta)[0]
            ok = np.flatnonzero(np.isfinite(yhat) & np.isfinite(xs).all(1))
            if not len(ok):
                continue
            res = attribute(xs[ok], yhat[ok], labels[at][ok] if mode else None, c)
            stamp = int(t[at][ok[-1]]) + c.tp
            out += [(*key[:-1], stamp, f, *(None if np.isnan(v[j]) else float(v[j]) for v in res)) for j, f in enumerate(features)]
        return pd.DataFrame(out, columns=[*keys, "t_pred", "feature", "g", "l", "lo", "hi", "p"])

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "t_pred long, feature string, g double, l double, lo double, hi double, p double"])
    return d.groupBy(*keys, "__b").applyInPandas(one, schema)


def rolling_nulls(aligned: DataFrame, features: Sequence[str], cfg: AttributionConfig, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, e, feature, g, lo, hi, p) at every window end of a forecast that is given: what
    `rolling.inverse_operator` (z-scored) and `nulls.window_null` give, without a row for each
    member and replicate. Windows are dealt to tasks in blocks of BLOCK ends. Incomplete rows
    are left out of a window."""
    mode = cfg.block_mode()
    w = Window.partitionBy(*keys)
    d = aligned.withColumn("__i", F.row_number().over(w.orderBy("t_src"))).withColumn("__n", F.count(F.lit(1)).over(w))
    label = block_label(F.col(cfg.date_column), mode) if mode else F.lit(None).cast("string")
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - cfg.window - BLOCK + 1) / BLOCK)).cast("long")
    last = F.floor((F.col("__i") - 1) / BLOCK).cast("long")
    d = d.select(*keys, "__i", "__n", label.alias("__label"), *[F.col(c).cast("double").alias(c) for c in ("pred", *features)], F.explode(F.sequence(first, last)).alias("__b"))
    types, options = dict(aligned.dtypes), asdict(cfg)

    def one(key, pdf):
        c = AttributionConfig(**options)
        pdf = pdf.sort_values("__i")
        i, x, y = pdf["__i"].to_numpy(), pdf[list(features)].to_numpy(float), pdf["pred"].to_numpy(float)
        whole, out = np.isfinite(x).all(1) & np.isfinite(y), []
        labels = pdf["__label"].to_numpy() if mode else None
        begin = c.window + key[-1] * BLOCK
        for end in range(begin, min(begin + BLOCK - 1, int(pdf["__n"].iloc[0])) + 1):
            at = np.flatnonzero((i > end - c.window) & (i <= end) & whole)
            if len(at):
                g, _, *res = attribute(x[at], y[at], labels[at] if mode else None, c)
                out += [(*key[:-1], end, f, *(None if np.isnan(v[j]) else float(v[j]) for v in (g, *res))) for j, f in enumerate(features)]
        return pd.DataFrame(out, columns=[*keys, "e", "feature", "g", "lo", "hi", "p"])

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "e long, feature string, g double, lo double, hi double, p double"])
    return d.groupBy(*keys, "__b").applyInPandas(one, schema)
