"""The synthetic system with a known answer: two coefficients that switch in time."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.kernels import zscore

# The regimes' first rows, whatever the length, and their coefficients.
SWITCHES = (0, 180, 360, 540, 720)
ALPHA = (0.10, 1.00, 0.30, -0.90, 0.20)
BETA = (0.80, -0.70, 0.20, 0.90, -0.80)
CARRY, CROSS, NOISE, SEASONAL, SEASON_ROWS = 0.35, 0.05, 0.10, 0.05, 90
COLUMNS = ("y", "x1", "x2", "true_alpha", "true_beta", "deterministic_signal", "noise")


def system(n: int = 900, seed: int = 0) -> dict[str, np.ndarray]:
    """The columns as arrays: y[t+1] = alpha x1[t] + beta x2[t] + seasonal + noise, with two
    weakly coupled autoregressive drivers. The recursion is sequential, so it runs here."""
    rng = np.random.default_rng(seed)
    regime = np.searchsorted(SWITCHES, np.arange(n), "right") - 1
    alpha, beta = np.array(ALPHA)[regime], np.array(BETA)[regime]
    shock = rng.standard_normal((2, n))
    drive = np.zeros((2, n))
    for t in range(1, n):
        drive[0, t] = CARRY * drive[0, t - 1] + shock[0, t]
        drive[1, t] = CARRY * drive[1, t - 1] + CROSS * drive[0, t] + np.sqrt(1 - CROSS**2) * shock[1, t]
    x1, x2 = zscore(drive[0]), zscore(drive[1])
    noise = NOISE * rng.standard_normal(n)
    wave = SEASONAL * np.sin(2 * np.pi * np.arange(n) / SEASON_ROWS)
    signal = np.concatenate([[0.0], (alpha * x1 + beta * x2 + wave)[:-1]])
    y = np.concatenate([[0.0], (signal + noise)[1:]])
    return dict(zip(COLUMNS, (y, x1, x2, alpha, beta, signal, noise)))


def synthetic(spark: SparkSession, n: int = 900, seed: int = 0, series_id: str = "all") -> DataFrame:
    """(series_id, t, date, COLUMNS): one row a day from 2000-01-01."""
    first, cols = datetime.date(2000, 1, 1), system(n, seed)
    rows = [(series_id, i + 1, first + datetime.timedelta(days=i), *(float(cols[c][i]) for c in COLUMNS)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, t long, date date, " + ", ".join(f"{c} double" for c in COLUMNS))
