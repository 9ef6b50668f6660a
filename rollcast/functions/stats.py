"""Aggregate expressions with null for every undefined result.

All divide with try_divide: a built-in correlation raises on zero variance under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def skewness(x: Column) -> Column:
    """Bias-adjusted skewness; null below three values or without variance."""
    n = F.count(x).cast("double")
    g = F.when(F.stddev_pop(x) > 0, F.skewness(x))
    return F.when(n > 2, F.try_divide(g * F.sqrt(n * (n - 1)), n - 2))


def kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; null below four values or without variance."""
    n = F.count(x).cast("double")
    g = F.when(F.stddev_pop(x) > 0, F.kurtosis(x))
    return F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * g + 6), (n - 2) * (n - 3)))


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """x and y where neither is null."""
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def safe_corr(x: Column, y: Column) -> Column:
    """Pairwise Pearson correlation; null below three pairs or without variance. A deviation below
    TINY of the largest value is rounding, not variance."""
    x, y = both(x, y)
    varies = (F.stddev_pop(x) > TINY * F.max(F.abs(x))) & (F.stddev_pop(y) > TINY * F.max(F.abs(y)))
    return F.when((F.count(x) >= 3) & varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def metrics(obs: Column, pred: Column) -> list[Column]:
    """n, rho, mae, rmse and bias = mean(pred - obs) over complete pairs."""
    o, p = both(obs, pred)
    return [
        F.count(o).alias("n"),
        safe_corr(o, p).alias("rho"),
        F.avg(F.abs(p - o)).alias("mae"),
        F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"),
        F.avg(p - o).alias("bias"),
    ]
