"""Column expressions: calendar labels, missing values, casts, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEASONS = ("DJF", "MAM", "JJA", "SON")


def season(d: Column) -> Column:
    """DJF, MAM, JJA, else SON: a null date is in SON."""
    m = F.month(d)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def season_order(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEASONS]), label).cast("int")


def block_label(d: Column, mode: str) -> Column:
    """yyyy-MM, yyyyQn, or yyyy-SSS (a winter splits on 1 January)."""
    if mode == "month":
        return F.date_format(d, "yyyy-MM")
    if mode == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    if mode == "season":
        return F.concat(F.year(d).cast("string"), F.lit("-"), season(d))
    raise ValueError(mode)


def finite(x: Column) -> Column:
    """The value as a double; null if it is NaN or infinite."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def table_round(x: Column, digits: int = 4) -> Column:
    """Half-even rounding of finite values, as tables show them."""
    return F.bround(finite(x), digits)


def clean_label(s: Column) -> Column:
    """All but letters, digits, `_`, `-` and `.` become `_`."""
    return F.regexp_replace(s, r"[^\p{L}\p{N}_.\-]", "_")


def timestamp_of(year: Column, month: Column, day: Column, hour: Column) -> Column:
    return F.make_timestamp_ntz(year, month, day, hour, F.lit(0), F.lit(0).cast("decimal(8,6)"))


def date_of(t: Column, first: Column) -> Column:
    """The date of ordinal day t, where day 1 is `first`."""
    return F.date_add(first, (t - 1).cast("int"))


def z(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd; a deviation of 0 counts as 1, so a constant is 0."""
    return (x - mean) / F.when(sd > 0, sd).otherwise(F.lit(1.0))


def find_column(df: DataFrame, name: str) -> str | None:
    """The column whose name is `name` in any case; None if there is none."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def predictions(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A forecaster's output as (t_pred, obs, pred): columns are found by name in any case
    (time, *observ*, *predict*), bad numbers become null, rows without a time go."""
    out = {}
    for c in df.columns:
        low = c.lower()
        name = "t_pred" if low in ("time", "t_pred") else "obs" if "observ" in low or low == "obs" else "pred" if "predict" in low or low == "pred" else None
        if name and name not in out:
            out[name] = F.expr(f"try_cast(`{c}` as double)")
    if "t_pred" not in out or "pred" not in out:
        raise ValueError("no prediction columns")
    cols = [F.round(out["t_pred"]).cast("long").alias("t_pred")] + [finite(out[n]).alias(n) for n in ("obs", "pred") if n in out]
    return df.select(*keep, *cols).dropna(subset=["t_pred"])
