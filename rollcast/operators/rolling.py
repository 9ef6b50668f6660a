"""Rolling scores: the approximate inverse operator A = X'y / y'y over windows.

On data that is z-scored in the window A is the Pearson correlation of a feature with the
forecast, so rolling scores are window aggregates. A window spans two blocks of its length:
its sums are a running sum of the block it ends in and one, from the end, of the block
before, so there are n additions instead of n times the window, nothing is subtracted, and
no value outside of a window touches its score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import finite, z
from .align import long
from .ranges import SIZE, numbered, spread

KEYS = ("series_id", "feature")
TINY = 1e-12  # a variance below this share of the mean square is zero


def ranged(df: DataFrame, window: int, order: str, keys: Sequence[str], index: str | None = None) -> DataFrame:
    """`df` with __i, row numbers from 0, in ranges (__range) of whole windows; a range also has
    the window - 1 rows before it, with `inside` false, so windows by (keys, __range) see every
    window's rows, and one series is many tasks. `index` is a column of row numbers from 1."""
    d = numbered(df, keys, order, "__i") if index is None else df.withColumn("__i", F.col(index).cast("long"))
    return spread(d.withColumn("__i", F.col("__i") - 1), window - 1, 0, -(-SIZE // window) * window, "__i", "__range")


def rolling_corr(df: DataFrame, x: str, y: str, window: int, order: str, keys: Sequence[str] = KEYS, name: str = "g", index: str | None = None) -> DataFrame:
    """`df` with the correlation of x and y over the `window` rows up to each row; null unless
    all are complete and both vary. Both are less their median in a range first, so that sums
    keep their digits. Missing rows' values are finite doubles or null. `index`: a column of
    row numbers from 1, if there is one."""
    keys = [*keys, "__range"]
    whole = Window.partitionBy(*keys)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    # columns of one step go together, so each step is one window operator
    d = ranged(df, window, order, keys[:-1], index).withColumns({"__x": F.when(ok, F.col(x)), "__y": F.when(ok, F.col(y))})
    d = d.withColumns({c: F.col(c) - F.percentile_approx(c, 0.5).over(whole) for c in ("__x", "__y")})
    d = d.withColumn("__b", F.floor(F.col("__i") / window))
    parts = {"n": F.col("__x").isNotNull().cast("double"), "x": F.col("__x"), "y": F.col("__y"), "xx": F.col("__x") * F.col("__x"), "yy": F.col("__y") * F.col("__y"), "xy": F.col("__x") * F.col("__y")}
    d = d.withColumns({f"__p{k}": F.coalesce(v, F.lit(0.0)) for k, v in parts.items()})
    block = Window.partitionBy(*keys, "__b").orderBy("__i")
    d = d.withColumns({f"__s{k}": F.sum(f"__p{k}").over(block.rowsBetween(Window.unboundedPreceding, 0)) for k in parts} | {f"__e{k}": F.sum(f"__p{k}").over(block.rowsBetween(0, Window.unboundedFollowing)) for k in parts})
    d = d.withColumns({f"__l{k}": F.lag(f"__e{k}", window - 1, 0.0).over(whole.orderBy("__i")) for k in parts})
    full = F.col("__i") % window == window - 1  # the window is the block
    d = d.withColumns({f"__w{k}": F.when(full, F.col(f"__s{k}")).otherwise(F.col(f"__s{k}") + F.col(f"__l{k}")) for k in parts})
    n = F.lit(float(window))
    vx, vy = (F.col(f"__w{a}{a}") - F.col(f"__w{a}") * F.col(f"__w{a}") / n for a in "xy")
    cov = F.col("__wxy") - F.col("__wx") * F.col("__wy") / n
    varies = (vx > TINY * F.col("__wxx")) & (vy > TINY * F.col("__wyy"))
    r = F.when((F.col("__wn") > window - 0.5) & varies, F.try_divide(cov, F.sqrt(vx * vy)))
    return d.where("inside").withColumn(name, r).drop("__x", "__y", "__i", "__b", "__range", "inside", *[f"__{a}{k}" for a in "pselw" for k in parts])


def rolling_moments(df: DataFrame, columns: Sequence[str], window: int, order: str, keys: Sequence[str] = KEYS, index: str | None = None) -> DataFrame:
    """`df` with <column>_mean and <column>_sd (population) of the last `window` rows; null
    before that many complete rows, and the deviation null where it is 0."""
    w = Window.partitionBy(*keys, "__range").orderBy("__i").rowsBetween(-(window - 1), 0)
    d = ranged(df, window, order, keys, index).withColumns({f"__{k}{c}": f(c).over(w) for c in columns for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))})
    full = {c: F.col(f"__n{c}") == window for c in columns}
    d = d.withColumns({f"{c}_mean": F.when(full[c], F.col(f"__m{c}")) for c in columns} | {f"{c}_sd": F.when(full[c], F.nullif(F.col(f"__s{c}"), F.lit(0.0))) for c in columns})
    return d.where("inside").drop("__i", "__range", "inside", *[f"__{k}{c}" for c in columns for k in "nms"])


def scores(aligned: DataFrame, features: Sequence[str], window: int, step: int = 1, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, feature, t_src, date_src, g, l) at every `step`-th window end: the global score,
    and the local one, z(y) g z(x) of the window's last row."""
    by = [*keys, "feature"]
    d = numbered(aligned.withColumn("pred", finite(F.col("pred"))), keys, "t_src")  # of every feature alike
    d = long(d, features, [*keys, "t_src", "date_src", "pred", "i"]).withColumn("x", finite(F.col("x")))
    d = rolling_corr(d, "x", "pred", window, "t_src", by, index="i")
    d = rolling_moments(d, ["x", "pred"], window, "t_src", by, "i")
    zy = F.try_divide(F.col("pred") - F.col("pred_mean"), F.col("pred_sd"))
    zx = F.try_divide(F.col("x") - F.col("x_mean"), F.col("x_sd"))
    return endpoints(d.withColumn("l", zy * F.col("g") * zx), window, step).select(*by, "t_src", "date_src", "g", "l")


def endpoints(df: DataFrame, window: int, step: int = 1, index: str = "i") -> DataFrame:
    """Rows (1-based `index`) at which a whole window ends, every `step`-th of them."""
    return df.where((F.col(index) >= window) & ((F.col(index) - window) % step == 0))


def windows(aligned: DataFrame, window: int, step: int = 1, keys: Sequence[str] = ("series_id",), order: str = "t_src") -> DataFrame:
    """One row a window and member: `aligned` with e (the window's last row number), j (0-based
    place in the window). A row is sent to the windows that hold it, so windows are
    independent groups."""
    d = numbered(aligned, keys, order, "__i")
    n = d.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(n, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])
    # ends are window + k * step; those in [i, i + window - 1] and up to n hold row i
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - window) / step)).cast("long")
    last = F.floor((F.least(F.col("__i") + window - 1, F.col("__n")) - window) / step).cast("long")
    d = d.where(last >= first).withColumn("__k", F.explode(F.sequence(first, last)))
    d = d.withColumn("e", window + F.col("__k") * step).withColumn("j", F.col("__i") - F.col("e") + window - 1)
    return d.drop("__i", "__n", "__k")


def inverse_operator(members: DataFrame, features: Sequence[str], *, normalize_y: bool, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, e, feature, g, l) of window members: features are z-scored in the window, the
    forecast if normalize_y; g = sum(x y) / sum(y y), l = y g x of the last row. A constant
    feature scores 0; a forecast of zeros has no score."""
    by = [*keys, "e", "feature"]
    d = standardised(members, features, normalize_y, keys)
    g = F.try_divide(F.sum(F.col("zx") * F.col("zy")), F.sum(F.col("zy") * F.col("zy")))
    last = F.max_by(F.col("zx") * F.col("zy"), "j")
    return d.groupBy(*by).agg(g.alias("g"), (g * last).alias("l"))


def standardised(members: DataFrame, features: Sequence[str], normalize_y: bool, keys: Sequence[str] = ("series_id",), keep: Sequence[str] = ()) -> DataFrame:
    """Long window members (keys, e, feature, j, zx, zy)."""
    w = Window.partitionBy(*keys, "e", "feature")
    d = long(members, features, [*keys, "e", "j", "pred", *keep])
    zx = z(F.col("x"), F.avg("x").over(w), F.stddev_pop("x").over(w))
    zy = z(F.col("pred"), F.avg("pred").over(w), F.stddev_pop("pred").over(w)) if normalize_y else F.col("pred").cast("double")
    return d.select(*keys, "e", "feature", "j", *keep, zx.alias("zx"), zy.alias("zy"))


def equivalence(aligned: DataFrame, features: Sequence[str], window: int, step: int = 1, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, feature, n_windows, mean, sd, max_difference): the rolling correlation against the
    inverse operator on z-scored windows, which are equal."""
    a = inverse_operator(windows(aligned, window, step, keys), features, normalize_y=True, keys=keys)
    b = numbered(scores(aligned, features, window, step, keys), [*keys, "feature"], "t_src")
    b = b.withColumn("e", (F.col("i") - 1) * step + window).select(*keys, "feature", "e", F.col("g").alias("r"))
    d = a.join(b, [*keys, "feature", "e"])
    return d.groupBy(*keys, "feature").agg(F.count("r").alias("n_windows"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.max(F.abs(F.col("g") - F.col("r"))).alias("max_difference"))
