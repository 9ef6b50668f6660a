"""Null distributions of the scores, envelopes, add-one p-values.

Randomness is data: numpy draws small tables on the driver (shifts, run orders), which are
broadcast, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import AttributionConfig
from ..functions.scalar import block_label, finite
from ..functions.tables import settle
from .align import long
from .ranges import numbered, spread
from .rolling import TINY, endpoints, rolling_corr, standardised

ENDS = 1 << 14  # window ends of one task of `series_envelope`
CELLS = 1 << 21  # scores that it holds at once
DIGITS = 9  # scores are compared with their null after rounding to so many digits


def periodic_shifts(n: int, replicates: int, period: int, seed: int = 0) -> list[int]:
    """Shifts of a series of n rows, drawn with replacement from the multiples of the period
    below n, or from 1 to n - 1 if there is none; empty for n < 2."""
    period = max(1, int(period))
    choices = np.arange(period, n, period) if period < n else np.arange(1, n)
    return np.random.default_rng(seed).choice(choices, replicates).tolist() if len(choices) else []


def window_shifts(n: int, replicates: int, seed: int, weekly: bool) -> list[int]:
    """Shifts in a window of n rows: 1 to n - 1, or multiples of 7 up to n. A generator draws
    them one by one, the same list for every window of n rows."""
    rng = np.random.default_rng(seed)
    if weekly:
        return [7 * int(rng.integers(1, max(1, n // 7) + 1)) for _ in range(replicates)]
    return [int(rng.integers(1, n)) for _ in range(replicates)] if n > 1 else []


def run_orders(most: int, replicates: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(k, perm, pos, run): for every number of runs k up to `most`, orders of the k runs."""
    out = []
    for k in range(1, most + 1):
        rng = np.random.default_rng(seed)
        for r in range(replicates):
            out += [(k, r, pos, int(run)) for pos, run in enumerate(rng.permutation(k))]
    return out


def shift_table(spark: SparkSession, shifts: Sequence[int]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(map(int, shifts))), "perm int, shift long"))


def series_null(spark: SparkSession, aligned: DataFrame, features: Sequence[str], window: int, shifts: Sequence[int], step: int = 1, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, feature, perm, t_src, gr): the rolling scores of the forecast rolled over the whole
    series. Scored by (series, feature, perm), so replicates run in parallel; rows that
    are no window ends go before anything is gathered."""
    a = settle(numbered(aligned, keys, "t_src").withColumn("i", F.col("i") - 1))  # read for x, y and n
    n = a.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    a = a.join(n, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])
    y = a.select(*keys, F.col("i").alias("from"), "n", finite(F.col("pred")).alias("pred"))
    y = y.join(shift_table(spark, shifts)).select(*keys, "perm", F.pmod(F.col("from") + F.col("shift"), F.col("n")).alias("i"), "pred")
    x = long(a, features, [*keys, "i", "t_src"]).withColumn("x", finite(F.col("x")))
    d = x.join(y, [*keys, "i"]).withColumn("i", F.col("i") + 1)
    d = rolling_corr(d, "x", "pred", window, "i", [*keys, "feature", "perm"], "gr", "i")
    return endpoints(d, window, step).select(*keys, "feature", "perm", "t_src", "gr")


def shifted_scores(x: np.ndarray, y: np.ndarray, start: int, shifts: np.ndarray, window: int) -> np.ndarray:
    """(shifts, ends): the correlation over each `window` values of x with y rolled by each shift
    along its whole ring. x[0] is at row `start` of the series, and missing values are NaN.
    Sums are differences of running sums over the values of one block, which are less their
    mean and in units of their deviation."""
    n, rows = len(y), start + np.arange(len(x))

    def unit(v):
        ok = np.isfinite(v)
        mean, sd = (v[ok].mean(), v[ok].std()) if ok.any() else (0.0, 1.0)
        return np.where(ok, (v - mean) / (sd if sd > 0 else 1.0), 0.0), ok

    def sums(v):
        total = np.concatenate([np.zeros((*v.shape[:-1], 1)), np.cumsum(v, axis=-1)], axis=-1)
        return total[..., window:] - total[..., :-window]

    if len(x) < window:
        return np.zeros((len(shifts), 0))
    (xs, x_ok), (ys, y_ok) = unit(x), unit(y)
    rolled, there = ys[(rows[None] - shifts[:, None]) % n], y_ok[(rows[None] - shifts[:, None]) % n] & x_ok[None]
    a, b = np.where(there, xs[None], 0), np.where(there, rolled, 0)
    sx, sy, sxx, syy, sxy = sums(a), sums(b), sums(a * a), sums(b * b), sums(a * b)
    vx, vy = sxx - sx * sx / window, syy - sy * sy / window
    varies = (vx > TINY * np.maximum(sxx, window * TINY)) & (vy > TINY * np.maximum(syy, window * TINY)) & (sums(there.astype(float)) > window - 0.5)
    with np.errstate(all="ignore"):
        return np.where(varies, (sxy - sx * sy / window) / np.sqrt(vx * vy), np.nan)


def series_envelope(spark: SparkSession, aligned: DataFrame, observed: DataFrame, features: Sequence[str], window: int, shifts: Sequence[int], digits: int | None = DIGITS, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """What `compare` of `series_null` gives: `observed` (keys, feature, t_src, g) with lo, hi and
    p, for any number of replicates. A task has ENDS rows of a feature, with the window - 1
    rows before them and their observed scores, and the ring of the forecast (8 bytes a row of
    the series); it works out all replicates at once and returns a row a window end, so
    neither the shuffle nor any table grows with the replicates."""
    by = [*keys, "feature"]
    a = settle(numbered(aligned.withColumn("pred", finite(F.col("pred"))), keys, "t_src"))
    types = dict(observed.dtypes)
    draw = np.array(list(shifts), np.int64)

    def pack_ring(key, pdf):
        y = pdf.sort_values("i")["pred"].to_numpy(float)
        return pd.DataFrame([(*key, y.tobytes())], columns=[*keys, "ring"])

    ring = settle(a.select(*keys, "i", "pred").groupBy(*keys).applyInPandas(pack_ring, ", ".join(f"{k} {types[k]}" for k in keys) + ", ring binary"))
    x = long(a, features, [*keys, "i", "t_src"]).withColumn("x", finite(F.col("x")))
    x = x.join(observed.select(*by, "t_src", "g"), [*by, "t_src"], "left")
    x = spread(x.withColumn("i", F.col("i") - 1), window - 1, 0, ENDS, "i").drop("t_src", "inside")

    def pack(key, pdf):
        pdf = pdf.sort_values("i")
        return pd.DataFrame([(*key, int(pdf["i"].iloc[0]), pdf["x"].to_numpy(float).tobytes(), pdf["g"].to_numpy(float).tobytes())], columns=[*by, "block", "start", "x", "g"])

    kt = ", ".join(f"{k} {types[k]}" for k in by)
    blocks = x.groupBy(*by, "block").applyInPandas(pack, f"{kt}, block long, start long, x binary, g binary")

    def run(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                x, g, y = (np.frombuffer(r[c], float) for c in ("x", "g", "ring"))
                start, g = r["start"], g[window - 1 :]
                step = max(1, CELLS // max(1, len(draw)))
                for at in range(0, len(g), step):  # so many ends with all replicates
                    own = g[at : at + step]
                    gr = np.concatenate([shifted_scores(x[at : at + len(own) + window - 1], y, start + at, draw[i : i + 256], window) for i in range(0, len(draw), 256)]) if len(draw) else np.zeros((0, len(own)))
                    some = np.isfinite(gr).any(0)
                    q = np.full((2, len(own)), np.nan)
                    if some.any():
                        q[:, some] = np.nanquantile(gr[:, some], (0.025, 0.975), axis=0)
                    seen, mine = (gr, own) if digits is None else (np.round(gr, digits), np.round(own, digits))
                    c = (np.abs(seen) >= np.abs(mine)[None]).sum(0)
                    yield pd.DataFrame({**{k: r[k] for k in by}, "i": start + at + window + np.arange(len(own)), "lo": q[0], "hi": q[1], "c": c})

    found = blocks.join(ring, list(keys)).mapInPandas(run, f"{kt}, i long, lo double, hi double, c long")
    found = found.join(a.select(*keys, "i", "t_src"), [*keys, "i"]).drop("i")
    out = observed.join(found, [*by, "t_src"], "left")
    p = F.when(F.col("g").isNotNull(), (F.coalesce("c", F.lit(0)) + 1) / F.lit(len(draw) + 1.0))
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("lo", "hi")}).withColumn("p", p).drop("c")


def at_least(gr: Column, g: Column, digits: int | None = DIGITS) -> Column:
    """|gr| >= |g| up to rounding; digits=None compares exactly. Null if either is."""
    if digits is None:
        return F.abs(gr) >= F.abs(g)
    return F.abs(F.round(gr, digits)) >= F.abs(F.round(g, digits))


def compare(observed: DataFrame, null: DataFrame, on: Sequence[str], replicates: int, digits: int | None = DIGITS) -> DataFrame:
    """`observed` with lo, hi (the null's 2.5 and 97.5 percent quantiles) and p, the two-sided
    add-one p-value (count + 1) / (replicates + 1); null where there is no score."""
    d = null.join(observed.select(*on, "g"), list(on))
    q = d.groupBy(*on).agg(F.percentile("gr", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.coalesce(at_least(F.col("gr"), F.col("g"), digits), F.lit(False))).alias("c"))
    out = observed.join(q, list(on), "left")
    p = F.when(F.col("g").isNotNull(), (F.coalesce("c", F.lit(0)) + 1) / F.lit(replicates + 1.0))
    return out.withColumn("lo", F.col("q")[0]).withColumn("hi", F.col("q")[1]).withColumn("p", p).drop("q", "c")


def window_null(spark: SparkSession, members: DataFrame, features: Sequence[str], cfg: AttributionConfig, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, e, feature, perm, gr): scores of the z-scored forecast permuted within each window
    of `rolling.windows`: circular shifts, weekly ones, or shuffled calendar blocks."""
    by = [*keys, "e", "feature"]
    mode = cfg.block_mode()
    w = Window.partitionBy(*by)
    d = standardised(members, features, True, keys, [cfg.date_column] if mode else []).withColumn("n", F.count(F.lit(1)).over(w))
    if mode:
        return _block_null(spark, d, mode, cfg, by)
    sizes = [r["n"] for r in d.select("n").distinct().collect()]  # at most the window's length
    rows = [(int(n), r, int(s)) for n in sizes for r, s in enumerate(window_shifts(int(n), cfg.replicates, cfg.seed, cfg.preserve_weekly))]
    table = F.broadcast(spark.createDataFrame(rows, "n long, perm int, shift long"))
    y = d.select(*by, F.col("j").alias("from"), "n", "zy").join(table, "n").select(*by, "perm", F.pmod(F.col("from") + F.col("shift"), F.col("n")).alias("j"), "zy")
    return _score(d.select(*by, "j", "zx"), y, by, cfg)


def _score(x: DataFrame, y: DataFrame, by: list[str], cfg: AttributionConfig) -> DataFrame:
    d = x.join(y, [*by, "j"])
    return d.groupBy(*by, "perm").agg(F.try_divide(F.sum(F.col("zx") * F.col("zy")), F.sum(F.col("zy") * F.col("zy")) + cfg.ridge).alias("gr"))


def _block_null(spark: SparkSession, d: DataFrame, mode: str, cfg: AttributionConfig, by: list[str]) -> DataFrame:
    """Runs of one label keep their inner order and change places; labels are those of the
    aligned rows. A window may hold one label in several runs."""
    w = Window.partitionBy(*by).orderBy("j")
    d = d.withColumn("__label", block_label(F.col(cfg.date_column), mode))
    d = d.withColumn("run", F.sum(F.coalesce((F.col("__label") != F.lag("__label").over(w)).cast("int"), F.lit(0))).over(w).cast("int"))
    runs = d.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("len"), F.min("j").alias("first"))
    runs = runs.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*by)).cast("int"))
    most = runs.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]  # at most the window's length
    orders = F.broadcast(spark.createDataFrame(run_orders(most, cfg.replicates, cfg.seed) or [(0, 0, 0, 0)], "k int, perm int, pos int, run int"))
    before = Window.partitionBy(*by, "perm").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    moved = runs.join(orders, ["k", "run"]).withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)))
    y = d.select(*by, "run", F.col("j").alias("from"), "zy").join(moved.select(*by, "run", "perm", "first", "start"), [*by, "run"])
    y = y.select(*by, "perm", (F.col("start") + F.col("from") - F.col("first")).alias("j"), "zy")
    return _score(d.select(*by, "j", "zx"), y, by, cfg)
