"""Forecasters: nearest neighbours (simplex), locally weighted linear maps, baselines.

A forecast is a long table (keys, model, tp, t_pred, obs, pred). Library and prediction ranges
are inclusive row numbers; a prediction point is never in its own library, and library rows
whose target lies beyond the data are dropped. Distances are Euclidean on the raw states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import THETA_GRID, holdout
from ..functions import kernels
from ..functions.scalar import finite
from ..functions.stats import metrics, safe_corr
from ..functions.tables import settle
from . import tiles
from .ranges import numbered, spread

KEYS = ("series_id",)
NEAR = 400  # prediction points of one task of cross mapping
LIBRARIES = 1000  # random libraries of one task
SIDE_BY_SIDE = 8  # groups of models that are worked on at once


def lag_embed(series: DataFrame, column: str, e: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """`series` with states s0..s(e-1) = x(t), x(t-1), ...; the first e - 1 rows go."""
    w = Window.partitionBy(*keys, "block").orderBy("__i")
    d = spread(numbered(series, keys, "t", "__i"), e - 1, 0, order="__i")
    d = d.withColumns({f"s{j}": F.col(column) if j == 0 else F.lag(column, j).over(w) for j in range(e)})
    return d.where("inside").where(F.col("__i") >= e).drop("__i", "block", "inside")


def persistence(series: DataFrame, target: str, tp: int, keys: Sequence[str] = KEYS, beyond: bool = False) -> DataFrame:
    """Forecast of row t + tp: the value of row t. `beyond` keeps forecasts after the end of the
    series, without an observation."""
    w = Window.partitionBy(*keys).orderBy("t")
    d = series.select(*keys, F.lit("B2_persistence").alias("model"), F.lit(tp).alias("tp"), (F.col("t") + tp).alias("t_pred"), F.lead(target, tp).over(w).alias("obs"), F.col(target).alias("pred"), F.lead("t", tp).over(w).alias("__there"))
    return (d if beyond else d.where("__there is not null")).drop("__there")


def mean_state(series: DataFrame, target: str, tp: int, lib_end: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Forecast of every row: the target's mean over the library rows."""
    mean = F.avg(F.when(F.col("t") <= lib_end, F.col(target))).over(Window.partitionBy(*keys))
    return series.select(*keys, F.lit("B1_mean").alias("model"), F.lit(tp).alias("tp"), F.col("t").alias("t_pred"), F.col(target).alias("obs"), mean.alias("pred"))


def evaluate(preds: DataFrame, by: Sequence[str] = ("series_id", "model", "tp")) -> DataFrame:
    return preds.groupBy(*by).agg(*metrics(F.col("obs"), F.col("pred")))


def skill(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Metrics with 1 - rmse / rmse of each baseline at the same horizon; null if that is 0 or
    undefined."""
    w = Window.partitionBy(*keys, "tp")
    for name, model in (("skill_vs_b1", "B1_mean"), ("skill_vs_b2", "B2_persistence")):
        base = F.max(F.when(F.col("model") == model, F.col("rmse"))).over(w)
        table = table.withColumn(name, 1 - F.try_divide(F.col("rmse"), base))
    return table


def simplex_pairs(states: DataFrame, columns: Sequence[str], target: str, lib: tuple[int, int], pred: tuple[int, int], tp: int, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_pred, obs, pred): the simplex of rows `pred` with the states in `columns`, of
    which the k nearest of the rows `lib` are kept (ties: the earlier row)."""
    d = tiles.states(states, target, tp, columns=columns, keys=keys).withColumn("y", finite(F.col("y")))
    a = d.where(F.col("t").between(*lib) & F.col("y").isNotNull())
    out = tiles.simplex(d.where(F.col("t").between(*pred)), a, [(len(columns), k)], keys)
    return out.select(*keys, (F.col("t") + tp).alias("t_pred"), "obs", "pred")


def smap_line(series: DataFrame, column: str, target: str, lib: tuple[int, int], pred: tuple[int, int], tp: int, theta: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_pred, obs, pred, slope) of the local linear map of one state variable."""
    d = run_models(series, [{"model": "smap", "columns": [column], "theta": theta, "tp": tp}], target, [], lib, pred, keys)
    return d.select(*keys, "t_pred", "obs", "pred", F.col("coefficients")[1].alias("slope"))


RANGES = ("lib_first", "lib_last", "pred_first", "pred_last")


def run_models(series: DataFrame, specs: Sequence[Mapping], target: str, features: Sequence[str], lib: tuple[int, int] | None = None, pred: tuple[int, int] | None = None, keys: Sequence[str] = KEYS, params: DataFrame | None = None) -> DataFrame:
    """(keys, model, tp, e, theta, t_pred, obs, pred, coefficients) of all specs at once.

    A spec: model `simplex` or `smap`; kind `univariate` (e lags of the target) or `multivariate`
    (columns, by default target and features, as they are); e, theta, tp; optional weighting
    (`w` or `sqrt`), columns and name. e and theta may name columns of `params` (a row a
    series, as from `select_parameters`), so that each series has its own; without lib and
    pred the ranges are its RANGES columns. Specs with the same states share them, and all
    maps of one weighting share their distances. No task gets a whole series (`tiles`). A
    spec that cannot be fitted gives forecasts that are null."""
    groups: dict[tuple, list[dict]] = {}
    for s in specs:
        kind = s.get("kind", "multivariate")
        if s["model"] not in ("simplex", "smap") or kind not in ("univariate", "multivariate"):
            raise ValueError(f"no such model: {s['model']} {s.get('kind')}")
        s = dict(s, name=s.get("name") or f"{s['model']}_{kind}", theta=s.get("theta", 0.0), weighting=s.get("weighting", "w"), tp=int(s["tp"]))
        of = s["e"] if kind == "univariate" else tuple(s.get("columns") or [target, *features])
        groups.setdefault((kind, of, s["tp"], s["model"], s["weighting"] if s["model"] == "smap" else ""), []).append(s)
    own = [] if params is None else [c for c in params.columns if c not in keys]
    d = series if params is None else series.join(params.select(*keys, *[F.col(c).alias(f"p_{c}") for c in own]), list(keys))
    if lib is not None:
        d = d.withColumns({f"p_{c}": F.lit(int(x)).cast("long") for c, x in zip(RANGES, (*lib, *pred))})
    kept = [c for c in d.columns if c.startswith("p_")]
    given = lambda v: F.col(f"p_{v}").cast("double") if isinstance(v, str) else F.lit(float(v))

    def made_by(group: tuple) -> DataFrame:
        (kind, of, tp, model, weighting), mine = group
        if kind == "multivariate":
            width, found = len(of), tiles.states(d, target, tp, columns=of, keys=keys, keep=kept)
        else:
            width = params.agg(F.max(of)).first()[0] or 1 if isinstance(of, str) else int(of)
            found = tiles.states(d, target, tp, lags=f"p_{of}" if isinstance(of, str) else width, most=width, keys=keys, keep=kept)
        found = found.withColumn("y", finite(F.col("y"))).withColumn("x", F.transform("x", finite)).where(~F.exists("x", lambda v: v.isNull()))
        found = found.withColumn("thetas", F.array(*[given(s["theta"]) for s in mine]))
        library = found.where(F.col("t").between(F.col("p_lib_first"), F.col("p_lib_last")) & F.col("y").isNotNull()).select(*keys, "t", "x", "y")
        points = found.where(F.col("t").between(F.col("p_pred_first"), F.col("p_pred_last"))).select(*keys, "t", "x", "y", "thetas")
        if model == "smap":
            made = tiles.local_maps(points, library, width, keys, power=2.0 if weighting == "w" else 1.0)
        else:  # one forecast, whatever theta a spec names
            made = tiles.simplex(points.drop("thetas"), library, None, keys).select(*keys, "t", "pred", F.explode(F.sequence(F.lit(0), F.lit(len(mine) - 1))).alias("which"), F.lit(None).cast("array<double>").alias("coefficients"))
        every = points.select(*keys, "t", F.col("y").alias("obs"), F.size("x").alias("e"), F.posexplode("thetas").alias("which", "theta"))
        made = every.join(made.select(*keys, "t", "which", "pred", "coefficients"), [*keys, "t", "which"], "left")
        name = F.element_at(F.array(*[F.lit(s["name"]) for s in mine]), F.col("which") + 1)
        return made.select(*keys, name.alias("model"), F.lit(tp).alias("tp"), "e", "theta", (F.col("t") + tp).alias("t_pred"), "obs", "pred", "coefficients")

    # groups do not depend on each other: what they write on the way runs side by side
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return reduce(DataFrame.unionByName, pool.map(made_by, groups.items()))


def split(n: int, fraction: float = 0.2) -> tuple[tuple[int, int], tuple[int, int]]:
    """Library and prediction ranges of a series of n rows."""
    end = n - holdout(n, fraction)
    return (1, end), (end + 1, n)


def splits(series: DataFrame, fraction: float = 0.2, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, RANGES) of every series, each by its own number of rows."""
    n = F.col("n")
    held = F.least(F.greatest(F.lit(20), F.floor(n * fraction)), F.greatest(F.lit(10), F.floor(n / 3)))
    d = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("end", (n - held).cast("long"))
    return d.select(*keys, F.lit(1).cast("long").alias("lib_first"), F.col("end").alias("lib_last"), (F.col("end") + 1).alias("pred_first"), n.alias("pred_last"))


def embed_dimension(series: DataFrame, target: str, lib=None, pred=None, most: int = 10, tp: int = 1, keys: Sequence[str] = KEYS, params: DataFrame | None = None) -> DataFrame:
    """(keys, e, rho): skill of univariate simplex forecasts for e = 1..most, in one search: the
    distances of e + 1 lags are those of e and one more lag's square."""
    d = tiles.states(series, target, tp, lags=most, keys=keys)
    d = d.withColumn("y", finite(F.col("y"))).withColumn("x", F.transform("x", finite))
    if lib is None:
        d = d.join(params.select(*keys, *RANGES), list(keys))
        lib, pred = ((F.col(a), F.col(b)) for a, b in (RANGES[:2], RANGES[2:]))
    points, library = d.where(F.col("t").between(*pred)), d.where(F.col("t").between(*lib) & F.col("y").isNotNull())
    found = tiles.simplex(points.select(*keys, "t", "x", "y"), library.select(*keys, "t", "x", "y"), [(e, e + 1) for e in range(1, most + 1)], keys)
    return found.groupBy(*keys, "e").agg(safe_corr(F.col("obs"), F.col("pred")).alias("rho"))


def theta_sweep(series: DataFrame, target: str, features: Sequence[str], lib=None, pred=None, *, kind: str = "multivariate", e: int | str = 1, grid: Sequence[float] = THETA_GRID, tp: int = 1, keys: Sequence[str] = KEYS, params: DataFrame | None = None) -> DataFrame:
    """(keys, theta, n, rho, mae, rmse, bias) of local linear maps over the grid."""
    specs = [{"model": "smap", "kind": kind, "e": e, "theta": float(th), "tp": tp} for th in grid]
    return evaluate(run_models(series, specs, target, features, lib, pred, keys, params), [*keys, "theta"])


def best(table: DataFrame, parameter: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, parameter, rho): the row of highest rho; ties: lowest rmse if there is one, then the
    smallest parameter."""
    order = [F.col("rho").desc_nulls_last(), *([F.col("rmse").asc_nulls_last()] if "rmse" in table.columns else []), F.col(parameter)]
    return table.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").select(*keys, parameter, "rho")


def select_parameters(series: DataFrame, target: str, features: Sequence[str], *, most: int = 10, fraction: float = 0.2, tp: int = 1, grid: Sequence[float] = THETA_GRID, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, RANGES, e_uv, theta_uv, e_mv, theta_mv): the best parameters of every series. No
    valid search: e of min(3, most), theta 0. The searches run when this is called, as the
    next ones need their results; a table of a row a series is kept of them."""
    params = splits(series, fraction, keys)

    def chosen(table: DataFrame, parameter: str, name: str, otherwise) -> DataFrame:
        top = best(table, parameter, keys).where("rho is not null").select(*keys, F.col(parameter).alias(name))
        return settle(params.join(top, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(otherwise))))

    params = chosen(embed_dimension(series, target, most=most, tp=tp, keys=keys, params=params), "e", "e_uv", min(3, most))
    params = chosen(theta_sweep(series, target, [], kind="univariate", e="e_uv", grid=grid, tp=tp, keys=keys, params=params), "theta", "theta_uv", 0.0)
    params = params.withColumn("e_mv", F.lit(1 + len(features)))
    return chosen(theta_sweep(series, target, features, grid=grid, tp=tp, keys=keys, params=params), "theta", "theta_mv", 0.0)


def horizons(series: DataFrame, target: str, features: Sequence[str], tps: Sequence[int], *, fraction: float = 0.2, most: int = 10, per_horizon: bool = False, grid: Sequence[float] = THETA_GRID, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics with skills, predictions, parameters by series and horizon) of four models and two
    baselines, for every series with parameters of its own. Parameters are those of the first
    horizon unless per_horizon. Baselines forecast the times that the models forecast and
    that are in the series. A model that fails on a series has metrics with n = 0."""
    found, frames, all_params, expected, every = None, [], None, [], []
    cols = [*keys, "model", "tp", "t_pred", "obs", "pred"]
    for tp in tps:
        if found is None or per_horizon:
            found = select_parameters(series, target, features, most=most, fraction=fraction, tp=tp, grid=grid, keys=keys)
        mine = found.withColumn("tp", F.lit(tp))
        all_params = mine if all_params is None else all_params.unionByName(mine)
        specs = []
        for model in ("simplex", "smap"):
            specs.append({"model": model, "kind": "univariate", "e": "e_uv", "theta": "theta_uv", "tp": tp})
            specs.append({"model": model, "kind": "multivariate", "theta": "theta_mv", "tp": tp})
        expected += [(f"{s['model']}_{s['kind']}", tp) for s in specs] + [("B1_mean", tp), ("B2_persistence", tp)]
        if per_horizon:
            frames.append(run_models(series, specs, target, features, keys=keys, params=found).select(*cols))
        every += specs
        ranged = series.join(found.select(*keys, *RANGES), list(keys))
        mean = F.avg(F.when(F.col("t") <= F.col("lib_last"), F.col(target))).over(Window.partitionBy(*keys))
        inside = F.col("t").between(F.col("pred_first") + tp, F.col("pred_last") + tp)
        b1 = ranged.withColumn("__m", mean).where(inside).select(*keys, F.lit("B1_mean").alias("model"), F.lit(tp).alias("tp"), F.col("t").alias("t_pred"), F.col(target).alias("obs"), F.col("__m").alias("pred"))
        b2 = persistence(series, target, tp, keys).join(found.select(*keys, *RANGES), list(keys))
        b2 = b2.where(F.col("t_pred").between(F.col("pred_first") + tp, F.col("pred_last") + tp)).select(*cols)
        frames += [b1.select(*cols), b2]
    if not per_horizon:  # parameters are the same: one call for all horizons
        frames.append(run_models(series, every, target, features, keys=keys, params=found).select(*cols))
    preds = reduce(DataFrame.unionByName, frames)
    wanted = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(tp).alias("tp")) for m, tp in expected])
    table = series.select(*keys).distinct().withColumn("__w", F.explode(wanted)).select(*keys, "__w.*")
    table = table.join(evaluate(preds, [*keys, "model", "tp"]), [*keys, "model", "tp"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return skill(table, keys), preds.dropna(subset=["obs", "pred"]), all_params


def full_series(series: DataFrame, target: str, features: Sequence[str], theta: float | str, tp: int, include_target: bool = True, keys: Sequence[str] = KEYS, params: DataFrame | None = None) -> DataFrame:
    """In-sample forecasts of every row by a local linear map whose library is the whole series.
    theta may name a column of `params`, as in run_models."""
    n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("pred_last")).withColumns({c: F.lit(1).cast("long") for c in ("lib_first", "pred_first")}).withColumn("lib_last", F.col("pred_last"))
    params = n if params is None else n.join(params.drop(*RANGES), list(keys))
    cols = ([target] if include_target else []) + list(features)
    name = "smap_full_series_" + ("target_plus_covariates" if include_target else "covariates_only")
    return run_models(series, [{"model": "smap", "columns": cols, "theta": theta, "tp": tp, "name": name}], target, features, keys=keys, params=params)


def coefficients(preds: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t_src, feature, coefficient) of a map's forecasts, the intercept left out."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col("coefficients")[i + 1].alias("coefficient")) for i, c in enumerate(columns)]))
    return preds.where("coefficients is not null").select(*keys, (F.col("t_pred") - F.col("tp")).alias("t_src"), rows.alias("r")).select(*keys, "t_src", "r.*")


def coefficient_agreement(scores: DataFrame, coefs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, feature, n, corr): the rolling score against the map's coefficient."""
    d = scores.join(coefs, [*keys, "t_src", "feature"])
    return d.groupBy(*keys, "feature").agg(F.count(F.when(F.col("g").isNotNull() & F.col("coefficient").isNotNull(), 1)).alias("n"), safe_corr(F.col("g"), F.col("coefficient")).alias("corr"))


def cross_map(series: DataFrame, a: str, b: str, e: int, sizes: Sequence[int], samples: int = 100, seed: int = 42, tp: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, lib_size, rho_ab, rho_ba): mean skill of b forecast from the lags of a and the other
    way round, over random libraries of each size. A sample has a generator of its own, so
    results do not depend on partitioning. A task has NEAR prediction points, whose
    neighbours are sorted once, and the LIBRARIES of a few sizes; it gives sums, of which
    each sample's correlation over all points is made."""
    spark = series.sparkSession
    libraries = [(int(n), r) for n in sizes for r in range(samples)]
    groups = spark.createDataFrame([(g,) for g in range(-(-len(libraries) // LIBRARIES))], "part int")
    d = series.select(*keys, "t", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    rows = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    blocks = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / NEAR).cast("int"))).alias("block"))
    d = d.join(blocks, list(keys)).join(F.broadcast(groups))
    types = dict(series.dtypes)

    def one(key, pdf):
        pdf = pdf.sort_values("t")
        out = []
        mine = libraries[key[-1] * LIBRARIES : (key[-1] + 1) * LIBRARIES]
        for way, (x, y) in enumerate((("a", "b"), ("b", "a"))):
            s, target = kernels.embed(pdf[x].to_numpy(float), e), pdf[y].to_numpy(float)
            ahead = np.roll(target, -tp)
            if tp:
                ahead[len(ahead) - tp :] = np.nan
            ok = np.flatnonzero(np.isfinite(s).all(1) & np.isfinite(ahead))
            s, ahead = s[ok], ahead[ok]
            ahead = ahead - ahead.mean() if len(ok) else ahead  # sums keep their digits
            at = np.arange(len(ok))[(ok >= key[-2] * NEAR) & (ok < (key[-2] + 1) * NEAR)]
            near = kernels.Neighbours(s, at)
            for size, r in mine:
                rng = np.random.default_rng([seed, size, r])
                member = np.zeros(len(ok), bool)
                member[rng.choice(len(ok), min(size, len(ok)), replace=False)] = True
                p = near.simplex(member, ahead, e + 1)
                fine = np.isfinite(p)
                p, q = p[fine], ahead[at][fine]
                out.append((*key[:-2], size, r, way, len(p), p.sum(), q.sum(), p @ p, q @ q, p @ q))
        return pd.DataFrame(out, columns=[*keys, "lib_size", "sample", "way", "n", "p", "q", "pp", "qq", "pq"])

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "lib_size int, sample int, way int, n long, p double, q double, pp double, qq double, pq double"])
    m = d.groupBy(*keys, "block", "part").applyInPandas(one, schema)
    m = m.groupBy(*keys, "lib_size", "sample", "way").agg(*[F.sum(c).alias(c) for c in ("n", "p", "q", "pp", "qq", "pq")])
    vp, vq = (F.col(c + c) - F.col(c) * F.col(c) / F.col("n") for c in "pq")
    varies = (F.col("n") > 2) & (vp > 1e-12 * F.col("pp")) & (vq > 1e-12 * F.col("qq"))
    m = m.withColumn("rho", F.when(varies, (F.col("pq") - F.col("p") * F.col("q") / F.col("n")) / F.sqrt(vp * vq)))
    return m.groupBy(*keys, "lib_size").agg(*[F.avg(F.when(F.col("way") == w, F.col("rho"))).alias(c) for w, c in enumerate(("rho_ab", "rho_ba"))])
