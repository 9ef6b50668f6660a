"""States of series in tiles: exact neighbour search with pruned tiles, local moments.

A state is a row (keys, t, x, y): x is an array of coordinates, y the value that is to be
forecast. States are packed into tiles of some thousand, one row a tile, so a cell of two
tiles is worked out in numpy, and no task ever gets a whole series. t is a gapless row
number in its series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import settle
from .ranges import spread

KEYS = ("series_id",)
TILE = 2048  # states of a tile, about
#: Tiles that are all compared grow with their series, up to MOST rows, so that up to SPLIT of
#: them each is shipped a fixed number of times.
MOST, SPLIT = 1 << 14, 64
SAMPLE = 1 << 13  # states of a series that its tree is built from, about
PAIRS = 1 << 20  # distances that are held at once


def states(series: DataFrame, target: str, tp: int, *, columns: Sequence[str] = (), lags: int | str = 0, most: int = 0, keys: Sequence[str] = KEYS, keep: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """(keys, t, x, y, keep): x holds `columns`, or the `lags` last values of the target, a number
    or a column of `series` with at most `most`; y is the target tp rows ahead, null beyond
    the series. Lags before the series are null."""
    n = most if isinstance(lags, str) else lags
    if not n and not tp:
        return series.select(*keys, "t", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(target).cast("double").alias("y"), *keep)
    w = Window.partitionBy(*keys, "block").orderBy("t")
    d = spread(series, max(n - 1, -tp, 0), max(tp, 0), size)
    v = F.col(target).cast("double")
    ahead = F.lead(v, tp).over(w) if tp >= 0 else F.lag(v, -tp).over(w)
    x = [F.lag(v, j).over(w) if j else v for j in range(n)] if n else [F.col(c).cast("double") for c in columns]
    d = d.withColumns({f"__x{i}": c for i, c in enumerate(x)} | {"y": ahead}).where("inside")
    x = F.array(*[F.col(f"__x{i}") for i in range(len(x))])
    return d.select(*keys, "t", (F.slice(x, 1, F.col(lags)) if isinstance(lags, str) else x).alias("x"), "y", *keep)


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def _matrix(values, width: int | None = None) -> np.ndarray:
    rows = [np.array([np.nan if v is None else v for v in x], float) for x in values]
    return np.stack(rows) if rows else np.zeros((0, width or 0))


def trees(library: DataFrame, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """(keys, depth, dims, cuts): a complete k-d tree a series, for leaves of about `tile` states,
    from a sample of about SAMPLE of them; node i splits coordinate dims[i] at cuts[i], and
    has the children 2i + 1 and 2i + 2."""
    n = library.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    some = library.join(n, list(keys)).where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) * F.col("__n") < F.lit(SAMPLE << 20))

    def build(key, pdf):
        x, total = _matrix(pdf["x"]), int(pdf["__n"].iloc[0])
        depth = max(0, int(np.ceil(np.log2(max(1.0, total / tile)))))
        x = np.where(np.isfinite(x), x, np.nan)
        dims, cuts = np.zeros((1 << depth) - 1, int), np.zeros((1 << depth) - 1)
        parts = {0: x}
        for i in range(len(dims)):
            part = parts.pop(i)
            with np.errstate(all="ignore"):
                wide = np.nan_to_num(np.nanmax(part, 0) - np.nanmin(part, 0)) if len(part) else np.zeros(x.shape[1])
            dims[i] = int(wide.argmax()) if len(wide) else 0
            own = part[:, dims[i]]
            cuts[i] = np.nanmedian(own) if len(own) and np.isfinite(own).any() else 0.0
            right = ~(own <= cuts[i])
            parts[2 * i + 1], parts[2 * i + 2] = part[~right], part[right]
        return pd.DataFrame([(*key, depth, dims.tolist(), cuts.tolist())], columns=[*keys, "depth", "dims", "cuts"])

    return some.groupBy(*keys).applyInPandas(build, f"{_types(library, keys)}, depth int, dims array<int>, cuts array<double>")


def pack(rows: DataFrame, keys: Sequence[str] = KEYS, tree: DataFrame | None = None, tile: int = TILE, more: Sequence[str] = ()) -> DataFrame:
    """(keys, tile, n, width, lo, hi, valid, t, x, y, more) of rows (keys, t, x, y, more): tiles of
    about `tile` rows by the leaves of `tree`, or dealt evenly, larger ones for long series. lo and hi bound the
    coordinates, valid[i] counts rows whose first i + 1 are finite. A leaf with more than two
    tiles' rows, such as one of equal states, is dealt to several. `more` is the same in all
    rows of a series."""
    if tree is None:
        d = rows.withColumn("leaf", F.lit(0).cast("long"))
    else:
        right = lambda i: F.coalesce(~(F.get("x", F.get("dims", i)) <= F.get("cuts", i)), F.lit(True)).cast("int")
        leaf = F.aggregate(F.sequence(F.lit(1), F.greatest("depth", F.lit(1))), F.lit(0), lambda i, k: F.when(k <= F.col("depth"), 2 * i + 1 + right(i)).otherwise(i))
        d = rows.join(tree, list(keys)).withColumn("leaf", leaf.cast("long")).drop("depth", "dims", "cuts")
    n = F.count(F.lit(1))
    size = F.least(F.lit(MOST), F.greatest(F.lit(tile), n / SPLIT)) if tree is None else F.lit(2 * tile)
    parts = d.groupBy(*keys, "leaf").agg(F.ceil(n / size).alias("parts"))
    d = d.join(parts, [*keys, "leaf"]).withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")))

    def one(key, pdf):
        pdf = pdf.sort_values("t")
        x = _matrix(pdf["x"])
        valid = np.logical_and.accumulate(np.isfinite(x), axis=1)
        inf = np.where(valid, x, np.inf), np.where(valid, x, -np.inf)
        return pd.DataFrame(
            [(*key[:-2], int(key[-2] << 24 | key[-1]), len(x), x.shape[1], inf[0].min(0), inf[1].max(0), valid.sum(0), pdf["t"].to_numpy(np.int64).tobytes(), x.tobytes(), pdf["y"].to_numpy(float).tobytes(), *[pdf[c].iloc[0] for c in more])],
            columns=[*keys, "tile", "n", "width", "lo", "hi", "valid", "t", "x", "y", *more],
        )

    types = dict(rows.dtypes)
    schema = f"{_types(rows, keys)}, tile long, n int, width int, lo array<double>, hi array<double>, valid array<long>, t binary, x binary, y binary" + "".join(f", {c} {types[c]}" for c in more)
    return d.groupBy(*keys, "leaf", "part").applyInPandas(one, schema)


def unpack(n: int, width: int, t: bytes, x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(t, np.int64), np.frombuffer(x, float).reshape(n, width), np.frombuffer(y, float)


def gaps(plo: np.ndarray, phi: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between a box and many, in the first 1, 2, ... coordinates: at least, and
    at most."""
    with np.errstate(invalid="ignore"):
        near = np.maximum(0, np.maximum(lo - phi, plo - hi))
        far = np.maximum(np.abs(hi - plo), np.abs(phi - lo))
        return np.cumsum(near * near, axis=1), np.cumsum(far * far, axis=1)


SLACK = 1 + 1e-9  # bounds are widened by the rounding of a sum


def wanted(plo, phi, lo, hi, valid, ks: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(tiles, least): the library tiles that can hold one of the k nearest states of any point
    in a box, for each (coordinates, k) of ks, and their least squared distances (tiles, ks).
    So many boxes that hold k + 1 states (a point may be one of them) lie within a bound."""
    near, far = gaps(plo, phi, lo, hi)
    need, least = np.zeros(len(lo), bool), np.full((len(lo), len(ks)), np.inf)
    for i, (e, k) in enumerate(ks):
        m, f, n = near[:, e - 1], np.where(valid[:, e - 1] > 0, far[:, e - 1], np.inf), valid[:, e - 1]
        order = np.argsort(f, kind="stable")
        full = np.flatnonzero(np.cumsum(n[order]) > k)
        bound = f[order[full[0]]] if len(full) else np.inf
        need |= (m <= bound * SLACK) & (n > 0)
        least[:, i] = m
    return np.flatnonzero(need), least


def nearest_in(pt, px, lt, lx, ks: Sequence[tuple[int, int]], bound: np.ndarray | None = None):
    """Arrays (i, point, state, d): for each (e, k) = ks[i] the k nearest of the states in the first
    e coordinates, ties to the earlier one (states ascend by t), none further than bound
    (points, ks); a point is never its own neighbour. Distances of more coordinates add to
    those of fewer."""
    out = []
    step = max(1, PAIRS // max(1, len(lx)))
    for start in range(0, len(px), step):
        p, own = px[start : start + step], pt[start : start + step, None] == lt[None]
        d2, at = np.zeros(own.shape), 0
        for e, k, i in sorted((e, k, i) for i, (e, k) in enumerate(ks)):
            for j in range(at, e):
                d2 += (p[:, j, None] - lx[None, :, j]) ** 2
            at = max(at, e)
            d = np.sqrt(d2)
            d[own | ~np.isfinite(d)] = np.inf
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
            if bound is not None:
                kth = np.minimum(kth, bound[start : start + step, i])
            row, col = np.nonzero((d <= kth[:, None]) & (d < np.inf))
            dist = d[row, col]
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
            fine = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((np.full(fine.sum(), i), row[fine] + start, col[fine], dist[fine]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, int) for _ in range(4))


def nearest(points: DataFrame, library: DataFrame, ks: Sequence[tuple[int, int]] | None = None, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """(keys, t, obs, e, t_lib, y_lib, d): for every point (keys, t, x, y) and each (e, k) of `ks`
    its k nearest states of the library (keys, t, x, y) in the first e coordinates, by
    Euclidean distance, ties to the earlier one. A point is not its own neighbour, and
    states that are not finite in those coordinates are nobody's. Without ks, e is the
    length of the series' states and k is e + 1.

    Exact: each series has a k-d tree from a sample. Points and states are packed into its
    leaves; a tile of points first meets its closest tile of states, whose k-th distances
    bound the search, and then those alone whose box is within its bound. Tiles that are
    pruned are never shipped."""
    tree = settle(trees(library, keys, tile))
    pts, lib = settle(pack(points, keys, tree, tile)), settle(pack(library, keys, tree, tile))
    kt, wide = _types(points, keys), [*keys, "tile"]
    boxes = F.struct("tile", "lo", "hi", "valid")
    ask = pts.select(*keys, boxes.alias("b"), F.pmod(F.xxhash64("tile"), F.lit(64)).alias("__s"))
    have = lib.select(*keys, boxes.alias("b")).groupBy(*keys).agg(F.collect_list("b").alias("all"))  # a box a tile, no states

    def each(width: int) -> list[tuple[int, int]]:
        return list(ks) if ks is not None else [(width, width + 1)]

    def plan(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                b, tiles = row["b"], sorted(row["all"], key=lambda r: r["tile"])
                plo, phi = (np.asarray(b[c], float) for c in ("lo", "hi"))
                lo, hi, valid = (np.stack([np.asarray(r[c], float) for r in tiles]) for c in ("lo", "hi", "valid"))
                need, least = wanted(plo, phi, lo, hi, valid, each(len(plo)))
                if len(need):
                    with np.errstate(invalid="ignore"):
                        mid = np.nan_to_num(((lo + hi - plo - phi)[need] ** 2).sum(1), nan=np.inf)
                    first = need[np.lexsort((mid, least[need].sum(1)))[0]]
                    out += [(*[row[k] for k in keys], b["tile"], tiles[i]["tile"], i == first, least[i].tolist()) for i in need]
            yield pd.DataFrame(out, columns=[*wide, "lib", "first", "least"])

    pairs = settle(ask.join(have, list(keys)).drop("__s").mapInPandas(plan, f"{kt}, tile long, lib long, first boolean, least array<double>"))
    mine = pts.select(*wide, F.col("n").alias("pn"), F.col("width").alias("pw"), F.col("t").alias("pt"), F.col("x").alias("px"), F.col("y").alias("py"))
    theirs = lib.select(*keys, F.col("tile").alias("lib"), "n", "width", "t", "x", "y", "lo", "hi")

    def begin(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                (pt, px, py), (lt, lx, ly) = unpack(r["pn"], r["pw"], r["pt"], r["px"], r["py"]), unpack(r["n"], r["width"], r["t"], r["x"], r["y"])
                k = each(r["pw"])
                i, p, c, d = nearest_in(pt, px, lt, lx, k)
                bound = np.full((len(pt), len(k)), np.inf)
                for j, (e, m) in enumerate(k):
                    own = i == j
                    count = np.bincount(p[own], minlength=len(pt))
                    worst = np.zeros(len(pt))
                    np.maximum.at(worst, p[own], d[own])
                    bound[:, j] = np.where(count >= m, worst, np.inf)
                    bound[~np.isfinite(px[:, :e]).all(1), j] = -np.inf  # not a point at all
                yield pd.DataFrame([(*[r[c_] for c_ in keys], r["tile"], bound.max(0).tolist(), bound.tobytes(), pt[p], py[p], np.array([k[j][0] for j in i], np.int64), lt[c], ly[c], d)], columns=[*wide, "most", "bound", *FOUND])

    arrays = "f_t array<long>, f_obs array<double>, f_e array<long>, f_lib array<long>, f_y array<double>, f_d array<double>"
    start = pairs.where("first").join(mine, wide).join(theirs, [*keys, "lib"]).mapInPandas(begin, f"{kt}, tile long, most array<double>, bound binary, {arrays}")
    start = settle(start)
    within = F.exists(F.arrays_zip("least", "most"), lambda z: z["least"] <= z["most"] * z["most"] * SLACK)
    rest = pairs.where("not first").join(start.select(*wide, "most", "bound"), wide).where(within).drop("least", "most", "first")

    def go_on(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                (pt, px, py), (lt, lx, ly) = unpack(r["pn"], r["pw"], r["pt"], r["px"], r["py"]), unpack(r["n"], r["width"], r["t"], r["x"], r["y"])
                k = each(r["pw"])
                bound = np.frombuffer(r["bound"], float).reshape(len(pt), len(k))
                lo, hi = np.asarray(r["lo"], float), np.asarray(r["hi"], float)
                with np.errstate(invalid="ignore"):
                    near = np.cumsum(np.maximum(0, np.maximum(lo - px, px - hi)) ** 2, axis=1)
                some = np.flatnonzero(np.any([near[:, e - 1] <= bound[:, j] * np.abs(bound[:, j]) * SLACK for j, (e, _) in enumerate(k)], axis=0))
                i, p, c, d = nearest_in(pt[some], px[some], lt, lx, k, bound[some])
                p = some[p]
                yield pd.DataFrame([(*[r[c_] for c_ in keys], pt[p], py[p], np.array([k[j][0] for j in i], np.int64), lt[c], ly[c], d)], columns=[*keys, *FOUND])

    more = rest.join(mine, wide).join(theirs, [*keys, "lib"]).mapInPandas(go_on, f"{kt}, {arrays}")
    both = start.select(*keys, *FOUND).unionByName(more).select(*keys, F.explode(F.arrays_zip(*FOUND)).alias("f"))
    both = both.select(*keys, F.col("f.f_t").alias("t"), F.nanvl("f.f_obs", F.lit(None)).alias("obs"), F.col("f.f_e").cast("int").alias("e"), F.col("f.f_lib").alias("t_lib"), F.col("f.f_y").alias("y_lib"), F.col("f.f_d").alias("d"))
    most = F.col("e") + 1
    if ks is not None:
        most = F.element_at(F.create_map(*[F.lit(v) for e_k in ks for v in e_k]), F.col("e"))
    rank = F.row_number().over(Window.partitionBy(*keys, "t", "e").orderBy("d", "t_lib"))
    return both.withColumn("r", rank).where(F.col("r") <= most).drop("r")


FOUND = ("f_t", "f_obs", "f_e", "f_lib", "f_y", "f_d")


def simplex(points: DataFrame, library: DataFrame, ks: Sequence[tuple[int, int]] | None = None, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """(keys, t, e, obs, pred): the weighted mean of the nearest states' values; weights are
    exp(-d / d_min), 1e-6 at least; if d_min is 0, 1 at distance 0 and 1e-6 beyond."""
    d = nearest(points, library, ks, keys, tile)
    d = d.groupBy(*keys, "t", "e").agg(F.first("obs").alias("obs"), F.min("d").alias("d0"), F.collect_list(F.struct("d", "t_lib", "y_lib")).alias("n"))  # k of them
    weight = lambda x: F.when(F.col("d0") > 0, F.greatest(F.exp(-x.d / F.nullif(F.col("d0"), F.lit(0.0))), F.lit(1e-6))).otherwise(F.when(x.d == 0, 1.0).otherwise(1e-6))
    total = lambda f: F.aggregate(F.sort_array("n"), F.lit(0.0), lambda a, x: a + f(x))
    return d.select(*keys, "t", "e", "obs", (total(lambda x: weight(x) * x.y_lib) / total(weight)).alias("pred"))


def local_moments(pt, px, lt, lx, ly, mean, thetas, power: float):
    """(moments, points): weighted sums over states of the products of (1, u, y) for u = x less the
    point's, for each theta: the lower triangle of the Gram matrix row by row, and behind it
    the products with y."""
    p = px.shape[1] + 1
    out = np.zeros((len(thetas), len(px), p * (p + 1) // 2 + p))
    step = max(1, PAIRS // max(1, len(lx) * p))
    for start in range(0, len(px), step):
        at = slice(start, start + step)
        u = lx[None] - px[at, None]
        d = np.sqrt((u**2).sum(2))
        there = (pt[at, None] != lt[None]) & np.isfinite(d)
        cols = np.concatenate([np.ones((*d.shape, 1)), u], 2)
        for k, theta in enumerate(thetas):
            m = mean[at, None]
            w = np.where(there, np.exp(-power * theta * np.where(m > 0, d / np.where(m > 0, m, 1), 0)), 0)
            wc = cols * w[:, :, None]
            gram = np.einsum("nli,nlj->nij", wc, cols, optimize=True)
            i, j = np.tril_indices(p)
            out[k, at] = np.concatenate([gram[:, i, j], np.einsum("nli,l->ni", wc, ly)], 1)
    return out


def local_maps(points: DataFrame, library: DataFrame, width: int, keys: Sequence[str] = KEYS, tile: int = TILE, power: float = 2.0) -> DataFrame:
    """(keys, t, which, obs, pred, coefficients) of the local linear maps of points (keys, t, x, y,
    thetas, an array that is one for its series; `which` counts it) with a library (keys, t, x,
    y). Weights are
    exp(-theta d / mean d) over the library without the point itself; rows are multiplied by
    them, so the moments weigh by their square (power 2; 1 gives the root weighting).
    width: the most coordinates of a state.

    A cell of a tile of points and a tile of states gives each point's number of states and sum
    of distances, then its weighted moments, which Spark adds up with map-side combining: no
    task has a whole library. Moments are taken about the point, in columns of one size.
    Fewer states than coefficients give no forecast; columns that depend on each other have
    the coefficients of least norm."""
    size = library.select(*keys, F.posexplode("x").alias("j", "v"), "y").groupBy(*keys, "j").agg(F.max(F.abs("v")).alias("s"), F.avg("y").alias("m"))
    size = size.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "s"))), lambda z: F.when(z.s > 0, z.s).otherwise(1.0)).alias("size"), F.first("m").alias("centre"))
    pts = settle(pack(points, keys, None, max(64, tile // 8), ("thetas",)))
    lib = settle(pack(library, keys, None, tile))
    mine = pts.select(*keys, F.col("tile").alias("pb"), F.col("n").alias("pn"), F.col("width").alias("pw"), F.col("t").alias("pt"), F.col("x").alias("px"), F.col("y").alias("py"), "thetas")
    theirs = lib.select(*keys, "tile", "n", "width", "t", "x", "y")
    kt = _types(points, keys)

    def cells(mine: DataFrame) -> DataFrame:
        """Every tile of points beside every tile of states of its series, each cell dealt by itself."""
        ends = mine.select(*keys, "pb").join(theirs.select(*keys, "tile"), list(keys))
        return ends.join(mine, [*keys, "pb"]).repartition(*keys, "pb", "tile").join(theirs, [*keys, "tile"])

    def far(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                (pt, px, _), (lt, lx, _) = unpack(r["pn"], r["pw"], r["pt"], r["px"], r["py"]), unpack(r["n"], r["width"], r["t"], r["x"], r["y"])
                d = np.sqrt(sum((px[:, j, None] - lx[None, :, j]) ** 2 for j in range(px.shape[1])))
                there = (pt[:, None] != lt[None]) & np.isfinite(d)
                yield pd.DataFrame({**{k: r[k] for k in keys}, "pb": r["pb"], "t": pt, "n": there.sum(1), "d": np.where(there, d, 0).sum(1)})

    mean = cells(mine).mapInPandas(far, f"{kt}, pb long, t long, n long, d double").groupBy(*keys, "pb", "t").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    mean = mean.groupBy(*keys, "pb").agg(F.sort_array(F.collect_list(F.struct("t", "n", "d"))).alias("far"))  # a tile's points
    mine = settle(mine.join(mean, [*keys, "pb"]).join(size, list(keys)))
    m = (width + 1) * (width + 2) // 2 + width + 1

    def moments(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                (pt, px, py), (lt, lx, ly) = unpack(r["pn"], r["pw"], r["pt"], r["px"], r["py"]), unpack(r["n"], r["width"], r["t"], r["x"], r["y"])
                mean = np.array([x["d"] / x["n"] if x["n"] else 0.0 for x in r["far"]])
                thetas = np.asarray(r["thetas"], float)
                size = np.asarray(r["size"], float)
                # distances are of raw states, moments of columns of one size
                own = _scaled(local_moments(pt, px, lt, lx, ly - r["centre"], mean, thetas, power), size)
                p = px.shape[1] + 1
                full = np.zeros((len(thetas), len(pt), m))
                g = p * (p + 1) // 2
                full[:, :, :g], full[:, :, m - width - 1 : m - width - 1 + p] = own[:, :, :g], own[:, :, g:]
                for k in range(len(thetas)):
                    yield pd.DataFrame({**{c: r[c] for c in keys}, "t": pt, "which": k, "obs": np.where(np.isfinite(py), py, np.nan), "p": p, "n": [x["n"] for x in r["far"]], "centre": r["centre"], **{f"m{i}": full[k, :, i] for i in range(m)}}).assign(size=[size.tolist()] * len(pt), x=[x.tolist() for x in px])

    sums = ", ".join(f"m{i} double" for i in range(m))
    found = cells(mine).mapInPandas(moments, f"{kt}, t long, which int, obs double, p int, n long, centre double, {sums}, size array<double>, x array<double>")
    found = found.groupBy(*keys, "t", "which").agg(*[F.first(c).alias(c) for c in ("obs", "p", "n", "centre", "size", "x")], *[F.sum(f"m{i}").alias(f"m{i}") for i in range(m)])

    def solve(frames):
        for pdf in frames:
            out = pdf[[*keys, "t", "which", "obs"]].copy()
            pred, coefs = np.full(len(pdf), np.nan), [None] * len(pdf)
            for p in np.unique(pdf["p"]) if len(pdf) else []:
                at = np.flatnonzero((pdf["p"] == p).to_numpy() & (pdf["n"] >= p).to_numpy())
                if not len(at):
                    continue
                sub = pdf.iloc[at]
                g, i, j = np.zeros((len(at), p, p)), *np.tril_indices(p)
                g[:, i, j] = g[:, j, i] = sub[[f"m{c}" for c in range(p * (p + 1) // 2)]].to_numpy(float)
                right = sub[[f"m{m - width - 1 + c}" for c in range(p)]].to_numpy(float)
                beta = (np.linalg.pinv(g, rcond=1e-14, hermitian=True) @ right[:, :, None])[:, :, 0]
                slope = beta[:, 1:] / np.stack([np.asarray(s, float) for s in sub["size"]])
                pred[at] = beta[:, 0] + sub["centre"].to_numpy(float)
                zero = pred[at] - (slope * np.stack([np.asarray(x, float) for x in sub["x"]])).sum(1)
                for row, z, s in zip(at, zero, slope):
                    coefs[row] = [z, *s]
            yield out.assign(pred=pred, coefficients=coefs)

    solved = found.mapInPandas(solve, f"{kt}, t long, which int, obs double, pred double, coefficients array<double>")
    return solved.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("obs", "pred")})


def _scaled(moments: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Moments of coordinates, in columns divided by `size`."""
    s = np.concatenate([[1.0], size])
    i, j = np.tril_indices(len(s))
    return moments / np.concatenate([s[i] * s[j], s])
