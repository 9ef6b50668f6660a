"""Sinks: CSV, LaTeX tables, plot data, manifest, run record, zip bundle, guard.

Tables that are formatted here are bounded results; series and scores are written by Spark."""

from __future__ import annotations

import json
import math
import os
import platform
import shutil
import time
import zipfile
from collections.abc import Mapping, Sequence

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import table_round
from .align import wide

def clear(folder: str) -> None:
    """Stale outputs of an earlier run go."""
    shutil.rmtree(folder, ignore_errors=True)
    os.makedirs(folder)


def save_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header in the folder `path`, replacing what is there."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def save_bundle(scores: DataFrame, features: Sequence[str], folder: str, prefix: str, keep: Sequence[str] = ("series_id", "t_src", "date_src")) -> list[str]:
    """The global and local scores, p-values and flags, each with a column a feature."""
    names = {"g": "global_contributions", "l": "local_contributions", "p": "p_values", "sig": "significance_flags"}
    return [save_csv(wide(scores, v, features, keep), f"{folder}/{prefix}_{n}") for v, n in names.items() if v in scores.columns]


_ESCAPES = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "&%$#_{}"}


def _cell(x, digits: int) -> str:
    if x is None or isinstance(x, float) and not math.isfinite(x):
        return "--"
    if isinstance(x, float):
        return f"{x:.{digits}f}".rstrip("0").rstrip(".")
    return "".join(_ESCAPES.get(c, c) for c in str(x))


def latex_table(df: DataFrame, caption: str, label: str, *, digits: int = 4, longtable: bool = False, max_rows: int | None = None) -> str:
    """A table of all rows, or of the first max_rows: floats are rounded half to even, missing and
    non-finite values are `--`, special characters are escaped."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    shown = df.select(*[table_round(F.col(c), digits).alias(c) if c in floats else F.col(c) for c in df.columns])
    rows = shown if max_rows is None else shown.limit(max_rows)
    body = [" & ".join(_cell(x, digits) for x in r) + r" \\" for r in rows.toLocalIterator()]
    head = " & ".join(_cell(c, digits) for c in df.columns) + r" \\"
    form = "l" * len(df.columns)
    if longtable:
        return "\n".join([rf"\begin{{longtable}}{{{form}}}", rf"\caption{{{caption}}}\label{{{label}}}\\", r"\toprule", head, r"\midrule", r"\endhead", *body, r"\bottomrule", r"\end{longtable}", ""])
    return "\n".join([r"\begin{table}[htbp]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{form}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def save_latex(df: DataFrame, path: str, caption: str, label: str, **options) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(latex_table(df, caption, label, **options))
    return path


def save_intervals(intervals: DataFrame, folder: str, prefix: str, features: Sequence[str]) -> list[str]:
    """For each feature with intervals: CSV, the full table (long beyond 40 rows), an excerpt."""
    out = []
    counts = {r["feature"]: r["count"] for r in intervals.groupBy("feature").count().collect()}
    for f in features:
        if n := counts.get(f, 0):
            d = intervals.where(F.col("feature") == f).orderBy("start_date")
            out += [
                save_csv(d, f"{folder}/{prefix}_significant_intervals_{f}"),
                save_latex(d, f"{folder}/tab_{prefix}_significant_intervals_{f}_full.tex", f"Significant intervals for {f}.", f"tab:{prefix}_{f}_full", longtable=n > 40),
                save_latex(d, f"{folder}/tab_{prefix}_significant_intervals_{f}_excerpt.tex", f"Excerpt of significant intervals for {f}.", f"tab:{prefix}_{f}_excerpt", max_rows=30),
            ]
    return out


def forecast_plot_data(preds: DataFrame, tp: int, models: Sequence[str], last: int | None = None) -> DataFrame:
    """Observed and forecast values by time of some models, the last rows of each if so asked."""
    d = preds.where((F.col("tp") == tp) & F.col("model").isin(*models))
    if last is not None:
        d = d.withColumn("__r", F.row_number().over(Window.partitionBy("series_id", "model").orderBy(F.desc("t_pred")))).where(F.col("__r") <= last).drop("__r")
    return d.select("series_id", "model", "t_pred", "obs", "pred")


def metric_plot_data(metrics: DataFrame, metric: str = "rmse") -> DataFrame:
    return metrics.select("series_id", "model", "tp", F.col(metric).alias("value"))


def score_plot_data(scores: DataFrame) -> DataFrame:
    """Scores with their envelopes, a line and a band a feature."""
    return scores.select("series_id", "feature", "t_src", "date_src", "g", *[c for c in ("lo", "hi") if c in scores.columns])


def boxplot_data(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and the ends of the whiskers (1.5 interquartile ranges) by group."""
    q = df.groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    d = df.join(q, group)
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.when(F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach), F.col(value))
    return d.groupBy(group).agg(F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.min(inside).alias("low"), F.max(inside).alias("high"))


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file, bytes) of the files below a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def run_info(options: Mapping, path: str | None = None) -> str:
    """A JSON record of the run: versions, time, options."""
    out = json.dumps({"python": platform.python_version(), "spark": pyspark.__version__, "time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "options": dict(options)}, indent=2, sort_keys=True, default=str)
    if path:
        with open(path, "w") as f:
            f.write(out)
    return out


def bundle(folder: str, path: str) -> str:
    """A zip file of a local folder."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(folder):
            for f in sorted(files):
                full = os.path.join(top, f)
                if os.path.abspath(full) != os.path.abspath(path):
                    z.write(full, os.path.relpath(full, folder))
    return path


class NotReady(RuntimeError):
    """Outputs that the guard rejects."""


def guard(spark: SparkSession, recovery: DataFrame | None, attribution: DataFrame | None = None, *, excluded: Sequence[str] = (), tables: Mapping[str, str] | None = None, effect: DataFrame | None = None, files: DataFrame | None = None, attributed: bool | None = None, least: float = 0.60, strict: bool = False) -> DataFrame:
    """One row (status PASS or FAIL, problems, notes): the synthetic recovery reaches `least`,
    excluded features are not attributed, no file of `files` (a manifest) is an interval
    table of an excluded feature, which an earlier run left, and tables hold no literal NaN
    or inf. An attribution must be there if `attributed`, by default if features are
    excluded. The effect's interval is reported and does not decide. `strict` raises
    NotReady with the problems of a FAIL."""
    problems, notes = [], []
    if recovery is None:
        problems.append("no synthetic recovery")
    else:
        weak = sorted(f"{r['feature']}: {r['corr_with_truth']}" for r in recovery.collect() if not (r["corr_with_truth"] or 0) >= least)
        problems += [f"synthetic recovery below {least}: {', '.join(weak)}"] if weak else []
    if attribution is None:
        problems += ["no attribution"] if (bool(excluded) if attributed is None else attributed) else []
    else:
        seen = sorted(r["feature"] for r in attribution.where(F.col("feature").isin(list(excluded))).select("feature").distinct().collect())
        problems += [f"excluded features are attributed: {', '.join(seen)}"] if seen else []
    if files is not None and excluded:
        names = F.regexp_replace("file", r"(\.csv|_full\.tex|_excerpt\.tex)$", "")
        stale = [names.endswith(f"significant_intervals_{f}") for f in excluded]
        # a CSV may be a folder of part files
        stale += [F.element_at(F.split("path", "/"), -2).endswith(f"significant_intervals_{f}") for f in excluded]
        rule = stale[0]
        for one in stale[1:]:
            rule = rule | one
        old = sorted(r["path"].rsplit("/", 1)[-1] for r in files.where(rule).select("path").limit(10).collect())
        problems += [f"stale files of excluded features: {', '.join(old)}"] if old else []
    bad = [n for n, text in (tables or {}).items() if any(f" {w}" in text.lower() or f"{w} " in text.lower() for w in ("nan", "inf"))]
    problems += [f"literal NaN or inf in: {', '.join(sorted(bad)[:10])}"] if bad else []
    if effect is not None and (r := effect.first()) is not None:
        notes.append("the ablation interval is above zero" if (r["ci_low"] or 0) > 0 else "the ablation interval holds zero")
    else:
        notes.append("no ablation")
    if strict and problems:
        raise NotReady("; ".join(problems))
    return spark.createDataFrame([("FAIL" if problems else "PASS", "; ".join(problems), "; ".join(notes))], "status string, problems string, notes string")


def definitions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """What the baselines and the null are, as tables."""
    b = [("B1_mean", "mean of the target over the library, for every time"), ("B2_persistence", "value of the target at the forecast's source time")]
    n = [("null", "circular shifts of the forecast by multiples of the period, or shuffled calendar blocks"), ("fdr", "Benjamini-Hochberg over the features of each time"), ("p", "(count + 1) / (replicates + 1), so 1 / (replicates + 1) at least")]
    return spark.createDataFrame(b, "baseline string, definition string"), spark.createDataFrame(n, "component string, definition string")
