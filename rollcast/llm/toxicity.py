"""Toxicity by a factorization machine over hashed terms.

Terms are words (runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased) and
their prefixes of PREFIXES bytes, hashed to 2^BITS buckets. Buckets whose presence
differs between the classes in the training sample are the features; a document's
feature vector holds the presence of each. The machine scores w0 + sum w_i + sum over
pairs <v_i, v_j>, so two terms together, such as an insult and the group it is aimed at,
weigh other than the sum of both, which no additive model can learn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp as X
from .common import Stash, told_ids, tune, with_columns
from .lang_id import held_out

BITS = 20
PREFIXES = (4, 5, 6)
#: The bounds of the sample that the machine learns from and of its features.
TRAIN_DOCS, FEATURES = 12000, 2048
MIN_Z, MIN_DOCS = 3.5, 4
FACTORS, EPOCHS, RATE, L2 = 8, 80, 0.1, 1e-4
THRESHOLD = 0.7

_INNER = np.ones(256, bool)  # bytes between words
_INNER[np.r_[48:58, 65:91, 97:123, 128:256]] = False


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every term of the whole texts, repeats included."""
    buf, offs = X.lay(texts)
    buf = X.LOWER[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _INNER[buf], [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    p = X.prefix_hash(buf)
    doc = np.searchsorted(offs, start, "right") - 1
    shift = np.uint64(64 - BITS)
    out, docs = [X.span_hash(p, start, stop) >> shift], [doc]
    for i, n in enumerate(PREFIXES):
        long = stop - start > n
        out.append(X.mix(X.span_hash(p, start[long], start[long] + n) + np.uint64(i + 1)) >> shift)
        docs.append(doc[long])
    return np.concatenate(out).astype(np.int64), np.concatenate(docs)


class FactorizationMachine:
    """buckets: the features' hash buckets, sorted; weights w0, w (n,), v (n, FACTORS)."""

    def __init__(self, buckets: np.ndarray, seed: int = 5):
        self.buckets = buckets
        self.w0, self.w = 0.0, np.zeros(len(buckets))
        self.v = np.random.default_rng(seed).normal(0, 0.05, (len(buckets), FACTORS))

    def select(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, document), each pair once, of the texts."""
        bucket, doc = terms(texts)
        table = np.full(1 << BITS, -1, np.int32)
        table[self.buckets] = np.arange(len(self.buckets))
        f = table[bucket]
        key = np.unique(doc[f >= 0] * np.int64(len(self.buckets) + 1) + f[f >= 0])
        return key % (len(self.buckets) + 1), key // (len(self.buckets) + 1)

    def logits(self, f: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        z = self.w0 + np.bincount(doc, self.w[f], n)
        for k in range(FACTORS):
            v = self.v[f, k]
            z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return z

    def fit(self, f: np.ndarray, doc: np.ndarray, y: np.ndarray) -> "FactorizationMachine":
        """Full-batch AdaGrad on the logistic loss; y: 0 or 1 of each document."""
        n, m = len(y), len(self.buckets)
        g0, gw, gv = 1e-8, np.full(m, 1e-8), np.full((m, FACTORS), 1e-8)
        self.w0 = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        for _ in range(EPOCHS):
            d = 1 / (1 + np.exp(-np.clip(self.logits(f, doc, n), -30, 30))) - y
            s = np.stack([np.bincount(doc, self.v[f, k], n) for k in range(FACTORS)], 1)
            dw = np.bincount(f, d[doc], m) / n + L2 * self.w
            dv = np.stack([np.bincount(f, d[doc] * (s[doc, k] - self.v[f, k]), m) for k in range(FACTORS)], 1) / n + L2 * self.v
            g0, gw, gv = g0 + d.mean() ** 2, gw + dw**2, gv + dv**2
            self.w0 -= RATE * d.mean() / np.sqrt(g0)
            self.w -= RATE * 3 * dw / np.sqrt(gw)
            self.v -= RATE * dv / np.sqrt(gv)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        f, doc = self.select(texts)
        return 1 / (1 + np.exp(-np.clip(self.logits(f, doc, len(texts)), -30, 30)))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, use, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine | None:
    """The machine, fitted on TRAIN_DOCS documents at most: those with a label of 0 or 1 for
    which the condition `use` holds, of the smallest id hashes. Ids are of any type; rows
    without one are not learned from. None without both classes.
    The driver gets class counts by bucket (8 MB a part of the sample) and the features."""
    known = labels.where(use & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(*told_ids(labels, id_col), F.col(label_col).cast("int").alias("y"))
    ids = known.groupBy("id", "seed", "order").agg(F.max("y").alias("y")).orderBy("order", "seed").limit(TRAIN_DOCS).toPandas()
    if ids["y"].nunique() < 2:
        return None
    picked = spark.createDataFrame(list(zip(ids["id"].tolist(), ids["seed"].astype(int).tolist(), ids["y"].astype(int).tolist())), "id string, seed long, y int")
    sample = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    sample = sample.select(F.col("seed").alias("id"), "text", "y")
    sample = Stash(spark).put(sample.repartition(6), "sample")

    def count(frames):
        total, docs_of = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for pdf in frames:
            texts, y = X.encode(pdf["text"]), pdf["y"].to_numpy()
            docs_of += np.bincount(y, minlength=2)
            for a, b in X.batches(texts):
                bucket, doc = terms(texts[a:b])
                key = np.unique(doc * np.int64(1 << BITS) + bucket)
                bucket, label = key % (1 << BITS), y[a:b][key >> BITS]
                for c in (0, 1):
                    total[c] += np.bincount(bucket[label == c], minlength=1 << BITS).astype(np.int32)
        if docs_of.any():
            some = np.flatnonzero(total.any(0))
            yield pd.DataFrame({"at": [some.astype(np.int32).tobytes()], "c": [total[:, some].tobytes()], "n0": [docs_of[0]], "n1": [docs_of[1]]})

    total, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2)
    for r in sample.mapInPandas(count, "at binary, c binary, n0 long, n1 long").toLocalIterator():
        at = np.frombuffer(r["at"], np.int32)
        total[:, at] += np.frombuffer(r["c"], np.int32).reshape(2, -1)
        n += [r["n0"], r["n1"]]
    if not n.all():
        return None
    share = total / n[:, None]
    pooled = total.sum(0) / n.sum()
    z = (share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-12)
    z[total.sum(0) < MIN_DOCS] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    fm = FactorizationMachine(np.sort(best[np.abs(z[best]) >= MIN_Z]))

    def features(frames):
        for pdf in frames:
            texts = X.encode(pdf["text"])
            for a, b in X.batches(texts):
                f, doc = fm.select(texts[a:b])
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pd.DataFrame({"id": pdf["id"].values[a:b], "y": pdf["y"].values[a:b], "f": [f[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:])]})

    got = sample.mapInPandas(features, "id long, y int, f binary").toPandas().sort_values(["id", "f"])
    lists = [np.frombuffer(x, np.int32) for x in got["f"]]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return fm.fit(np.concatenate(lists).astype(np.int64), doc, got["y"].to_numpy(float))


def score(docs: DataFrame, fm: FactorizationMachine | None, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (score >= THRESHOLD). Null and empty texts
    have no terms and get the prior; without a machine every score is 0. All of every text
    is read, a batch of 2 MB of texts, or one longer text, at a time (some 100 bytes for
    each of its words). A row's result depends on its text alone, so repeated rows and rows
    without an id get theirs like any. Columns of `docs` named score or predicted are
    replaced; all others pass through. An empty table gives no rows."""

    def make():
        def run(texts):
            raw = X.encode(texts)
            s = np.zeros(len(raw))
            if fm:
                for a, b in X.batches(raw):
                    s[a:b] = fm.scores(raw[a:b])
            return s, (s >= THRESHOLD).astype(np.int32)

        return run

    return with_columns(docs, [text_col], {"score": "double", "predicted": "integer"}, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fm = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 3, 1))
    found = score(docs, fm).drop("text")
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
