"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A bounded sample fits the codes: vectors of unit length are centred, and a rotation is
learned that alternates between the nearest signs and the best rotation onto them
(iterative quantisation), so bits are balanced and keep angles. Further rotations from
other starts give further bits. A code is cut into substrings, each the key of one
Hamming table: vectors that agree on a substring (and on the label) are candidates, and
are reranked by the cosine of the original vectors. Every vector is indexed.

The number of bits of a key grows with the logarithm of the row count, so buckets stay
small, and the number of tables follows from it: a pair at the threshold differs in a
bit with probability angle / pi, and the chance to miss all tables is at most MISS.
A bucket of any size is cut into shards that are compared cell by cell. A pair is
counted in the first table that it shares only; tasks return links per vector and
forests of links, never pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, components

SAMPLE = 5000  # vectors that the codes are fitted on
ROUNDS = 30
MISS = 0.002
BUCKET = 16  # vectors of a bucket, about
SHARD = 2048


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and norms
    of very large or small rows neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


class Codes:
    """mean (d,), rotations [(d, d)], bits of a key, number of tables."""

    def __init__(self, sample: np.ndarray, bits: int, tables: int, seed: int = 11):
        u = scaled(sample)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        self.mean = u.mean(0)
        c = u - self.mean
        # the principal axes, all of them: no dimension is dropped
        axes = np.linalg.svd(c.T @ c)[0]
        v = c @ axes
        d, rng = v.shape[1], np.random.default_rng(seed)
        self.bits, self.tables, self.planes = bits, tables, []
        for _ in range(-(-bits * tables // d)):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(ROUNDS):
                a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (a @ b).T
            self.planes.append(axes @ r)
        self.planes = np.concatenate(self.planes, 1)
        # bits of one key are drawn from all over the code
        self.order = np.random.default_rng(seed + 1).permutation(self.planes.shape[1])[: bits * tables]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, tables) substrings of the codes."""
        u = scaled(x)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        sign = ((u - self.mean) @ self.planes[:, self.order] >= 0).reshape(len(x), self.tables, self.bits)
        return (sign * (1 << np.arange(self.bits, dtype=np.int64))).sum(2)


def key_plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors and a cosine threshold."""
    bits = min(40, max(6, math.ceil(math.log2(max(n, 1) / BUCKET))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)) if same < 1 else 1)


def cell_links(x: np.ndarray, keys: np.ndarray, table: int, weight: np.ndarray, side: np.ndarray | None, threshold: float):
    """A spanning forest of the links in one cell of a bucket, and the weight of what each
    vector links with, pairs that share an earlier table left out of the latter."""
    x = scaled(x)
    norm = np.linalg.norm(x, axis=1)
    link = x @ x.T >= threshold * norm[:, None] * norm[None]
    np.fill_diagonal(link, False)
    if side is not None:
        link &= side[:, None] != side[None]
    forest, label = [], np.arange(len(x))
    for i in np.flatnonzero(link.any(1)):
        y = np.flatnonzero(link[i])
        near, own = label[y], label[i]
        forest += [(i, y[near == a][0]) for a in np.unique(near) if a != own]
        joined = np.append(near, own)
        label[np.isin(label, joined)] = joined.min()
    if forest:
        for t in range(table):
            link &= keys[:, t][:, None] != keys[:, t][None]
    return forest, link @ weight


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: vectors of equal, non-null labels and
    equal length link when their cosine in double precision is `threshold` at least.
    n_links counts the other vectors linked directly, component_id is the smallest id that
    links reach, kept says that it is the row's own. Null and zero vectors, and vectors
    with null or non-finite components, link with nothing; neither do rows without an id,
    whose component and kept are null. Equal vectors are one class. A vector is an id with
    its label and components: rows that repeat these get equal rows and count once. Other
    columns, whatever their names, are not read. An empty table gives no rows."""
    stash = Stash(spark)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = "id is not null and label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)"
    # rows that link with nothing have no label here
    ids = stash.put(src.withColumn("label", F.expr(f"CASE WHEN {fine} THEN label END")).withColumn("h", F.xxhash64("v")).withColumn("h2", F.hash("v")), "vectors")
    live = ids.where("label is not null")
    one = ["label", "h", "h2"]
    classes = live.groupBy(*one).agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("weight"), F.any_value("v").alias("v"))
    classes = stash.put(classes.withColumn("c", F.xxhash64(*one)), "classes")
    own = stash.put(classes.select(*one, "c", "class_id", "weight"), "own")
    sizes = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    total, top = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(F.struct("n", "d"))).first()
    if not total:
        return ids.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.when(F.col("id").isNotNull(), True).alias("kept"))
    d = top["d"]
    bits, tables = key_plan(int(total), threshold)
    sample = classes.where(F.size("v") == d).orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("v").toPandas()["v"]
    codes = Codes(np.stack(sample.to_numpy()).astype(float), bits, tables)

    def encode(frames):
        for pdf in frames:
            if len(pdf):
                # a vector of another length is padded or cut for its code only
                x = np.stack([np.resize(np.append(v, np.zeros(max(0, d - len(v)))), d) if len(v) != d else v for v in pdf["v"]]).astype(float)
                x[~x.any(1)] = 1
                yield pdf[["label", "c", "weight", "v"]].assign(keys=list(codes.keys(x)))

    coded = stash.put(classes.select("label", "c", "weight", "v").mapInPandas(encode, "label string, c long, weight long, v array<double>, keys array<long>"), "codes")
    stash.drop(classes)
    at = coded.select("label", F.size("v").alias("d"), "c", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "d", "t", "key"]
    full = at.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("k", F.ceil(F.col("m") / SHARD).cast("int")).drop("m")
    at = at.join(full, bucket).withColumn("o", F.pmod(F.xxhash64("c"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    at = at.select(*bucket, "k", F.least("o", "j").alias("a"), F.greatest("o", "j").alias("b"), "o", "c")
    rows = at.join(coded.select("c", "weight", "v", "keys").hint("merge"), "c")
    order = [*bucket, "a", "b"]

    def run(frames):
        key, held = None, []

        def flush():
            if len(held) < 2:
                return None
            apart = held[0][1] != held[0][2]
            side = np.array([r[3] == r[2] for r in held]) if apart else None
            if apart and side.all() == side.any():
                return None
            forest, links = cell_links(np.stack([r[6] for r in held]), np.stack([r[7] for r in held]), held[0][0], np.array([r[5] for r in held]), side, threshold)
            some, c = np.flatnonzero(links), [r[4] for r in held]
            return [(c[i], c[j], None) for i, j in forest] + [(c[i], None, int(links[i])) for i in some]

        for pdf in frames:
            out = []
            for *g, a, b, o, c, w, v, ks in zip(*(pdf[x] for x in [*bucket, "a", "b", "o", "c", "weight", "v", "keys"])):
                if (*g, a, b) != key:
                    out += flush() or []
                    key, held = (*g, a, b), []
                held.append((g[2], a, b, o, c, w, np.asarray(v, np.float64), np.asarray(ks, np.int64)))
            if out:
                yield frame(out)
        if last := flush():
            yield frame(last)

    def frame(rows):
        u, v, n = zip(*rows)
        return pd.DataFrame({"u": u, "v": pd.array(v, "Int64"), "links": pd.array(n, "Int64")})

    found = rows.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, "u long, v long, links long")
    found = stash.put(found, "links")
    comp = components(spark, found.where("v is not null").select("u", "v").distinct(), stash)
    links = found.where("links is not null").groupBy(F.col("u").alias("c")).agg(F.sum("links").alias("links"))
    own = own.join(links, "c", "left").join(comp.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = own.groupBy("component").agg(F.min("class_id").alias("component_id"))
    own = own.join(least, "component").select(*one, "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    # a class may hold a third of all rows: both sides are tables, so that the join can split it
    own = stash.put(own, "result")
    out = ids.select("id", *one).join(own.hint("merge"), one, "left")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
