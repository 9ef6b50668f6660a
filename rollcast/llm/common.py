"""What the operators share: shared working folders, row hashes, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


LINKS = 500_000  # links that a task contracts together
_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "integer": pa.int32(), "boolean": pa.bool_()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, local
    sessions, as in tests, get a temporary one, and a cluster raises a RuntimeError."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        got = os.path.join(tempfile.gettempdir(), f"rollcast-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(got)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return got


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of texts or sets stays at a few MB in every worker. Hot keys
    of joins are split even where that costs another exchange behind the join."""
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def told_ids(df: DataFrame, id_col: str) -> list:
    """Columns id (as text, whatever its type), seed (of it: a whole number stands for itself)
    and order (a hash) for a sample by id."""
    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    return [F.col(id_col).cast("string").alias("id"), (F.col(id_col).cast("long") if whole else F.xxhash64(id_col)).alias("seed"), F.xxhash64(id_col).alias("order")]


def with_columns(df: DataFrame, inputs: list[str], new: dict[str, str], make) -> DataFrame:
    """`df` with the columns `new` (name: type), which replace columns of those names. `make`
    starts on each partition and gives a function from the batch's values of `inputs`
    (lists) to those of the new columns. All other columns pass through as Arrow, so
    values of any type, nulls and large integers stay as they are."""
    kept = [c for c in df.columns if c not in new or c in inputs]
    schema = df.select(*kept).schema
    for name, kind in new.items():
        if name not in inputs:
            schema = schema.add(name, kind)

    def run(batches):
        start = make()
        for batch in batches:
            got = start(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
            out |= {c: pa.array(list(v), _ARROW[new[c]], from_pandas=True) for c, v in zip(new, got)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return df.mapInArrow(run, schema)


def aside(docs: DataFrame, *keep: str) -> DataFrame:
    """`docs` with its columns named by place, all but `keep`, so that new columns clash with
    none."""
    return docs.toDF(*[c if c in keep else f"__col{i}" for i, c in enumerate(docs.columns)])


def back(df: DataFrame, docs: DataFrame, keep: tuple, new: tuple = ()) -> DataFrame:
    """A frame made from `aside(docs, *keep)` with the names of `docs` again, and the columns
    `new`, which replace those of their names."""
    kept = [(c if c in keep else f"__col{i}", c) for i, c in enumerate(docs.columns) if c not in new]
    return df.select(*[F.col(f"`{x}`") for x in [*[x for x, _ in kept], *new]]).toDF(*[c for _, c in kept], *new)


_freed = 0.0


def free(spark: SparkSession, every: float = 2.0) -> None:
    """Lets Spark delete the shuffle files of frames that nobody holds any more, at most once
    in `every` seconds."""
    global _freed
    if time.monotonic() - _freed > every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _freed = time.monotonic()


class Stash:
    """Tables written to the shared folder: they cut lineage, so a lost executor costs a
    re-read and not a recomputation, and they let earlier shuffle files go. An operator's
    result reads its last tables, so they stay until `release`."""

    held: list["Stash"] = []

    def __init__(self, spark: SparkSession):
        tune(spark)
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
        Stash.held.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        schema = df.schema
        del df
        free(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._stash_path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(but: list[Stash] | tuple = ()) -> None:
    """Deletes the tables of all stashes, those in `but` apart: for when the operators' results
    have been written or read."""
    for stash in [x for x in Stash.held if x not in but]:
        if stash.spark.sparkContext._jsc is not None:  # else the session has ended
            stash._delete(stash.root)
        Stash.held.remove(stash)


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect what the given ones do, from each end to the smallest that it
    reaches by them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            some = np.flatnonzero(label != np.arange(len(ids)))
            return ids[some], ids[label[some]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _contracted(frames, links):
    held, n = [], 0
    for pdf in frames:
        held.append(pdf)
        n += len(pdf)
        if n >= links:
            yield pd.DataFrame(dict(zip("uv", contract(*(np.concatenate([x[c].to_numpy() for x in held]) for c in "uv")))))
            held, n = [], 0
    if n:
        yield pd.DataFrame(dict(zip("uv", contract(*(np.concatenate([x[c].to_numpy() for x in held]) for c in "uv")))))


def components(spark: SparkSession, edges: DataFrame, stash: Stash | None = None) -> DataFrame:
    """(id, component) for every end of `edges` (u, v): component is the smallest id that
    links reach. Each task contracts the links that it has, LINKS at a time, which shortens
    paths; then alternating large-star and small-star rounds, each two aggregations with
    map-side combining and two joins. Both sides of a join are tables, so adaptive
    execution sees a hub's rows in the exchange and splits them; no component or
    neighbour list is ever gathered in one task or on the driver. Self-links and repeated
    links are fine; no links give no rows."""
    stash = stash or Stash(spark)
    links = LINKS
    e = edges.select("u", "v").where("u <> v").mapInPandas(lambda frames: _contracted(frames, links), "u long, v long")
    e = stash.put(e.distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash.put(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = toward(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stash.put(large, "large")
        # small star: the smaller neighbours and the node itself go to the smallest
        low = stash.put(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = toward(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        after = stash.put(after.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        stash.drop(e, least, large, low)
        e, now = after, seen.get
        if now == before:
            break
        before = now
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def toward(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the label m of u. A merge join: a hash join would have to hold a side."""
    return edges.join(least.hint("merge"), "u")
