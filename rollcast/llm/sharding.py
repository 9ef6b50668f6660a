"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns VIRTUAL points of a ring; a row's key is hashed to the ring and goes to
the shard of the next point clockwise. No shard takes more than its bound: keys that
overflow a full shard continue clockwise to the next point whose shard has room. With N
rows and n shards the bounds are the N div n or one more that exactly hold all rows, so
counts are at most one apart, and a changed shard or key moves few rows.

Keys are placed in ring order. Which keys of an arc overflow follows from the arcs'
counts alone (n * VIRTUAL numbers on the driver, whatever the input), so placing is one
walk over the ring. Rows are ranked in their arcs cell by cell (`ranks.ranked`): a cell is a
fixed piece of the ring, CELLS in all, so an arc is dealt to many tasks."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, back, tune
from .ranks import ranked

SHARDS, VIRTUAL = 16, 64
CELLS = 1 << 17


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order; positions are 63-bit. Nodes
    depend on their shard's number only, so one more shard adds nodes and moves none."""
    nodes = {}
    for s in range(shards):
        for v in range(virtual):
            at = int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") >> 1
            nodes.setdefault(at, s)
    return sorted(nodes.items())


def place(nodes: list[tuple[int, int]], counts: dict[int, int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc go where.

    First every shard takes the keys of its own arcs, in ring order, up to its bound.
    Then the ring is walked with the keys that overflowed: at each node the shard, if it
    has room, takes the keys that have been carried longest."""
    room, slot, out, carried = list(bounds), [0] * len(bounds), [], []

    def take(arc: int, first: int, n: int, shard: int) -> None:
        out.append((arc, first, first + n, shard, slot[shard]))
        slot[shard] += n
        room[shard] -= n

    over = {}
    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        own = min(n, room[shard])
        if own:
            take(arc, 0, own, shard)
        if n > own:
            over[arc] = own
    for lap in range(2):
        for arc, (_, shard) in enumerate(nodes):
            while carried and room[shard]:
                a, first, n = carried[0]
                k = min(n, room[shard])
                take(a, first, k, shard)
                carried[0] = (a, first + k, n - k)
                if n == k:
                    carried.pop(0)
            if lap == 0 and arc in over:
                carried.append((arc, over[arc], counts[arc] - over[arc]))
    return out


def shard(spark: SparkSession, rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, virtual: int = VIRTUAL, order: tuple = ()) -> DataFrame:
    """`rows` with shard (0 to shards - 1) and slot (gapless from 0 in each shard). Rows of one
    key are neighbours on the ring and keep the order of the columns `order`, by whose hash
    rows without a key are placed; rows that tie on those too are interchangeable.
    Columns of `rows` named shard or slot are replaced, all others are kept, whatever their
    names. An empty table gives no rows."""
    back_to, rows = rows, aside(rows, key, *order)
    nodes = ring(shards, virtual)
    points = [p for p, _ in nodes]
    point = F.shiftrightunsigned(F.when(F.col(key).isNull(), F.xxhash64(F.col(key), *order)).otherwise(F.xxhash64(F.col(key))), 1)
    # the arc of a point: how many nodes stand before it; the last wraps to the first
    edges = F.array(*[F.lit(p) for p in points])
    width = 12
    starts = [bisect.bisect_left(points, i << (63 - width)) for i in range((1 << width) + 1)]
    span = max(b - a for a, b in zip(starts, starts[1:]))
    low = F.element_at(F.array(*[F.lit(s) for s in starts]), (F.shiftrightunsigned(F.col("__p"), 63 - width) + 1).cast("int"))
    arc = F.col("__low")
    for i in range(span):
        arc = arc + F.when(F.coalesce(F.try_element_at(edges, F.col("__low") + F.lit(i + 1)), F.lit((1 << 63) - 1)) < F.col("__p"), 1).otherwise(0)
    at = rows.withColumn("__p", point).withColumn("__low", low).withColumn("__arc", F.pmod(arc, F.lit(len(points)))).drop("__low")
    counts = {r["__arc"]: r["n"] for r in at.groupBy("__arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    table = place(nodes, counts, bounds) or [(0, 0, 0, 0, 0)]
    plan = spark.createDataFrame([(a, [(f, e, s, z)]) for a, f, e, s, z in table], "__arc int, __t array<struct<f: long, e: long, s: int, z: long>>")
    plan = plan.groupBy("__arc").agg(F.flatten(F.collect_list("__t")).alias("__t"))
    at = ranked(at.withColumnRenamed("__p", "__at"), ["__arc"], F.col("__at"), [key, *order], "__rank", CELLS)
    placed = at.join(F.broadcast(plan), "__arc")  # n * virtual rows and as many cuts at most
    placed = placed.withColumn("__t", F.filter("__t", lambda t: (t.f <= F.col("__rank")) & (F.col("__rank") < t.e))[0])
    out = placed.withColumn("shard", F.col("__t.s")).withColumn("slot", F.col("__t.z") + F.col("__rank") - F.col("__t.f"))
    return back(out, back_to, (key, *order), ("shard", "slot"))


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, size, text_crc32) of every row, and its columns `more`. A null text has size 1
    and the CRC of no bytes. Whole texts are read, by the JVM."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *more)


def _told(found: DataFrame, *more: str) -> DataFrame:
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *more)


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row. The law is
    `rows`: counts at most one apart. A null text has size 1 and the CRC of no bytes. Rows
    that repeat an id are rows like any and get slots of their own. Whole texts are read,
    by the JVM; other columns are not. An empty table gives no rows."""
    return _told(shard(spark, sizes(docs), "doc_id", shards, order=("size", "text_crc32")))


def shard_in_order(spark: SparkSession, rows: DataFrame, by: str, shards: int = SHARDS) -> DataFrame:
    """As `shard_documents`, of rows as `sizes` makes them with a column `by` of different whole
    numbers from 0: the slots of each shard follow it, and it is returned too. `rows` is
    read several times, so a computed table should be written first. An empty table gives
    no rows."""
    last = rows.agg(F.max(by)).first()[0] or 0
    point = F.col(by) * F.lit(((1 << 63) - 1) // (last + 1))  # spread over the cells of `ranked`
    placed = shard(spark, rows, "doc_id", shards, order=("size", "text_crc32", by))
    return _told(ranked(placed, ["shard"], point, [], "slot"), by)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return shard_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
