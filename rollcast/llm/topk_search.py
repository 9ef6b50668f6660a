"""Exact top-k search by inner product, with a three-phase uniform threshold.

A vector's components are cut into LISTS runs; each run gives a query a list of partial
scores, and a score is the sum of its parts. Candidates and queries are packed into blocks
of ROWS vectors, and a cell is a block of each.

1. Every cell takes each query's k best entries of every list and adds up the scores of
   those vectors. The k-th best of what all cells gathered is a score that k vectors reach,
   so it is a safe cutoff.
2. The cutoffs go out with the query blocks. A score of at least the cutoff has a part of at
   least cutoff / LISTS, so these entries suffice: every vector of the answer has one.
3. A vector whose entries, with the uniform threshold for the parts that were not collected,
   cannot reach the cutoff is dropped. The parts that remain of the others are added, and
   each cell returns the k best of each query, so rows out of a cell do not grow with pairs.

Numbers are exact: products are taken in doubles while no sum can pass 2^53, else in
integers of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stash

K, SCALE, LISTS = 5, 256, 4
ROWS = 2048  # of a block
TILE = 1 << 19  # pairs that are scored at once


def pack(frames):
    """Blocks (b, n, width, ids, values) from rows (b, id, v) in order of b: vectors as rows of
    one matrix of floor(SCALE * x), short ones filled up with zeros."""

    def told(b, ids, held):
        width = max(map(len, held))
        m = np.zeros((len(held), width))
        for i, v in enumerate(held):
            m[i, : len(v)] = v
        return pd.DataFrame([(b, len(held), width, np.array(ids, np.int64).tobytes(), np.floor(m * SCALE).tobytes())], columns=["b", "n", "width", "ids", "values"])

    own, ids, held = None, [], []
    for pdf in frames:
        for b, i, v in zip(pdf["b"], pdf["id"], pdf["v"]):
            if b != own and held:
                yield told(own, ids, held)
                ids, held = [], []
            own = b
            ids.append(i)
            held.append(np.asarray(v, float))
    if held:
        yield told(own, ids, held)


def blocks(stash: Stash, vectors: DataFrame, n: int, name: str) -> DataFrame:
    """`vectors` (id, v) dealt to n blocks by a hash of the whole row."""
    dealt = vectors.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(n)))
    dealt = dealt.repartition("b").sortWithinPartitions("b", "id").select("b", "id", "v")
    return stash.put(dealt.mapInPandas(pack, "b long, n int, width int, ids binary, values binary"), name)


def _read(ids: bytes, values: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, np.float64).reshape(n, width)


def partial_scores(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """The partial scores of queries (rows) and candidates (columns) in each list."""
    width = min(q.shape[1], c.shape[1])  # what one of them lacks is zero
    q, c = q[:, :width], c[:, :width]
    if width and float(np.abs(q).max()) * float(np.abs(c).max()) * width >= 2.0**53:
        q, c = (np.array([[int(x) for x in row] for row in m], object) for m in (q, c))
    edge = np.linspace(0, width, lists + 1).astype(int)
    empty = np.zeros((len(q), len(c)))
    return [q[:, a:b] @ c[:, a:b].T if b > a else empty for a, b in zip(edge, edge[1:])]


def _tiles(q: np.ndarray, c: np.ndarray):
    step = max(1, TILE // max(1, len(c)))
    for i in range(0, len(q), step):
        yield i, q[i : i + step]


def gathered(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, lists: int):
    """(query, score): of each query the k best scores of vectors that lead one of its lists."""
    for start, part in _tiles(q, c):
        parts = partial_scores(part, c, lists)
        score, other = sum(parts), qids[start : start + len(part), None] != cids[None]
        lead = np.zeros(other.shape, bool)
        for p in parts:
            p = np.where(other, p.astype(float), -np.inf)
            at = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
            np.put_along_axis(lead, at, True, axis=1)
        row, col = np.nonzero(lead & other)
        s = score[row, col]
        order = np.lexsort((-s, row)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda i: (row[i], -s[i])), int)
        row, s = row[order], s[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        yield row[place < k] + start, s[place < k]


def resolved(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, cutoff: np.ndarray, k: int, lists: int):
    """(query, candidate, score): of each query the k best candidates, ties to smaller ids,
    among those that reach its cutoff."""
    for start, part in _tiles(q, c):
        parts = partial_scores(part, c, lists)
        least = cutoff[start : start + len(part)]
        enough = [p * lists >= least[:, None] for p in parts]
        row, col = np.nonzero(np.logical_or.reduce(enough) & (qids[start : start + len(part), None] != cids[None]))
        least = least[row]
        if parts[0].dtype != object:
            # at most: collected parts, and the threshold for the others
            most = sum(np.where(e[row, col], p[row, col], least / lists) for e, p in zip(enough, parts))
            some = most >= least - 1e-6 * np.abs(least)
            row, col, least = row[some], col[some], least[some]
        s = sum(p[row, col] for p in parts)
        some = s >= least
        row, col, s = row[some], col[some], s[some]
        order = np.lexsort((cids[col], -s, row)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda i: (row[i], -s[i], cids[col[i]])), int)
        row, col, s = row[order], col[order], s[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        yield row[place < k] + start, col[place < k], s[place < k]


def _below(x) -> float:
    """The largest double that is not above x, for a cutoff that stays safe."""
    if not -1e300 < x < 1e300:
        return 1e300 if x > 0 else -np.inf
    return float(x) if float(x) <= x else float(np.nextafter(float(x), -np.inf))


def _long(s) -> list[int]:
    return [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in s]


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, lists: int = LISTS, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k best rows of `vectors`
    (all, if fewer) by the inner product of floor(256 * x), x as double; both have the same
    two columns. Ranks count from 1, ties go to smaller ids.

    Rows without an id, null vectors, and those with components that are null, not finite,
    or not finite after the scaling take no part. Vectors of other lengths are compared
    as if filled up with zeros, so an empty one scores 0 with all. Rows that repeat an id
    and a vector are one row. Rows of one id with different vectors are candidates of
    their own, and as queries each has a list of its own; none meets a row of its id.
    Scores beyond a long stand at its limits. Empty
    tables give no rows; other columns, whatever their names, are not read."""
    stash = Stash(spark)

    def whole(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < F.lit(float("inf")))
        return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine)).distinct()

    n, c, q = {}, whole(vectors), whole(queries)
    for name, df in (("c", c), ("q", q)):
        n[name] = -(-df.select(F.hash("id", "v")).count() // rows) or 1
    c, q = blocks(stash, c, n["c"], "candidates"), blocks(stash, q, n["q"], "queries")
    q = q.select(F.col("b").alias("qb"), F.col("n").alias("qn"), F.col("width").alias("qwidth"), F.col("ids").alias("qids"), F.col("values").alias("qvalues"))
    last = n["c"] - 1

    def cells(q: DataFrame) -> DataFrame:
        """Every query block beside every candidate block, dealt by the latter."""
        return q.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).join(c.hint("merge"), "b")

    def first(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                (qids, qm), (cids, cm) = _read(r.qids, r.qvalues, r.qn, r.qwidth), _read(r.ids, r.values, r.n, r.width)
                for row, s in gathered(qids, qm, cids, cm, k, lists):
                    yield pd.DataFrame({"qb": r.qb, "qi": row, "score": [_below(x) for x in s]})

    scores = cells(q).mapInPandas(first, "qb long, qi long, score double")
    best = Window.partitionBy("qb", "qi").orderBy(F.desc("score"))
    cutoff = scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).where(F.col("r") == k)
    # a block's cutoffs are at most `rows` numbers
    cutoff = cutoff.groupBy("qb").agg(F.collect_list("qi").alias("qi"), F.collect_list("score").alias("cutoff"))
    cut = stash.put(q.join(cutoff, "qb", "left"), "cutoffs")

    def second(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                (qids, qm), (cids, cm) = _read(r.qids, r.qvalues, r.qn, r.qwidth), _read(r.ids, r.values, r.n, r.width)
                cutoff = np.full(len(qids), -np.inf)
                if r.qi is not None:
                    cutoff[np.asarray(r.qi, int)] = r.cutoff
                for row, col, s in resolved(qids, qm, cids, cm, cutoff, k, lists):
                    yield pd.DataFrame({"qb": r.qb, "qi": row, "query_id": qids[row], "vec_id": cids[col], "score": _long(s)})

    found = cells(cut).mapInPandas(second, "qb long, qi long, query_id long, vec_id long, score long")
    order = Window.partitionBy("qb", "qi").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0))
