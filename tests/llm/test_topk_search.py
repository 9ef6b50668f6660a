"""Top-k search against all pairs in Python's integers, and against SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from rollcast.llm import queries, topk_search

SCHEMA = "vec_id long, embedding array<double>, rank string, score string, id int"


def rows(seed=0, dims=7, n=150):
    rng = random.Random(seed)
    out = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(dims)]) for i in range(n)]
    out += [(1000 + i, [0.25] * dims) for i in range(40)]  # ties
    out += [(50, out[50][1]), (50, out[50][1]), (150, [-0.1] * dims), (150, [0.1] * dims)]  # repeated rows, an id twice
    out += [(None, [1.0] * dims), (2000, None), (2050, [None] * dims), (2051, [float("nan")] * dims), (2100, [float("inf")] + [0.0] * (dims - 1))]
    out += [(2150, []), (2151, [0.5, 0.5]), (2200, [0.5] * (dims + 3)), (2250, [0.0] * dims), (2300, [1e307] * dims)]
    return [(i, v, "x", None, 3) for i, v in out]


def plain(data, k=5, every=50):
    v = {(i, tuple(math.floor(256 * x) for x in e)) for i, e, *_ in data if i is not None and e is not None and all(x is not None and math.isfinite(256 * x) for x in e)}
    out = []
    for q, a in v:
        if q % every == 0:
            got = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,lists,size,tile", [(5, 4, 16, 50), (1, 1, 2048, 1 << 19), (300, 3, 64, 1 << 19), (5, 20, 7, 1)])
def test_equals_all_pairs(spark, monkeypatch, k, lists, size, tile):
    monkeypatch.setattr(topk_search, "TILE", tile)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = topk_search.search(spark, df, df.where("vec_id % 50 = 0"), k=k, lists=lists, rows=size)
    assert sorted(map(tuple, got.collect())) == plain(rows(), k)


def test_large_components_are_exact(spark):
    rng = random.Random(1)
    data = [(i, [rng.choice([-1, 1]) * float(rng.randrange(1 << 20, 1 << 21)) for _ in range(5)], "", "", 0) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    got = topk_search.search(spark, df, df.where("vec_id % 20 = 0"), rows=16)
    assert sorted(map(tuple, got.collect())) == plain(data, every=20)


def test_few_rows(spark):
    df = spark.createDataFrame(rows()[:1], SCHEMA)
    assert topk_search.search(spark, df, df).collect() == []
    none = df.limit(0)
    assert topk_search.search(spark, none, df).collect() == topk_search.search(spark, df, none).collect() == []
    assert topk_search.search(spark, df.limit(0), none).columns == ["query_id", "rank", "vec_id", "score"]


def test_threshold_drops_no_answer():
    """Phase by phase on one cell: the cutoff is reached by k vectors, few are resolved."""
    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(500, 32)) * 40)
    q, ids = c[:20] + np.floor(rng.normal(size=(20, 32)) * 4), np.arange(500)
    own = np.full(20, -1)
    scores = q @ c.T
    cutoff = np.array([sorted(s[row == i])[-5] for row, s in topk_search.gathered(own, q, ids, c, 5, 4) for i in range(20)])
    fifth = np.sort(scores, axis=1)[:, -5]
    assert (cutoff <= fifth).all()
    (row, col, s), = topk_search.resolved(own, q, ids, c, cutoff, 5, 4)
    for i in range(20):
        assert sorted(s[row == i]) == sorted(scores[i])[-5:]
        assert (scores[i, col[row == i]] == s[row == i]).all()


def test_sql_on_odd_rows(spark, tmp_path):
    data = [r for r in rows(2) if r[0] not in (150, 2300)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op12_topk_search"]).fetchall()
    assert sorted(map(tuple, topk_search.query(spark, str(tmp_path)).collect())) == sorted(want)
