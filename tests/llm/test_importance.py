"""Importance resampling against a plain count of every run of words, and against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from rollcast.llm import importance, queries

SCHEMA = "doc_id long, text string, rank string, id long, n_features double"


def rows(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "ÉTÉ", "Naïve", "日本", "x9"]
    gaps = [" ", ", ", "\n", "-", "\u007f", "_", "[", "\t\t"]
    out = [(i, "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 3, 19, 20, 21, 60, 300]))), "x", 7, 0.5) for i in range(120)]
    same = " ".join(f"W{i}" for i in range(30))
    out += [(500, same, None, 1, None), (500, same, None, 1, None), (None, same, "a", 2, 1.0), (None, None, "a", None, 1.0), (600, None, "b", 3, 1.0), (601, "", "b", 3, 1.0), (602, " .\n", "b", 3, 1.0)]
    return out + [(700, " ".join(rng.choice(vocabulary) for _ in range(30000)), "z", 1, 2.0), (-5, same, "z", 1, 2.0)]


TARGET = [(1, "w1 w2 w3 W4 été"), (2, "w1 w1 w1, x9"), (3, None), (None, "w7 w8")]


def plain(docs, target, most=1, buckets=importance.BUCKETS, least=20, percent=10, seed=2024):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    d = [(i, *features(t)) for i, t, *_ in docs]
    s, t = Counter(b for _, _, f in d for b in f), Counter(b for _, x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, n, f in d:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    drawn = Counter()
    for k, x in enumerate(able[: percent * len(able) // 100]):
        drawn[x, k + 1] += 1
    ranks = {}
    for (x, k), _ in drawn.items():
        ranks.setdefault(x, []).append(k)
    return sorted([(*x, ranks[x].pop(0) if ranks.get(x) else None) for x in out], key=repr)


@pytest.mark.parametrize("most,buckets,least,percent,nodes", [(1, 10000, 20, 10, 1 << 18), (3, 50, 20, 50, 100), (2, 10000, 0, 100, 1 << 18)])
def test_equals_plain_counts(spark, monkeypatch, most, buckets, least, percent, nodes):
    monkeypatch.setattr(importance, "NODES", nodes)
    docs, target = spark.createDataFrame(rows(), SCHEMA).repartition(5), spark.createDataFrame(TARGET, "item_id long, text string")
    got = importance.resample(spark, docs, target, max_words=most, buckets=buckets, min_words=least, percent=percent)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain(rows(), TARGET, most, buckets, least, percent)


def test_crc_states_carry_on():
    trie, w = importance.Trie(), [b"a", b"bc", "é".encode(), b"a", b"bc"]
    paths = list(trie.walk(w, 4))
    assert [len(p) for p in paths] == [5, 4, 3, 2]
    for n, nodes in enumerate(paths, 1):
        assert [trie.crc[i] for i in nodes] == [zlib.crc32(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)]
    assert paths[1][0] == paths[1][3]  # equal runs are one node


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows(), SCHEMA)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    assert importance.resample(spark, none, target).collect() == []
    got = importance.resample(spark, some, target.limit(0)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(rows(), [])


def test_sql_on_odd_rows(spark, tmp_path):
    docs = [r for i, r in enumerate(rows(1)) if r not in rows(1)[:i]]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TARGET, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op13_importance"]).fetchall()
    got = importance.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_gains_of_huge_counts():
    frame = lambda n: type("T", (), {"collect": lambda self: [{"bucket": 0, "n": n}]})()
    assert importance.bucket_gains(frame(10**15), frame(10**3), 2).dtype == np.int64
