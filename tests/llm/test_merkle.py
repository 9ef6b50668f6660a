"""The manifest against one built node by node, with proofs folded by hand."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from rollcast.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path string, g int"


def sha(x):
    return sha256(x.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """Rows of the query, by building every level as a list."""

    def tree(nodes):
        """The root, and for each node the (left, right) of its run at each level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, a in zip(paths, at):
                run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
                p.append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            at = [a // 16 for a in at]
        return nodes[0], paths

    def low(x):
        return x and "".join(c.lower() if "A" <= c <= "Z" else c for c in x)

    out, by = [], {}
    for i, text, lang, source, n, *_ in rows:
        x = leaf(i, source, lang, n, text)
        seen = leaf(i, source, lang, n, low(text)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else x
        by.setdefault(source, []).append((i, x, seen))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        trees[s] = tree([r[1] for r in by[s]])
    root, above = tree([trees[s][0] for s in order])
    for s, rest in zip(order, above):
        for (i, x, seen), own in zip(by[s], trees[s][1]):
            at = seen
            for left, right in own + rest:
                at = sha(left + at + right)
            out.append((i, x, trees[s][0], root, sha("".join(a + b for a, b in own + rest)), at, at == root))
    return sorted(out, key=repr)


def rows(sizes, seed=0, repeats=True):
    rng = random.Random(seed)
    out, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += rng.choice([1, 1, 1, 5, 5000, 1 << 33])
            out.append((rng.choice([k, k, -k]), rng.choice(["Text É", "lower", None, "", "X" * 5000]), rng.choice(["en", None]), s, rng.choice([None, 3]), "x", None, 1))
    if repeats:
        out += out[:3] * 20 + [(None, f"T{i}", None, "b", 0, "", "", 0) for i in range(40)] + [(None, "same", "z", None, 1, "", "", 0)] * 300 + [(7, f"Q{i}", None, "b", 0, "", "", 0) for i in range(20)]
        out += [(2**63 - 1, "A", "", "b", 1, "", "", 0), (-(2**63), "A", "", "b", 1, "", "", 0)]
    rng.shuffle(out)
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def ask(spark, tmp_path):
    def run(data, parts=3):
        spark.createDataFrame(data, SCHEMA).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
        return merkle.query(spark, str(tmp_path))

    return run


def test_equals_levels_built_as_lists(ask):
    data = rows({None: 1, "": 16, "b": 17, "é": 300, "Z": 1, "zz": 257, "long" * 40: 2})
    found = ask(data)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got(found) == plain(data)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 16}, {"a": 17}, {"a": 256}, {"a": 4200}, {f"s{i}": 1 for i in range(300)}])
def test_sizes(ask, sizes):
    data = rows(sizes, repeats=False)
    assert got(ask(data)) == plain(data)


def test_empty(ask):
    assert got(ask([])) == []


def test_sql_on_odd_rows(ask, tmp_path):
    data = rows({None: 3, "": 16, "b": 40, "é": 300, "Z": 1, **{f"s{i}": 1 for i in range(20)}}, 3, repeats=False) + [(None, "N", None, "b", 0, "", "", 0)]
    found = got(ask(data))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(queries.oracle_sql()["op11_merkle"])
    assert [d[0] for d in sql.description] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(sql.fetchall(), key=repr) == found


def test_changed_leaves_are_found(spark):
    data = spark.createDataFrame([(i, f"Text {i}", "s") for i in range(40)], "doc_id long, text string, source string")
    found = merkle.document_manifest(spark, data, F.col("doc_id") == 11, fields=("doc_id", "text"))
    wrong = found.where(merkle.fold(F.col("seen"), F.col("path")) != F.col("root")).select("id").collect()
    assert [r["id"] for r in wrong] == [11]
