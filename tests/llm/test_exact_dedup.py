"""Jaccard join, substring and paragraph dedup, shared components: against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcast.llm import common, jaccard_join, paragraph_dedup, queries, substring_dedup

SCHEMA = "doc_id long, text string, lang string, id long, n long"
ODD = [(1, None, None, 7, 7), (2, "", "x", 7, 7), (3, " \n\t", "x", 7, 7), (4, "one", "x", None, 7), (5, "One", "x", 7, 7), (None, "one", "x", 7, 7), (6, "é" * 30, "x", 7, 7)]


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(8)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        out.append((10 + i, " ".join(w), "en", i, i))
    return out + [(900, " ".join(["again"] * 3000), "en", 1, 1), (901, " ".join(["again"] * 2500), "en", 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD + corpus(), SCHEMA).repartition(3)


def union_find(n):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    return p, find


def test_contract():
    rng = random.Random(4)
    for _ in range(50):
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 60))] + [(i, i + 1) for i in range(100, 100 + rng.randrange(20))]
        got = dict(zip(*(x.tolist() for x in common.contract(*np.array(edges).T))))
        p, find = union_find(200)
        for a, b in edges:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
        assert got == {x: find(x) for e in edges for x in e if find(x) != x}


@pytest.mark.parametrize("links", [500_000, 3])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(common, "LINKS", links)
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in common.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    p, find = union_find(200)
    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    ends = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: find(x) for x in ends}
    assert common.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def brute_jaccard(rows):
    import re

    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(i for i in sets if i is not None)
    p, find = union_find(max(ids) + 1)
    links = dict.fromkeys(ids, 0)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and sets[y] and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                links[x] += 1
                links[y] += 1
                a, b = find(x), find(y)
                p[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


@pytest.mark.parametrize("shard", [4096, 5])
def test_jaccard_join(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(jaccard_join, "SHARD_DOCS", shard)
    rows = [tuple(r) for r in docs.where("doc_id is not null").collect()]
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(spark, docs.where("doc_id is not null")).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_join_of_repeated_rows_and_rows_without_an_id(spark):
    six, near = "a b c d e f g h i j k l m n o p q r s t u v w", "a b c d e f g h i j k l m n o p q r s t u v x"
    rows = [(1, six), (1, six), (2, near), (3, "z y"), (3, "z y"), (4, "z y"), (5, six), (5, "v w x y z"), (6, "v w x y z"), (None, six), (None, six), (7, None), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r)[:1] + tuple(r)[2:] for r in jaccard_join.jaccard_components(spark, d).collect()), key=str)
    want = [(1, 1, 1, 2)] * 2 + [(2, 1, 2, 2)] + [(3, 3, 3, 1)] * 2 + [(4, 3, 3, 1), (5, 1, 1, 2), (5, 5, 5, 1), (6, 5, 5, 1)] + [(7, 7, 7, 0)] * 2 + [(None, None, None, 0)] * 2
    assert got == sorted(want, key=str)


def test_jaccard_join_links_near_copies_once(spark, monkeypatch):
    """What a group of near copies gives to the component rounds: each link once, so few a set,
    whatever the number of lists that they share and the size of the group."""
    seen, find = [], common.components
    monkeypatch.setattr(jaccard_join, "components", lambda s, e, *more: seen.append((e.count(), e.distinct().count())) or find(s, e, *more))
    base = [f"w{i}" for i in range(60)]
    for m in (40, 80, 160):
        rows = [(i, " ".join([*base, f"x{i}"])) for i in range(m)]
        got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert sorted(tuple(r) for r in got) == [(i, 57, 0, i, m - 1) for i in range(m)]
        (n, different), _ = seen[-2:]
        assert n == different <= 3 * m  # which tokens a set looks at depends on the hash


def test_components_split_a_hub(spark):
    """The rows of a node with most of the links are dealt to several tasks."""
    forced = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in forced}
    for k, v in forced.items():
        spark.conf.set(k, v)
    try:
        stash = common.Stash(spark)
        star = stash.put(spark.range(1, 60000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).repartition(8), "star")
        star = star.unionByName(stash.put(spark.range(70000, 71000).select(F.col("id").alias("u"), (F.col("id") + 5000).alias("v")), "pairs"))
        least = stash.put(star.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = common.toward(star, least)
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_merge_skip():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(rng.randint(1, 12))]
        post = [x for one in lists for x in one]
        end = np.cumsum([len(x) for x in lists]).tolist()
        t = rng.randint(1, len(lists))
        want = {x: sum(x in one for one in lists) for x in range(30)}
        assert jaccard_join.merge_skip(post, [0, *end[:-1]], end, t) == ([x for x in want if want[x] >= t], [n for n in want.values() if n >= t])
    assert jaccard_join.set_aside(1, 50) == 0 and 0 < jaccard_join.set_aside(50, 8) <= 49 and jaccard_join.set_aside(100, 10**6) < jaccard_join.set_aside(100, 10)


@pytest.mark.parametrize("probe", [0, 40, 10**9])
@pytest.mark.parametrize("heap", [0, 60, 10**9])
def test_links_within(monkeypatch, probe, heap):
    monkeypatch.setattr(jaccard_join, "PROBE", probe)
    monkeypatch.setattr(jaccard_join, "HEAP", heap)
    rng = random.Random(3)
    for trial in range(60):
        base = [rng.sample(range(200), rng.randint(1, 40)) for _ in range(4)]
        sets = [np.array(sorted({*rng.choice(base), *(rng.randint(0, 300) for _ in range(rng.randint(0, 6)))}), np.uint64) for _ in range(rng.randint(2, 50))]
        n, w = len(sets), np.array([rng.randint(1, 3) for _ in sets])
        side = np.array([i % 2 == 0 for i in range(n)]) if trial % 2 else np.zeros(n, bool)
        forest, links = jaccard_join.links_within(sets, w, side, 75, 100)
        want, (p, find), (q, other) = np.zeros(n, int), union_find(n), union_find(n)
        for i in range(n):
            for j in range(i):
                both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and not (side.any() and side[i] == side[j]):
                    want[i] += w[j]
                    want[j] += w[i]
                    p[find(i)] = find(j)
        assert (links == want).all()
        for a, b in forest:
            assert other(a) != other(b)
            q[other(a)] = other(b)
        assert len({(find(i), other(i)) for i in range(n)}) == len({find(i) for i in range(n)})


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, collapse", [(10**6, True), (0, True), (10**6, False)])
def test_substring_dedup(spark, docs, monkeypatch, hot, collapse):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    found = substring_dedup.remove_repeats(spark, docs, collapse=collapse)
    assert found.count() == docs.count()
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found.where("id is not null").collect()}
    assert got == brute_repeats(rows, 100)
    lone = found.where("id is null").first()
    assert (lone["n_removed"], bytes(lone["kept"])) == (0, b"one")


@pytest.mark.parametrize("collapse", [True, False])
def test_substring_dedup_of_repeated_rows(spark, collapse):
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(1, a), (1, a), (2, b), (2, a[:150] + b[:50]), (3, a[100:300]), (3, a[100:300]), (None, a)]
    got = [(r["id"], bytes(r["kept"]).decode()) for r in substring_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), collapse=collapse).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, a), (2, b), (2, b[:50]), (3, ""), (3, ""), (None, a)], key=str)


def brute_factors(texts, n, cap):
    """Longest previous factors by definition, of the first n + 1 positions of each text."""
    at = [(i, s) for i, (t, m) in enumerate(zip(texts, n)) for s in range(m + 1)]
    out = []
    for k, (i, s) in enumerate(at):
        best = 0
        for j, r in at[:k]:
            m = 0
            while m < cap and texts[i][s + m] == texts[j][r + m]:
                m += 1
            best = max(best, m)
        out.append(best)
    return out


def test_longest_previous_factors():
    rng = random.Random(5)
    for trial in range(60):
        length = rng.choice([8, 9, 16, 20, 31, 40])
        alphabet = b"ab" if trial % 2 else b"\0a\xff"
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(length, 60))) for _ in range(rng.randint(1, 6))]
        texts += [b"a" * (length + 20)] * (trial % 3)
        n = np.array([rng.randint(0, len(t) - length) for t in texts])
        assert substring_dedup.factors(texts, n, length).tolist() == brute_factors(texts, n, length)


def test_paragraph_dedup(spark, docs):
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage = fresh(60)
    near = passage.split()
    near[30] = "changed"
    rows = [(1, fresh(80)), (2, fresh(30) + " " + passage + " " + fresh(40)), (3, fresh(50) + " " + passage.upper().replace("U", "u") + " " + fresh(20)), (4, fresh(40) + " " + " ".join(near)), (5, None), (6, ""), (7, "short text"), (8, "short text"), (None, "short text")]
    got = {r["id"]: r for r in paragraph_dedup.remove_near_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert [i for i, r in got.items() if r["n_removed"]] == [i for i in got if i in (3, 4, 8)]
    for i, t in rows:
        r = got[i]
        b = (t or "").encode()
        gone = b"".join(b[s["from"] : s["to"]] for s in r["spans"])
        assert len(gone) == r["n_removed"] and len(b) - len(gone) == len(r["kept"]) and r["n_bytes"] == len(b)
        if i == 3:
            assert set(gone.decode().split()) <= set(passage.split()) and len(gone.split()) >= 25


def test_bands_are_tuned():
    assert paragraph_dedup.tune(0.75) == (1, 3)
    rows, n = paragraph_dedup.tune(0.75, noise=0.3)  # more rows where unrelated paragraphs collide
    assert rows > 1 and 1 - (1 - 0.75**rows) ** n >= 0.98
    assert paragraph_dedup.tune(1.0)[1] == 1


def near_texts(n, seed=3):
    """Texts of which many share passages, some of their words changed."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    bases = [[word() for _ in range(rng.randint(40, 120))] for _ in range(12)]
    out = []
    for i in range(n):
        w = [x if rng.random() > 0.03 else word() for x in rng.choice(bases)]
        out.append((i, " ".join([word() for _ in range(rng.randint(0, 60))] + w + [word() for _ in range(rng.randint(0, 60))])))
    return out


def similar_paragraphs(rows, k=5):
    """(paragraphs (id, from, to, class, set), pairs of them at 0.75 or more): all compared."""
    doc, cls, lo, hi, sh, offs = paragraph_dedup.paragraphs([(t or "").encode() for _, t in rows], k)
    units = [(rows[d][0], int(a), int(b), int(c), frozenset(sh[x:y].tolist())) for d, a, b, c, x, y in zip(doc, lo, hi, cls, offs[:-1], offs[1:])]
    pairs = [(i, j) for j in range(len(units)) for i in range(j) if units[i][3] == units[j][3] or 100 * len(units[i][4] & units[j][4]) >= 75 * len(units[i][4] | units[j][4])]
    return units, pairs


def test_bands_find_similar_paragraphs():
    rows = near_texts(200)
    doc, cls, lo, hi, sh, offs = paragraph_dedup.paragraphs([t.encode() for _, t in rows], 5)
    r, n = paragraph_dedup.tune(0.75)
    keys = paragraph_dedup.bands(sh, offs, n, r)
    units, pairs = similar_paragraphs(rows)
    pairs = [(i, j) for i, j in pairs if units[i][3] != units[j][3]]
    assert len(pairs) > 300 and np.mean([(keys[i] == keys[j]).any() for i, j in pairs]) >= 0.95


def test_paragraph_dedup_is_brute_force(spark):
    """With bands that miss no pair the result is that of comparing all paragraphs."""
    rows = near_texts(60) + [(70, None), (71, "few words"), (72, "Few words"), (73, "")]
    units, pairs = similar_paragraphs(rows)
    p, find = union_find(len(units))
    for i, j in pairs:
        p[find(j)] = find(i)
    first = {}
    for i in sorted(range(len(units)), key=lambda i: units[i][:2]):
        first.setdefault(find(i), i)
    want = {i: [0, []] for i, _ in rows}
    for i, u in enumerate(units):
        want[u[0]][0] += 1
        if first[find(i)] != i:
            want[u[0]][1].append(u[1:3])
    twice = rows + rows[:5]  # repeated rows change nothing
    got = paragraph_dedup.remove_near_passages(spark, spark.createDataFrame(twice, "doc_id long, text string").repartition(3), recall=1 - 1e-9).collect()
    assert len(got) == len(twice)
    for r in got:
        n, gone = want[r["id"]]
        covered = {x for a, b in gone for x in range(a, b)}
        assert (r["n_passages"], r["n_repeated"], r["n_removed"]) == (n, len(gone), len(covered))
        assert {x for s in r["spans"] for x in range(s["from"], s["to"])} == covered


def test_paragraph_dedup_of_texts_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, a), (1, b), (1, a), (2, b), (None, a)]
    got = sorted((r["id"] or 0, r["n_bytes"], r["n_removed"], r["n_repeated"] == r["n_passages"]) for r in paragraph_dedup.remove_near_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, len(a), 0, False), (1, len(a), 0, False), (1, len(b), 0, False), (2, len(b), len(b), True), (0, len(a), 0, True)])


@pytest.mark.parametrize("run", [jaccard_join.jaccard_components, substring_dedup.remove_repeats, paragraph_dedup.remove_near_passages])
def test_empty_tables_and_repeated_rows(spark, run):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert run(spark, d).count() == 2
    assert run(spark, d.where("doc_id > 5")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    order = sorted(range(len(names)), key=lambda i: want.description[i][0])
    data = sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == names
    assert sorted(tuple(str(r[c]) for c in names) for r in got.select(*[F.col(c) for c in names]).collect()) == data


def test_words_that_are_built_alike_are_not_linked(spark):
    """A Thue-Morse word and its complement, alone and in sentences."""
    for n in (1024, 4096):
        w, v = "a", "b"
        while len(w) < n:
            w, v = w + v, v + w
        rest = " ".join(f"r{i}" for i in range(30))
        rows = [(1, w), (2, v), (3, f"{w} {rest}"), (4, f"{v} {rest}"), (5, " ".join([w, v] * 5)), (6, " ".join([v, w] * 5))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark, df).collect()}
        assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}  # 3 and 4 share 25 of 27 shingles
        kept = {r["id"]: r["n_removed"] for r in paragraph_dedup.remove_near_passages(spark, df.where("doc_id < 3")).collect()}
        assert kept == {1: 0, 2: 0}
