"""Classifiers, token counts, decontamination, mixing, sharding, embeddings, the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcast.llm import decontaminate, embedding_dedup, lang_id, mixing, queries, ranks, sharding, token_count, toxicity

BIG = 2**60 + 1


def odd(spark):
    """Null, empty, letterless and long texts; a large id beside a null one; clashing columns."""
    rows = [(None, "hello there", "z", 1.5), (BIG, None, "z", None), (2, "", "z", 1.0), (2, "", "z", 1.0), (4, "123 !?", "z", 1.0), (5, "the word " * 20000, "z", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, coverage double")


def labelled(spark, n=400, seed=0):
    rng = random.Random(seed)
    speak = {"en": ["the", "and", "thing", "with", "over"], "fr": ["être", "çela", "eau", "où", "été"], "de": ["über", "schön", "nicht", "straße", "zwei"]}
    groups, insults = [f"group{i}" for i in range(5)], [f"slur{i}" for i in range(5)]
    out = []
    for i in range(n):
        lang = rng.choice(list(speak))
        w = [rng.choice(speak[lang]) for _ in range(rng.randint(10, 80))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w[3:3] = ([rng.choice(insults)] if a else []) + ([rng.choice(groups)] if b else [])
        out.append((i, " ".join(w), lang, int(a and b)))
    return spark.createDataFrame(out, "doc_id long, text string, lang string, toxic int").repartition(3)


def test_language_accuracy_and_odd_texts(spark):
    d = labelled(spark)
    model = lang_id.train(spark, d, ~lang_id.held_out("doc_id", 5, 0))
    got = lang_id.identify(d, model).where(lang_id.held_out("doc_id", 5, 0)).collect()
    assert len(got) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    r = lang_id.identify(odd(spark), model)
    rows = {x["doc_id"]: x for x in r.collect()}
    assert r.count() == 6 and r.columns == ["doc_id", "text", "coverage", "lang_pred", "score"]
    assert [rows[i]["lang_pred"] for i in (BIG, 2, 4)] == ["und"] * 3 and rows[5]["lang_pred"] == "en" and rows[None]["coverage"] == 1.5
    assert all(0 <= x["score"] <= 1 for x in rows.values())
    assert {x["lang_pred"] for x in lang_id.identify(odd(spark), None).collect()} == {"und"}
    assert lang_id.train(spark, d.where("doc_id < 0"), F.lit(True)) is None
    assert lang_id.identify(odd(spark).where("doc_id < 0"), model).count() == 0


def test_language_gradient():
    model = lang_id.ByteCNN(["a", "b"])
    for k in model.w:
        model.w[k] = model.w[k].astype(float)
    rng = np.random.default_rng(0)
    x, y, weight = rng.integers(97, 103, (6, 40)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0]), np.ones(6)

    def loss():
        feats = []
        emb = model.w["e"][x]
        for k in lang_id.WIDTHS:
            feats.append(sum(emb[:, j : 40 - k + 1 + j] @ model.w[f"f{k}"][j] for j in range(k)).max(1) + model.w[f"b{k}"])
        z = np.maximum(np.concatenate(feats, 1), 0) @ model.w["o"] + model.w["c"]
        return -(z[np.arange(6), y] - np.log(np.exp(z).sum(1))).mean()

    grad = model._grad(x, y, weight)
    for k in ("e", "f4", "b2", "o"):
        at = tuple(rng.integers(0, s) for s in model.w[k].shape) if k != "e" else (99, 3)
        keep, eps = model.w[k][at], 1e-6
        model.w[k][at] = keep + eps
        up = loss()
        model.w[k][at] = keep - eps
        down = loss()
        model.w[k][at] = keep
        assert grad[k][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_folded_tables_are_the_convolution():
    model = lang_id.ByteCNN(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (5, lang_id.WINDOW)).astype(np.uint8)
    emb, feats = model.w["e"][x], []
    for k in lang_id.WIDTHS:
        feats.append(sum(emb[:, j : lang_id.WINDOW - k + 1 + j] @ model.w[f"f{k}"][j] for j in range(k)).max(1) + model.w[f"b{k}"])
    z = np.maximum(np.concatenate(feats, 1), 0) @ model.w["o"] + model.w["c"]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(model.probabilities(x, model.fold()), p, atol=1e-5)


def test_windows_cover_texts():
    texts = [b"", b"a" * lang_id.WINDOW, b"b" * (2 * lang_id.WINDOW + 3)]
    w, doc, size = lang_id.windows(texts)
    assert doc.tolist() == [1, 2, 2, 2] and size.tolist() == [256, 256, 256, 3] and w[3, 3] == 0


def test_toxicity_learns_pairs(spark):
    d = labelled(spark, 1500)
    fm = toxicity.train(spark, d, d.select("doc_id", "toxic"), ~lang_id.held_out("doc_id", 3, 1))
    got = toxicity.score(d, fm).where(lang_id.held_out("doc_id", 3, 1)).collect()
    right = np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in got])
    assert right >= 0.95  # no additive model separates "both" from "either"
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    r = toxicity.score(odd(spark), fm).collect()
    assert len(r) == 6 and all(0 <= x["score"] <= 1 for x in r) and r[0]["coverage"] == 1.5
    assert toxicity.train(spark, d, d.select("doc_id", F.lit(0).alias("toxic")), F.lit(True)) is None
    assert {x["score"] for x in toxicity.score(odd(spark), None).collect()} == {0.0}


def test_fm_logits_are_pairwise_sums():
    rng = np.random.default_rng(2)
    fm = toxicity.FactorizationMachine(np.arange(6))
    fm.w0, fm.w, fm.v = 0.3, rng.normal(size=6), rng.normal(size=(6, toxicity.FACTORS))
    sets = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    want = [0.3 + sum(fm.w[i] for i in s) + sum(fm.v[i] @ fm.v[j] for i in s for j in s if i < j) for s in sets]
    got = fm.logits(np.array([i for s in sets for i in s]), np.array([d for d, s in enumerate(sets) for _ in s]), 4)
    assert np.allclose(got, want)


def library(pieces, unknown, bytes_):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("<unk>", unknown)] + pieces + ([(f"<0x{i:02X}>", unknown) for i in range(256)] if bytes_ else [])
    t = Tokenizer(models.Unigram(vocabulary, 0, bytes_))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return t


def test_token_counts_of_two_vocabularies():
    """Words that were counted with one vocabulary are not taken for another."""
    rest = [("▁", -1.0), *((f"q{i}z", -3.0) for i in range(62))]
    one, two = token_count.UnigramCounter([("▁ab", -2.0), *rest], False), token_count.UnigramCounter([("▁zz", -2.0), *rest], False)
    assert one.by_word and two.by_word
    assert [c.count("ab ab")[0] for c in (one, two, one)] == [2, 4, 2]


@pytest.mark.parametrize("bytes_", [False, True])
@pytest.mark.parametrize("scores", [(-1.0, -2.0, -3.0), (-1.0, -2.5, -3.25, -0.1)])
def test_token_counts_are_the_library_s(bytes_, scores):
    rng = random.Random(1)
    for trial in range(20):
        pieces = list({"".join(rng.choice("abc▁é") for _ in range(rng.randint(1, 4))): rng.choice(scores) for _ in range(40)}.items())
        if trial % 2:
            pieces = [("▁", -1.0)] + [(p, s) for p, s in pieces if "▁" not in p[1:] and p != "▁"]
        counter = token_count.UnigramCounter(pieces, bytes_)
        t = library(pieces, min(s for _, s in pieces), bytes_)
        for _ in range(60):
            x = "".join(rng.choice("abcéx日 ") for _ in range(rng.randint(1, 40)))
            assert counter.count(x)[0] == len(t.encode(x, add_special_tokens=False).ids), (x, pieces)


def test_token_counts_of_the_vocabulary_file(spark, sf):
    import os

    if not os.path.exists(token_count.MODEL):
        pytest.skip("no vocabulary file")
    c = token_count.load(token_count.MODEL)
    assert c.by_word
    t = library(c.pieces, c.unknown + 10, True)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["", "  a  b", "▁x", "\n日本語😀", "a" * 500]
    assert [c.count(x)[0] for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    r = {x["doc_id"]: x["n_tokens"] for x in token_count.token_counts(odd(spark), c).collect()}
    assert (r[BIG], r[2]) == (0, 0) and r[5] == len(t.encode("the word " * 20000).ids)


def brute_tile(item, doc, k):
    """Greedy string tiling by definition."""
    a, b, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return covered
        for x in range(n):
            a[i + x] = b[j + x] = True
        covered += n


def hashes(words):
    return decontaminate.X.word_hashes([" ".join(words).encode()])[0]


def test_greedy_string_tiling():
    rng = random.Random(4)
    for trial in range(150):
        n = 2 if trial % 3 == 0 else 6
        item, doc = [f"v{rng.randrange(n)}" for _ in range(rng.randint(3, 20))], [f"v{rng.randrange(n)}" for _ in range(rng.randint(0, 40))]
        assert decontaminate.tile(hashes(item), hashes(doc), 3) == brute_tile(item, doc, 3)
    for a, b in ((5, 17), (17, 5), (12, 12)):
        assert decontaminate.tile(hashes(["w"] * a), hashes(["w"] * b), 3) == brute_tile(["w"] * a, ["w"] * b, 3)


def test_tiling_of_repeated_words_is_quick():
    import time

    took = []
    for n in (2000, 16000):
        start = time.monotonic()
        assert decontaminate.tile(hashes(["w"] * n), hashes(["w"] * (10 * n) + ["x"]), 5) == n
        took.append(time.monotonic() - start)
    assert took[1] < 8 * 8 * max(took[0], 0.02)  # far from the square


def test_decontamination(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    items = [fresh(40), fresh(30), fresh(3), []]
    parts = [items[0][20:30], fresh(5), items[0][:20], fresh(9), items[0][30:]]
    rows = [(1, " ".join(fresh(50) + items[1] + fresh(9)), 1.5, 3), (2, " ".join(sum(parts, [])).upper().replace("U", "u"), 1.5, 3), (3, " ".join(fresh(40) + items[0][:8]), 1.5, 3), (4, None, 1.5, 3), (5, "", 1.5, 3), (BIG, " ".join(fresh(4) + items[2]), 1.5, 3), (None, " ".join(items[1]), 1.5, 3)]
    rows += rows[:1]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, coverage double, item_id int, __h string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] * 2 + [(8, None), (None, "x")], "item_id long, text string")
    out = decontaminate.decontaminate(spark, docs, bench)
    assert out.columns == ["doc_id", "text", "__h", "coverage", "item_id", "n_items", "contaminated"]
    got = out.collect()
    assert len(got) == len(rows) and {r["__h"] for r in got} == {"mine"} and {r["n_items"] for r in got} == {0, 1}
    got = {r["doc_id"]: (r["item_id"], r["contaminated"], round(r["coverage"], 2)) for r in got}
    assert got == {1: (1, True, 1.0), 2: (0, True, 1.0), 3: (0, False, 0.2), 4: (None, False, 0), 5: (None, False, 0), BIG: (2, True, 1.0), None: (1, True, 1.0)}
    assert decontaminate.decontaminate(spark, docs, bench.where("item_id > 99")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(spark, docs.where("doc_id < 0"), bench).count() == 0


def test_decontamination_is_tiling_of_all_pairs(spark, sf):
    """Against all pairs of documents and items, without seeds and bitmap."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r["doc_id"]: hashes((r["text"] or "").split(" ")) for r in docs.collect()}
    items = [(r["item_id"], hashes(r["text"].split(" "))) for r in bench.collect() if r["text"]]
    got = {r["doc_id"]: (r["coverage"], r["item_id"], r["n_items"]) for r in decontaminate.decontaminate(spark, docs, bench).collect()}
    for i, w in texts.items():
        all_ = [(decontaminate.tile(x, w, min(5, len(x))) / len(x), -k) for k, x in items if len(x)]
        best = max(all_, default=(0, 0))
        assert got[i] == (best[0], -best[1] if best[0] else None, sum(c >= 0.5 for c, _ in all_))


def deviation(order, weights):
    """The largest distance of any source from its share, in blocks, over all slots."""
    from fractions import Fraction

    total = sum(map(mixing.as_written, weights.values()))
    t, out = np.arange(1, len(order) + 1), 0.0
    for s, w in weights.items():
        share = Fraction(mixing.as_written(w), 1) / total
        exact = t * share.numerator  # in parts of the denominator, whole numbers
        out = max(out, np.abs(np.cumsum(np.array(order) == s) * share.denominator - exact).max() / share.denominator)
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 0.9, "b": 0.05, "c": 0.05}, {"a": 1, "b": 1, "c": 1}, {"a": 0.0004, "b": 0.3333, "c": 0.6663}, {str(i): i + 1 for i in range(30)}])
def test_pfair_deviation_is_below_one_block(weights):
    import itertools

    n = 300_000
    have = dict.fromkeys(weights, n)
    order = [s for s, _, _ in itertools.islice(mixing.serve(have, {s: mixing.as_written(w) for s, w in weights.items()}, 1.0), n)]
    assert deviation(order, weights) < 1


def laid_out(have, out):
    """(source, block, slot) of the phases' plan."""
    rows = []
    for p in out:
        for s, a in p["parts"].items():
            n = p["length"] // p["period"] * a + sum(x < p["length"] % p["period"] for x in p["slots"][s])
            rows += [(s, p["first"][s] + k, p["slot"] + k // a * p["period"] + p["slots"][s][k % a]) for k in range(n)]
    return sorted(rows, key=lambda r: r[2])


def test_phases_and_server_are_the_same_order():
    rng = random.Random(3)
    for trial in range(40):
        have = {f"s{i}": rng.choice([0, 1, 5, 40, 300]) for i in range(rng.randint(1, 8))}
        target = mixing.targets(have, {s: rng.choice([1, 3, 0.25, 0.1]) for s in list(have)[: rng.randint(1, 8)]}, 0.7, 100)
        stop = rng.choice([1.0, 0.5, 0.0])
        served = list(mixing.serve(have, target, stop))
        assert served == laid_out(have, mixing.phases(have, target, stop)) and [t for *_, t in served] == list(range(len(served)))
        if stop == 1:
            assert len(served) == sum(n for s, n in have.items() if s in target)
        # each phase, in which weights are constant, keeps within one block of its targets
        start, left = 0, {s: n for s, n in have.items() if n and s in target}
        for p in mixing.phases(have, target, stop):
            order = [s for s, _, t in served if p["slot"] <= t < p["slot"] + p["length"]]
            assert not order or deviation(order, {s: target[s] for s in p["parts"]}) < 1
    assert mixing.phases({"a": 10**9, "b": 10**9}, {"a": 10**9 + 7, "b": 10**9 + 9}, 1.0) is None


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", None]), 7) for i in range(3000)] + [(7000, "tiny", 7), (None, "a", 7), (5, "b", 7), (5, "b", 7)]
    d = spark.createDataFrame(rows, "doc_id long, source string, __k long").repartition(3)
    got = mixing.mix(spark, d, {"a": 1, "b": 1, "c": 1}, block=4)
    assert got.count() == len(rows) and got.where("__k = 7").count() == len(rows)
    mixed = got.where("in_mix").toPandas()
    assert set(mixed["source"].dropna()) == {"a", "b", "c"} and mixed["source"].notna().all()
    assert mixed["mix_position"].is_unique
    slots = mixed.groupby("mix_slot")["source"].agg(["first", "nunique"]).sort_index()
    assert (slots["nunique"] == 1).all() and (slots.index == range(len(slots))).all()
    head = slots["first"].tolist()[: 3 * (slots["first"] == "c").sum() - 3]
    assert deviation(head, {"a": 1, "b": 1, "c": 1}) < 1
    for plan in (mixing.PLAN, 0):  # by the plan of phases and by the server
        same = mixing.mix(spark, d.repartition(5), {"a": 1, "b": 1, "c": 1}, block=4, plan=plan).where("in_mix").toPandas()
        assert dict(zip(same["mix_position"], same["source"])) == dict(zip(mixed["mix_position"], mixed["source"]))
    clash = mixing.mix(spark, d.withColumnRenamed("__k", "mix_rank"))
    assert clash.columns == ["doc_id", "source", "mix_rank", "mix_slot", "mix_position", "in_mix"] and clash.where("mix_rank is null or not in_mix").count() == 0
    assert mixing.mix(spark, d.where("doc_id < 0")).count() == 0


def test_mixing_of_many_sources(spark):
    """More sources than the driver schedules: every row is served, in the order of one heap."""
    rows = [(i, f"s{i % 2500}") for i in range(6000)]
    got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, source string"), block=1).toPandas()
    assert sorted(got["mix_slot"]) == list(range(6000)) and got["in_mix"].all()
    have = got.groupby("source").size().to_dict()
    want = {(s, k): t for s, k, t in mixing.serve(have, mixing.targets(have, None, mixing.TEMPER, mixing.PERIOD), 1.0)}
    assert {(s, k): t for s, k, t in zip(got["source"], got["mix_rank"], got["mix_slot"])} == want


def test_ranks(spark):
    d = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(500)], "g long, i long")
    got = ranks.ranked(d, ["g"], ranks.hash63("i"), ["i"], cells=16).toPandas()
    for _, x in got.groupby("g", dropna=False):
        assert sorted(x["rank"]) == list(range(len(x)))


def brute_place(keys, nodes, bounds):
    """Keys in ring order, one by one: own shard first, then the overflow clockwise."""
    room, at, over = list(bounds), {}, []
    arcs = {}
    for point, k in sorted(keys):
        arc = next((i for i, (p, _) in enumerate(nodes) if p >= point), 0)
        arcs.setdefault(arc, []).append(k)
    for arc, (_, s) in enumerate(nodes):
        for k in arcs.get(arc, []):
            if room[s]:
                room[s] -= 1
                at[k] = s
            else:
                over.append((arc, k))
    for lap in range(2):
        for arc, (_, s) in enumerate(nodes):
            ready = [x for x in over if x[1] not in at and (lap or x[0] < arc)]
            for _, k in ready[: room[s]]:
                room[s] -= 1
                at[k] = s
    return at


def test_sharding(spark):
    rows = [(i, "é" * (i % 5)) for i in range(1003)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(spark, d).toPandas()
    assert len(got) == 1003 and got["shard"].value_counts().agg(lambda s: s.max() - s.min()) <= 1
    for _, x in got.groupby("shard"):
        assert sorted(x["slot"]) == list(range(len(x)))
    for r in got.itertuples():
        t = ("é" * (r.doc_id % 5)).encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 1, zlib.crc32(t), "rows")
    points = {r["doc_id"]: r["p"] for r in d.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("p")).collect()}
    want = brute_place([(p, k) for k, p in points.items()], sharding.ring(16), [1003 // 16 + (s < 1003 % 16) for s in range(16)])
    assert dict(zip(got["doc_id"], got["shard"])) == want
    # a row more moves few others
    more = sharding.shard_documents(spark, d.unionByName(spark.createDataFrame([(5000, "x")], "doc_id long, text string"))).toPandas()
    both = got.merge(more, on="doc_id")
    assert (both["shard_x"] != both["shard_y"]).mean() < 0.05


def test_sharding_keeps_columns_and_deals_rows_without_a_key(spark):
    d = spark.createDataFrame([(None, i, "x") for i in range(400)] + [(7, 7, "x")] * 3, "k long, shard long, __arc string")
    got = sharding.shard(spark, d, "k", 8, order=("shard",)).toPandas()
    assert list(got.columns) == ["k", "__arc", "shard", "slot"] and set(got["__arc"]) == {"x"}
    assert sorted(got.groupby("shard").size()) == [50] * 5 + [51] * 3 and not got.duplicated(["shard", "slot"]).any()
    arcs = {tuple(r) for r in d.where("k is null").select(F.shiftrightunsigned(F.xxhash64("k", "shard"), 54)).collect()}
    assert len(arcs) > 200  # not one place of the ring


def test_sharding_equals_sql(spark):
    """Rows without an id, negative and large ids, repeated rows and null texts; many rows of one
    id overflow their shard."""
    rows = [(None, "n" * (i % 9)) for i in range(60)] + [(i * 7919 - 2_000_000, "é" * (i % 5)) for i in range(700)] + [(7, None)] * 300 + [(BIG, "x"), (-BIG, "")]
    got = sharding.shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(queries.oracle_sql()["op10_sharding"]).fetchall(), key=repr)


def test_sharding_odd_rows(spark):
    r = sharding.shard_documents(spark, odd(spark)).collect()
    assert len(r) == 6 and {x["shard"] for x in r} == set(range(6)) and {x["size"] for x in r if x["doc_id"] == BIG} == {1}
    assert sharding.shard_documents(spark, odd(spark).where("doc_id < 0")).count() == 0


def vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(60):
        v = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (v + rng.normal(size=24) * 0.11 * rng.random()).astype(np.float32).tolist(), int(c % 3)))
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 24, 0), (n + 5, [float("nan")] * 24, 0), (n + 6, rows[0][1][:-1] + [None], 0), (n + 7, [], 0), (n + 8, rows[0][1][:12], 0), (n + 9, rows[0][1][:12], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("shard", [2048, 3])
def test_embeddings(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    rows, d = vectors(spark)
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(spark, d).collect()}
    fine = {i: (np.array(v, float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    p = {i: i for i, *_ in rows}

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    links = dict.fromkeys(p, 0)
    for i, (a, x) in fine.items():
        for j, (b, y) in fine.items():
            if i < j and x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((find(i), find(j)))
                p[hi] = lo
    assert len(got) == len(rows) and sum(links.values()) > 100
    assert all(got[i]["n_links"] <= n for i, n in links.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(links.values())
    assert np.mean([got[i]["component_id"] == find(i) for i in p]) >= 0.98
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.near_duplicates(spark, d.where("vec_id < 0")).count() == 0


def test_embeddings_of_repeated_rows_and_extreme_numbers(spark):
    a, b, c = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [3.0, -1.0, 0.5]
    big, tiny = [x * 1e200 for x in a], [x * 1e-200 for x in b]
    rows = [(1, a, 0, "u"), (1, a, 0, "v"), (2, a, 0, "u"), (3, b, 0, "u"), (3, b, 0, "u"), (4, c, 0, "u"), (4, c, 0, "u"), (5, big, 0, "u"), (6, tiny, 0, "u"), (7, a, 1, "u"), (None, a, 0, "u"), (8, a, 0, "u"), (8, c, 0, "u"), (9, None, 0, "u"), (9, None, 0, "u")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h string").repartition(3)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(spark, d).collect()), key=str)
    near = lambda i: (i, 5, 1, i == 1)
    want = [near(i) for i in (1, 1, 2, 3, 3, 5, 6, 8)] + [(4, 1, 4, True)] * 2 + [(7, 0, 7, True), (8, 1, 4, False), (9, 0, 9, True), (9, 0, 9, True), (None, 0, None, None)]
    assert got == sorted(want, key=str)


def test_embeddings_equal_sql(spark, tmp_path):
    """The SQL of the query, on a table with links."""
    _, d = vectors(spark, 4)
    d.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op6_embedding_dedup"]).fetchall())
    got = sorted(tuple(r) for r in queries.queries()["op6_embedding_dedup"](spark, str(tmp_path)).collect())
    assert sum(r[1] for r in want) > 100 and np.mean([x == y for x, y in zip(got, want)]) >= 0.98


def test_key_plan():
    assert embedding_dedup.key_plan(1, 0.98)[0] == 6
    small, large = embedding_dedup.key_plan(10**5, 0.98), embedding_dedup.key_plan(10**10, 0.98)
    assert small[0] < large[0] and small[1] < large[1]


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(8)
    mine = {"score": F.col("doc_id") * 0.5, "coverage": F.lit(2.5), "item_id": F.lit("mine"), "mix_rank": F.col("doc_id"), "__col0": F.lit("x"), "in_mix": F.lit(False), "id": F.lit(1)}
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    docs = plain.withColumns(mine)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.orderBy(F.length("text").desc()).first()["text"]
    long = docs.where("n_chars > 2000").orderBy("doc_id").first()
    extra = [(90001, None, None, None, 0), (90002, "123 456", "en", "src1", 7), (90003, long["text"], long["lang"], "src2", 1), (90004, "Fresh words " + " ".join(f"zz{rng.randrange(10**6)}" for _ in range(50)) + " " + item, "en", "src3", 1), (None, "a text without an id but with words", "en", "src1", 3)]
    plain.unionByName(spark.createDataFrame(extra, plain.schema)).withColumns(mine).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(C.STAGES) <= 5
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, frame, str(tmp_path))
        assert after.columns == docs.columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        assert spark.read.parquet(path).exceptAll(frame).count() == 0  # rows go, values stay
        before, frame = {r["doc_id"] for r in frame.collect()}, spark.read.parquet(path)
        seen.append(before - {r["doc_id"] for r in frame.collect()})
    assert {90001, 90002} <= seen[0] and 90003 in seen[1] and 90004 in seen[2]
    bare = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in bare.collect()} - {r["doc_id"] for r in C.language_id(spark, bare, str(tmp_path)).collect()} == {90001, 90002}
    out = C.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in frame.collect()} and len(out) == frame.count()


def test_pipeline_serves_its_shards_in_the_order_of_the_mix(spark, tmp_path):
    import corpus_pipeline as C

    def serve(rows):
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        for name, stage in C.STAGES[3:]:  # what follows decontamination
            stage(spark, frame, str(tmp_path)).write.mode("overwrite").parquet(str(tmp_path / name))
            frame = spark.read.parquet(str(tmp_path / name))
        return frame.collect()

    large, small = 600, 60
    rows = [(i, f"text {i}", "large" if i < large else "small") for i in range(large + small)]
    one, got = serve([(i, t, "one") for i, t, _ in rows]), serve(rows)
    assert {(r["doc_id"], r["shard"]) for r in one} == {(r["doc_id"], r["shard"]) for r in got}
    assert {(r["doc_id"], r["slot"]) for r in one} != {(r["doc_id"], r["slot"]) for r in got}
    for s in range(16):
        at = sorted((r["slot"], r["mix_position"]) for r in got if r["shard"] == s)
        assert [x for x, _ in at] == list(range(len(at))) and [p for _, p in at] == sorted(p for _, p in at)
        assert len(at) in (41, 42)
    parts, period = mixing.integer_weights({"large": large**mixing.TEMPER, "small": small**mixing.TEMPER})
    order = [r["doc_id"] >= large for r in sorted(got, key=lambda r: r["mix_position"])]
    for blocks in range(1, 40):  # before the small source runs out
        assert abs(sum(order[: 8 * blocks]) / 8 - blocks * parts["small"] / period) < 1
    odd_rows = [(1, "a", None), (1, "a", None), (1, "b", "x"), (None, "a", "x"), (None, "a", "x"), (None, None, None), (2, None, "y")]
    assert sorted(((r["doc_id"], r["size"]) for r in serve(odd_rows)), key=str) == sorted(((i, len(t or "") + 1) for i, t, _ in odd_rows), key=str)
    again = lambda x: sorted((r["doc_id"] or -1, r["text_crc32"], r["shard"], r["slot"], r["mix_position"]) for r in x)
    assert again(serve(odd_rows)) == again(serve(odd_rows[::-1])) and serve([]) == []
