"""Training on ids of any kind, and a phrase that very many documents and items share."""

import random

import pytest
from pyspark.sql import functions as F

from rollcast.llm import decontaminate, lang_id, toxicity
from rollcast.llm import textnp as X

WORDS = {"en": "the house is on a hill and we walk there".split(), "de": "das Haus steht auf dem Berg und wir gehen".split()}


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_ids_of_any_kind_are_learned_from(spark, kind):
    rng = random.Random(0)
    rows = [(None if i % 10 == 0 else float(i) if kind == "double" else f"doc-{i}" if kind == "string" else i, " ".join(rng.choice(WORDS[lang]) for _ in range(40)) + (" vile" if i % 3 == 0 else ""), lang, int(i % 3 == 0)) for i in range(200) for lang in ["en" if i % 2 else "de"]]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, toxic int").repartition(3)
    model = lang_id.train(spark, docs, F.lit(True))
    assert model.classes == ["de", "en"]
    got = lang_id.identify(docs, model).collect()
    assert len(got) == 200 and {r["lang_pred"] for r in got} <= {"de", "en"}
    fm = toxicity.train(spark, docs.drop("toxic"), docs.select("doc_id", "toxic"), F.lit(True))
    assert toxicity.score(docs, fm).count() == 200
    none = docs.where("doc_id is null")
    assert lang_id.train(spark, none, F.lit(True)) is None
    assert toxicity.train(spark, none, none.select("doc_id", "toxic"), F.lit(True)) is None


def shared_phrase(n_docs, n_items, seed=0):
    rng = random.Random(seed)
    phrase = "one two three four five"
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    docs = [(i, f"{fresh(rng.randint(3, 9))} {phrase} {fresh(4)}") for i in range(n_docs)]
    items = [(i, f"{fresh(3)} {phrase} {fresh(5 + i % 4)}") for i in range(n_items)]
    docs += [(10**6 + j, f"{fresh(4)} {items[j][1]} {fresh(2)}") for j in (0, 1, n_items - 1)]
    docs += [(10**6 + 10, f"{phrase} {phrase}"), (10**6 + 11, phrase)]
    items += [(10**6, f"{phrase} x {phrase} y {phrase}"), (10**6 + 1, phrase), (10**6 + 2, "two three")]
    return docs, items


def test_a_common_phrase_is_looked_at_once(spark, monkeypatch):
    rows, put = {}, decontaminate.Stash.put

    def seen(self, df, name):
        out = put(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate.Stash, "put", seen)
    docs, items = shared_phrase(400, 200)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["coverage"], r["item_id"], r["n_items"]) for r in decontaminate.decontaminate(spark, d, b).collect()}
    assert rows["pairs"] < 10 * 210  # a class that 400 documents share, and few others
    word = lambda t: X.word_hashes([t.encode()])[0]
    b = [(i, word(t)) for i, t in items]
    for i, t in [*docs[:3], *docs[-5:]]:
        w = word(t)
        all_ = [(decontaminate.tile(x, w, min(5, len(x))) / len(x), -k) for k, x in b]
        top = max(all_)
        assert got[i] == (top[0], -top[1], sum(c >= 0.5 for c, _ in all_)), i


def test_reduced_texts_keep_what_can_match():
    rng = random.Random(3)
    for _ in range(60):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 4, 30]))]
        text = lambda n: [rng.choice(vocabulary) for _ in range(n)]  # noqa: E731, B023
        docs, item = [text(rng.randint(0, 40)) for _ in range(4)], text(rng.randint(1, 20))
        h, doc, *_ = X.word_hashes([" ".join(x).encode() for x in docs])
        k = min(3, len(item))
        w = X.word_hashes([" ".join(item).encode()])[0]
        s, at = decontaminate.runs(h, doc, k)
        hit = [x in set(decontaminate.runs(w, doc[:0].repeat(0) if not len(w) else w.astype("int64") * 0, k)[0].tolist()) for x in s.tolist()]
        at = at[hit] if len(at) else at
        near = h != h
        for i in at.tolist():
            near[i : i + k] = True
        out = decontaminate.reduced(list(range(4)), h, doc, near, at, s[hit] if len(s) else s)
        found = {r[0]: r[2].view("uint64") for r in out}
        for i, x in enumerate(docs):
            full = decontaminate.tile(w, X.word_hashes([" ".join(x).encode()])[0], k)
            assert full == (decontaminate.tile(w, found[i], k) if i in found else 0)
