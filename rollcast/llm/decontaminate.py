"""Benchmark decontamination by greedy string tiling.

1. Seeds: every MIN_MATCH adjacent words of a benchmark item, or the whole of a shorter one,
   as a table. A bitmap of 2^BITS bits, whatever the benchmark's size, tells each task
   which words of its documents can be seeds at all; only those are joined with the
   table, so nothing that grows with the benchmark is broadcast or held by a task.
   A document is reduced to the words under such seeds, and documents with the same ones are
   one class, so a phrase in very many documents is looked at once.
2. A class and an item that share a seed are tiled (`tile`): the longest common run of
   unmarked words is marked in both, again and again, until no run of MIN_MATCH words is
   left. The share of the item that the tiles cover does not depend on their order, so
   passages that were cut up and reordered are found.

A class takes its items by the share of their words that lie under shared seeds, the most that
tiles can cover, and ends where no item can cover more than the best one or reach the
threshold. Common runs come from running Karp-Rabin hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp as X
from .common import Stash, aside, back, tune

MIN_MATCH = 5
COVERAGE = 0.5
BITS = 24
PARTS = 16  # of a class's items
GAP = np.uint64(0)


def _spans(prefix: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of the n words behind each position."""
    return X.span_hash61(prefix, at, at + n)


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Positions with n unmarked words from there on."""
    marks = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(marks[n:] == marks[:-n]) if len(marked) >= n else np.zeros(0, np.int64)


def tile(item: np.ndarray, doc: np.ndarray, k: int) -> int:
    """Words of `item` that greedy tiling against `doc` covers, with runs of k words or more;
    both are word hashes.

    The longest length at which a run is common is found by bisection (a common run holds
    shorter ones); at this length runs are marked from left to right, each with the first
    place in the document that is still free. Lengths descend, each marks at least as
    many words of the item, so there are few, and repeated words cost no more than others."""
    pi, pd_ = X.prefix_hash61(item), X.prefix_hash61(doc)
    # the document's words outside of common runs of k words match nothing
    at = np.arange(max(0, len(doc) - k + 1))
    hit = np.isin(_spans(pd_, at, k), _spans(pi, np.arange(max(0, len(item) - k + 1)), k))
    if not hit.any():
        return 0
    near = np.zeros(len(doc) + 1, np.int64)
    np.add.at(near, at[hit], 1)
    np.add.at(near, at[hit] + k, -1)
    near = np.cumsum(near[:-1]) > 0
    gap = np.concatenate([[False], near[1:] & ~near[:-1]])  # runs that were apart stay apart
    place = np.flatnonzero(near)
    place = place + np.cumsum(gap)[place]
    used = np.zeros(int(place[-1]) + 1, bool)
    used[place] = True
    small = np.zeros(len(used), np.uint64)
    small[place] = doc[near]
    used = used[place[0] :]
    doc, pd_ = small[place[0] :], X.prefix_hash61(small[place[0] :])
    in_item, in_doc, covered = np.zeros(len(item), bool), ~used, 0
    most = min(len(item), len(doc))
    while True:
        low, high = k - 1, most  # common runs of `low` words there are, of more than `high` none
        while low < high:
            n = (low + high + 1) // 2
            a, b = _free(in_item, n), _free(in_doc, n)
            if len(a) and len(b) and np.isin(_spans(pi, a, n), _spans(pd_, b, n)).any():
                low = n
            else:
                high = n - 1
        if low < k:
            return covered
        n = most = low
        a, b = _free(in_item, n), _free(in_doc, n)
        ha, hb = _spans(pi, a, n), _spans(pd_, b, n)
        order = np.argsort(hb, kind="stable")
        b, hb = b[order], hb[order]
        lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
        some = hi > lo
        end, next_ = 0, {}  # the first place of each run that may still be free
        for x, i, j in zip(a[some].tolist(), lo[some].tolist(), hi[some].tolist()):
            if x < end:
                continue  # it meets the tile before it
            y = next_.get(i, i)
            while y < j and (in_doc[b[y]] or in_doc[b[y] + n - 1]):
                y += 1  # a tile of this length that meets it holds its first or last word
            next_[i] = y
            if y < j:
                in_item[x : x + n] = True
                in_doc[b[y] : b[y] + n] = True
                covered, end = covered + n, x + n


def runs(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k adjacent words of one document, and the index of the first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = X.mix(out + h[j : n + j])
    keep = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return out[keep], keep


def _probes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a seed in the bitmap."""
    mask = np.uint64((1 << BITS) - 1)
    return (s & mask).astype(np.int64), ((s >> np.uint64(64 - BITS)) & mask).astype(np.int64)


def items_of(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(item, ik, n, words, seeds) of every distinct id and text with words: n words make a
    seed; ik stands for the item."""
    b = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    b = b.where("text is not null").distinct().withColumn("ik", F.xxhash64("item", "text"))

    def cut(frames):
        for pdf in frames:
            texts = X.encode(pdf["text"])
            for a, b in X.batches(texts):
                h, doc, *_ = X.word_hashes(texts[a:b])
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                out = []
                for i in range(b - a):
                    w = h[edge[i] : edge[i + 1]]
                    if len(w):
                        n = min(k, len(w))
                        s = runs(w, np.zeros(len(w), np.int64), n)[0]
                        out.append((pdf["item"].iloc[a + i], pdf["ik"].iloc[a + i], n, w.view(np.int64), s.view(np.int64)))
                yield pd.DataFrame(out, columns=["item", "ik", "n", "words", "seeds"])

    return b.mapInPandas(cut, "item long, ik long, n int, words array<long>, seeds array<long>")


def reduced(ids: np.ndarray, h: np.ndarray, doc: np.ndarray, near: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> list[tuple]:
    """(id, class, words, seeds) of every text with hits: its words under seeds, runs that were
    apart with GAP between them, and its distinct seeds. No item can match anything else of
    it, so texts with equal words here are one class."""
    keep = np.flatnonzero(near)
    if not len(keep):
        return []
    new = np.concatenate([[True], (keep[1:] != keep[:-1] + 1) | (doc[keep[1:]] != doc[keep[:-1]])])
    words, place = np.full(len(keep) + int(new.sum()), GAP), np.arange(len(keep)) + np.cumsum(new)
    words[place] = h[keep]
    own = doc[keep]
    edge = np.searchsorted(own, np.arange(len(ids) + 1))
    first = np.append(place, len(words) + 1)[edge] - 1  # the gap before each text's first word
    by = np.argsort(doc[at], kind="stable")
    cut = np.searchsorted(doc[at][by], np.arange(len(ids) + 1))
    out = []
    for i in np.unique(own):
        w = words[first[i] + 1 : first[i + 1]]
        c = X.mix(np.bitwise_xor.reduce(X.mix(w + X.mix(np.arange(len(w)).astype(np.uint64)))) + np.uint64(len(w)))
        out.append((ids[i], c.view(np.int64), w.view(np.int64), np.unique(seeds[by[cut[i] : cut[i + 1]]]).view(np.int64)))
    return out


def bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit of 2^BITS for both probes of each seed. The driver gets 2^BITS / 32 numbers at
    most, made by an aggregation."""

    def probe(frames):
        for pdf in frames:
            at = np.unique(np.concatenate(_probes(pdf["s"].to_numpy().view(np.uint64))))
            yield pd.DataFrame({"word": (at >> 5).astype(np.int32), "bit": np.int64(1) << (at & 31)})

    got = seeds.select("s").mapInPandas(probe, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(1 << (BITS - 5), np.uint32)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return words


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """`docs` with coverage (the largest share of an item's words that tiles in the document
    cover), item_id (that item; ties: the smallest id; null if none shares a seed),
    n_items (items covered to `coverage` at least) and contaminated (n_items > 0).

    Words are maximal runs without ASCII white space, A-Z lower-cased. Whole texts are tiled
    (a task holds some 100 bytes for each of the longest text's words). Null, empty and
    blank documents match nothing; a phrase that many documents and items share costs one class
    of documents, not each of them, for every item; and items without an id or without words are no items;
    rows of the benchmark that repeat an id and a text are one item. A row's result
    depends on its text alone, so repeated rows and rows without an id get theirs like any.
    Columns of `docs` with the four names are replaced; all others are kept, whatever
    their names. Empty tables are fine: no documents give no rows, no items match nothing."""
    stash = Stash(spark)
    items = stash.put(items_of(benchmark, item_id, item_text, k), "items")
    seeds = stash.put(items.select(F.explode("seeds").alias("s"), "ik"), "seeds")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # k numbers at most
    bits = bitmap(seeds)
    d = aside(docs, text_col).withColumn("__h", F.xxhash64(F.col(text_col).cast("string")))
    texts = d.where(F.col(text_col).isNotNull()).select(F.col("__h").alias("h"), F.col(text_col).cast("string").alias("text"))

    def probe(frames):
        for pdf in frames:
            raw, own = X.encode(pdf["text"]), pdf["h"].to_numpy()
            for a, b in X.batches(raw):
                h, doc, *_ = X.word_hashes(raw[a:b])
                cover, seeds_at, seeds_of = np.zeros(len(h) + 1, np.int64), [], []
                for n in lengths:
                    s, at = runs(h, doc, n)
                    x, y = _probes(s)
                    hit = np.flatnonzero((bits[x >> 5] >> (x & 31).astype(np.uint32)) & (bits[y >> 5] >> (y & 31).astype(np.uint32)) & np.uint32(1))
                    np.add.at(cover, at[hit], 1)
                    np.add.at(cover, at[hit] + n, -1)
                    seeds_at.append(at[hit])
                    seeds_of.append(s[hit])
                yield pd.DataFrame(reduced(own[a:b], h, doc, np.cumsum(cover[:-1]) > 0, np.concatenate([np.zeros(0, np.int64), *seeds_at]), np.concatenate([np.zeros(0, np.uint64), *seeds_of])), columns=["h", "c", "words", "seeds"])

    hits = stash.put(texts.mapInPandas(probe, "h long, c long, words array<long>, seeds array<long>"), "hits")
    # what is left of many texts may be the same passage: it is one class
    classes = stash.put(hits.groupBy("c").agg(F.any_value("words").alias("words"), F.any_value("seeds").alias("seeds")), "classes")
    counted = seeds.groupBy("s", "ik").agg(F.count(F.lit(1)).alias("m"))  # an item may hold a seed several times
    pairs = classes.select("c", F.explode("seeds").alias("s")).join(counted, "s").groupBy("c", "ik").agg(F.sum("m").alias("m"))
    then = pairs.join(items, "ik").select("c", "item", "words", F.least(F.lit(1.0), F.col("m") * F.least(F.lit(k), F.size("words")) / F.size("words")).alias("most"))
    # a class that meets many items is cut into parts, each with its words
    then = stash.put(then.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(PARTS))), "pairs")
    parts = then.select("c", "part").distinct()
    first = parts.join(classes.select("c", F.col("words").alias("text")), "c").select("c", "part", F.lit(None).cast("long").alias("item"), F.col("text").alias("words"), F.lit(2.0).alias("most"))
    both = first.unionByName(then).repartition("c", "part").sortWithinPartitions("c", "part", F.desc("most"), "item")

    def run(frames):
        text, key, top, n = None, None, None, 0

        def told():
            return [] if key is None or top is None else [(key[0], -top[0], top[1], n)]

        for pdf in frames:
            out = []
            for c, part, item, w, most in zip(pdf["c"], pdf["part"], pdf["item"], pdf["words"], pdf["most"]):
                w = np.asarray(w, np.int64).view(np.uint64)
                if most > 1.5:  # the class itself comes first
                    out += told()
                    text, key, top, n = w, (c, part), None, 0
                elif top is None or most >= min(-top[0], coverage):  # else no item from here on can be better or count
                    share = tile(w, text, min(k, len(w))) / len(w)
                    top = min(top or (1.0, 0), (-share, int(item)))
                    n += share >= coverage
            yield pd.DataFrame(out, columns=["c", "share", "item", "n"])
        yield pd.DataFrame(told(), columns=["c", "share", "item", "n"])

    # ids pass as text: beside a null, pandas would make them floats
    both = both.withColumn("item", F.col("item").cast("string"))
    found = both.mapInPandas(run, "c long, share double, item long, n long")
    best = F.min(F.struct((-F.col("share")).alias("c"), F.col("item")))
    found = stash.put(found.groupBy("c").agg(best.alias("best"), F.sum("n").alias("n")), "best")
    found = hits.select("h", "c").distinct().join(found, "c")
    found = stash.put(found.select(F.col("h").alias("__h"), (-F.col("best.c")).alias("coverage"), F.col("best.item").alias("item_id"), F.col("n").alias("n_items")), "found")
    out = d.join(found, "__h", "left")  # a table: copies of one text may be a third of all rows
    out = out.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))
    return back(out.withColumn("contaminated", F.col("n_items") > 0), docs, (text_col,), ("coverage", "item_id", "n_items", "contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
