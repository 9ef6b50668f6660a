"""Importance resampling towards a target distribution, by hashed n-grams on word tries.

1. Counts: each task walks its texts through a trie of words. A node is a run of words; it
   has a count and the CRC-32 of the run's bytes, which the node's own word carries on from
   its parent's, so no run is put together or hashed from its start. Counts go to buckets
   slice by slice, and a trie beyond NODES nodes starts anew, so a task's memory does not
   depend on its partition. Totals are merged by bucket.
2. Gains: a bucket's gain is the scaled log ratio of its smoothed shares in the target and in
   the documents; there are `buckets` of them, whatever the input, so each task gets all.
3. Scores: documents are walked through tries again, whose nodes lead to their bucket's
   gain now; a document's weight is the sum along its paths. With Gumbel noise from a hash
   of the id, the highest scores are a draw without replacement by weight.
4. Ranks come from a range exchange of ids and scores and the sizes of its partitions."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp as X
from .common import Stash
from .ranks import by_range

BUCKETS, MAX_WORDS = 10000, 1
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
SCALE = 1000
NODES = 1 << 18

#: Bytes of words stand for themselves, A-Z lower-cased; all others separate words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Step(dict):
    """From a node by a word: the root's words, or pairs of a node and a word. Asking for a node
    that is not there adds it."""

    def __init__(self, trie: Trie, root: bool):
        self.trie, self.root = trie, root

    def __missing__(self, key) -> int:
        crc = self.trie.crc
        crc.append(zlib.crc32(key) if self.root else zlib.crc32(b" " + key[1], crc[key[0]]))
        self[key] = node = len(crc) - 1
        return node


class Trie:
    """Nodes of runs of words, with the CRC-32 of their bytes; node 0 is the root."""

    def __init__(self):
        self.crc = [0]
        self.first, self.next = Step(self, True), Step(self, False)
        self.told = np.zeros(0, np.int64)

    def walk(self, w: list[bytes], most: int):
        """The nodes of all runs of one word, then of two, and so on up to `most`."""
        nodes: list[int] = []
        for n in range(min(most, len(w))):
            nodes = list(map(self.next.__getitem__, zip(nodes, w[n:])) if n else map(self.first.__getitem__, w))
            yield np.array(nodes, np.int64)

    def buckets(self, n: int) -> np.ndarray:
        """The bucket of every node, of n."""
        if len(self.told) < len(self.crc):
            self.told = np.concatenate([self.told, np.array(self.crc[len(self.told) :], np.int64) % n])
        return self.told


def bucket_counts(texts: list[bytes], most: int = MAX_WORDS, buckets: int = BUCKETS, trie: Trie | None = None) -> np.ndarray:
    """How many runs of 1 to `most` words fall into each bucket."""
    trie, total = trie or Trie(), np.zeros(buckets, np.int64)
    seen = [nodes for text in texts for nodes in trie.walk(words(text), most)]
    if seen:
        count = np.bincount(np.concatenate(seen))
        np.add.at(total, trie.buckets(buckets)[: len(count)], count)
    return total


def weigh(texts: list[bytes], gains: np.ndarray, most: int = MAX_WORDS, trie: Trie | None = None) -> list[tuple[int, int, int]]:
    """(words, features, weight) of each byte string."""
    trie, walked = trie or Trie(), []
    for text in texts:
        w = words(text)
        walked.append((len(w), list(trie.walk(w, most))))
    gain = gains[trie.buckets(len(gains))]
    return [(n, sum(map(len, paths)), sum(int(gain[nodes].sum()) for nodes in paths)) for n, paths in walked]


def totals(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of `texts` (text)."""

    def run(frames):
        trie, total = Trie(), np.zeros(buckets, np.int64)
        for pdf in frames:
            raw = X.encode(pdf["text"])
            for a, b in X.batches(raw):
                total += bucket_counts(raw[a:b], most, buckets, trie)
                if len(trie.crc) > NODES:
                    trie = Trie()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return texts.mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket from totals (bucket, n): floor(1000 ln(((t + 1) (S + B)) / ((s + 1)
    (T + B)))). The driver gets at most `buckets` rows of each."""
    s, t = ({r["bucket"]: r["n"] for r in x.collect()} for x in (docs, target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return np.array([math.floor(SCALE * math.log(float((t.get(b, 0) + 1) * all_s) / float((s.get(b, 0) + 1) * all_t))) for b in range(buckets)], np.int64)


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    max_words: int = MAX_WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of `docs`.

    Words are runs of 0-9, a-z and all that is not ASCII, after A-Z is lower-cased. Features
    are runs of 1 to max_words words, repeats counted. Of the N documents with min_words
    words at least, the floor(percent N / 100) of the highest scores are drawn, ties to
    smaller ids; rank counts them from 1 and is null for all others.

    Null and empty texts, and those without words, have no features and weight 0; they are
    scored, but drawn only if min_words is 0. Texts are walked whole, whatever their length.
    A null id counts as an empty one in the hash and comes first in ties. Rows that repeat an
    id and a text are rows like any: all count, tie, and get ranks of their own. Without
    documents there are no rows, and a target without words leaves the gains to the
    documents' own counts. Other columns, whatever their names, are not read."""
    stash = Stash(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gains = bucket_gains(totals(d.select("text"), max_words, buckets), totals(target.select(F.col(target_text).cast("string").alias("text")), max_words, buckets), buckets)

    def run(frames):
        trie = Trie()
        for pdf in frames:
            raw = X.encode(pdf["text"])
            for a, b in X.batches(raw):
                out = pd.DataFrame(weigh(raw[a:b], gains, max_words, trie), columns=["n_words", "n_features", "weight"])
                yield out.assign(id=pdf["id"].values[a:b])[["id", "n_words", "n_features", "weight"]]
                if len(trie.crc) > NODES:
                    trie = Trie()

    # ids pass as text: beside a null, pandas would make them floats
    scored = d.withColumn("id", F.col("id").cast("string")).mapInPandas(run, "id string, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -SCALE)
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("id", F.col("id").cast("long"))
    # equal rows differ by where they stand, so that a range of them can be cut
    scored = stash.put(scored.withColumn("at", F.monotonically_increasing_id()), "scored")
    fits = F.col("n_words") >= min_words
    ranked = by_range(stash, scored, [F.desc(fits), F.desc("score"), F.asc_nulls_first("id"), F.asc("at")])
    total = ranked.agg(F.count_if(fits)).first()[0]
    drawn = fits & (F.col("rank") < percent * total // 100)
    return ranked.select("id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank") + 1).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(spark, docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
