"""Near-duplicate passages by paragraph MinHash banding.

Paragraphs run from one content-defined anchor to the next: anchors are words whose hash
(of GRAM words) is the smallest within REACH words on both sides. A passage that is
repeated inside other text is cut alike wherever it stands, which line ends do not give.
REACH is set by the shortest passage that has to be found: 50 words hold two anchors, and
so a whole paragraph, in nearly all cases only if paragraphs are of about 13 words.
Paragraphs do not overlap, so two of one text share shingles only if the text repeats.

1. Paragraphs of equal words are one class.
2. Each class has MinHashes of its word shingles in bands of some rows; `tune` chooses
   both for the wanted recall at the threshold and the fewest keys and false candidates.
3. Classes that collide in a band are joined, and exact Jaccard similarities of whole
   sets decide (`jaccard_join.search`, bucket by bucket; a large bucket in shards).
4. Components of the verified links: the paragraph of smallest (id, position) stays,
   and the words of the others are removed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp as X
from .common import Stash, components
from .jaccard_join import SHARD_BYTES, SHARD_DOCS, search
from .substring_dedup import texts_of, without_spans

GRAM, REACH = 3, 6
LEAST = 20  # words that a paragraph before the first anchor or after the last one has to be compared alone
#: What unrelated paragraphs share of their shingles, and what comparing all of them, if they
#: collided, would cost in keys a paragraph.
NOISE, PAIRS = 0.01, 25
MOST_ROWS = 8


def tune(similarity: float, recall: float = 0.98, noise: float = NOISE, pairs: float = PAIRS) -> tuple[int, int]:
    """(rows, bands): bands of so many MinHashes that find a pair of that similarity with that
    recall, the cheapest of one to MOST_ROWS rows. The cost is a key a band, and `pairs`
    times the chance that paragraphs of similarity `noise` collide."""
    plans = []
    for rows in range(1, MOST_ROWS + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows))) if similarity < 1 else 1
        plans.append((bands + pairs * (1 - (1 - noise**rows) ** bands), rows, bands))
    return min(plans)[1:]


def paragraphs(texts: list[bytes], k: int):
    """(document, class, first byte, end byte, shingles, offsets) of every paragraph: the
    class is a hash of its words and the k - 1 words behind it, and shingles[offsets[i] :
    offsets[i + 1]] are the hashes of its runs of k words. What stands before the first
    anchor or behind the last is a paragraph too. With fewer than LEAST words it has the
    class and shingles of itself and its neighbour, of a kind of their own, so that it goes
    only where a text starts or ends like another; if all of a text is so short, the text is
    one paragraph. One of fewer than k words has one shingle."""
    h, doc, start, stop = X.word_hashes(texts)
    n = len(h)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64), np.zeros(1, np.int64)
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    rest = first[doc] + count[doc] - np.arange(n)  # words from here to the end of the text
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    gram = np.full(n, top)
    m = n - GRAM + 1
    if m > 0:
        g = np.zeros(m, np.uint64)
        for j in range(GRAM):
            g = X.mix(g + h[j : m + j])
        gram[:m] = g
    gram[rest < GRAM] = top
    # smallest within REACH on both sides in its text; of equal ones the first
    lead = gram < top
    for j in range(1, REACH + 1):
        same = doc[j:] == doc[:-j]
        lead[j:] &= ~same | (gram[j:] < gram[:-j])
        lead[:-j] &= ~same | (gram[:-j] <= gram[j:])
    edge = lead.copy()
    edge[first[count > 0]] = True
    begin = np.flatnonzero(edge)
    size = np.minimum(np.append(begin[1:], n) - begin, rest[begin])
    # paragraphs at either end of a text have no anchor on that side
    open_end = ~lead[begin] | (size == rest[begin])
    keep = ~open_end | (size >= LEAST)
    bare = (count > 0) & (np.bincount(doc[begin[keep]], minlength=len(texts)) == 0)
    # a short end is compared with its neighbour before or behind it, salted: ends with ends
    origin, span, salt = begin.copy(), size.copy(), np.zeros(len(begin), np.uint64)
    short = ~keep & ~bare[doc[begin]]
    i = np.flatnonzero(short & ~lead[begin])
    span[i], salt[i] = size[i] + size[i + 1], 1
    i = np.flatnonzero(short & lead[begin])
    origin[i], span[i], salt[i] = begin[i - 1], size[i - 1] + size[i], 2
    whole, some = first[np.flatnonzero(bare)], ~bare[doc[begin]]
    begin, size, origin, span = (np.concatenate([x[some], w]) for x, w in ((begin, whole), (size, rest[whole]), (origin, whole), (span, rest[whole])))
    salt = np.concatenate([salt[some], np.zeros(len(whole), np.uint64)])
    by = np.argsort(begin, kind="stable")
    begin, size, origin, span, salt = begin[by], size[by], origin[by], span[by], salt[by]
    # hashes of k words; the end of a text gives none
    full = n - k + 1
    sh = np.zeros(max(full, 0), np.uint64)
    for j in range(k):
        if full > 0:
            sh = X.mix(sh + h[j : full + j])
    shingles = np.clip(np.minimum(span, rest[origin] - k + 1), 1, None)
    offs = np.concatenate([[0], np.cumsum(shingles)])
    at = np.repeat(origin - offs[:-1], shingles) + np.arange(offs[-1])
    out = np.zeros(len(at), np.uint64)
    long = np.repeat(rest[origin] >= k, shingles)
    out[long] = sh[at[long]]
    for i in np.flatnonzero(rest[origin] < k):
        x = np.uint64(int(rest[origin[i]]))
        for w in h[origin[i] : origin[i] + rest[origin[i]]]:
            x = X.mix(x + w)
        out[offs[i]] = x
    each = np.repeat(salt, shingles)
    out = np.where(each > 0, X.mix(out + X.mix(each)), out)
    # order matters for the class: the same words in another order are another class
    total = np.concatenate([[np.uint64(0)], np.cumsum(X.mix(out + X.mix(np.arange(len(at)).astype(np.uint64) - np.repeat(offs[:-1], shingles).astype(np.uint64))), dtype=np.uint64)])
    cls = X.mix(total[offs[1:]] - total[offs[:-1]] + X.mix(span.astype(np.uint64)))
    end = begin + size
    last = np.where(size == rest[begin], stop[end - 1], start[np.minimum(end, n - 1)])
    return doc[begin], cls, start[begin], last, out, offs


def bands(shingles: np.ndarray, offs: np.ndarray, n: int, rows: int = 1) -> np.ndarray:
    """(paragraphs, n) keys of the bands."""
    out = np.zeros((len(offs) - 1, n), np.uint64)
    if len(out):
        for b in range(n):
            for r in range(rows):
                odd = np.uint64((int(X.mix(np.uint64(b * rows + r + 1))) | 1))
                low = np.minimum.reduceat((shingles ^ odd) * odd, offs[:-1])
                out[:, b] = X.mix(out[:, b] + low + np.uint64(b))
    return out


def remove_near_passages(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, recall: float = 0.98) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, spans, n_passages, n_repeated) for every row of
    `docs`: the removed byte spans, what stays, the paragraphs of the text and how many of
    them repeat an earlier one.

    Words are maximal runs without ASCII white space, A-Z lower-cased; null, empty and blank
    texts have no paragraphs and lose nothing. Whole texts are used (a task holds some 100
    bytes for each of the longest text's words). A document is an id and a text: rows that
    repeat both are one document and get equal rows; texts that share an id come in order
    of their hash. A row without an id is not compared, loses nothing and has no
    paragraphs. Other columns of `docs`, whatever their names, are not read. An empty
    table gives no rows."""
    stash, (n_rows, n_bands) = Stash(spark), tune(num / den, recall)
    src, doc_key = texts_of(docs, id_col, text_col), ["id", "h"]

    def cut(frames):
        for pdf in frames:
            texts, ids, hs = X.encode(pdf["text"]), pdf["id"].to_numpy(), pdf["h"].to_numpy()
            for a, b in X.batches(texts):
                doc, cls, lo, hi, sh, offs = paragraphs(texts[a:b], k)
                keys = bands(sh, offs, n_bands, n_rows).view(np.int64)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                c, lo, hi, w = cls.view(np.int64), lo.astype(np.int32), hi.astype(np.int32), np.diff(offs).astype(np.int32)
                yield pd.DataFrame({"id": ids[a:b], "h": hs[a:b], "c": [c[i:j] for i, j in zip(at[:-1], at[1:])], "from": [lo[i:j] for i, j in zip(at[:-1], at[1:])], "to": [hi[i:j] for i, j in zip(at[:-1], at[1:])], "w": [w[i:j] for i, j in zip(at[:-1], at[1:])], "keys": [keys[i:j].ravel() for i, j in zip(at[:-1], at[1:])]})

    per_doc = src.where("id is not null").mapInPandas(cut, "id long, h long, c array<long>, from array<int>, to array<int>, w array<int>, keys array<long>")
    per_doc = stash.put(per_doc, "paragraphs")
    of = F.floor(F.col("i") / n_bands).cast("int")
    posts = per_doc.select("c", "w", F.posexplode("keys").alias("i", "key")).select("key", F.get("c", of).alias("c"), F.get("w", of).alias("w"))
    # a key or a class may stand in a third of all rows: what joins with rows is a table, so
    # that the joins can split it
    twice = stash.put(posts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "twice")
    posts = stash.put(posts.join(twice, "key").distinct(), "collisions")
    units = stash.put(per_doc.select(*doc_key, F.explode(F.arrays_zip("c", "from", "to")).alias("p")).select(*doc_key, "p.*"), "units")
    passages = stash.put(per_doc.select(*doc_key, F.size("c").cast("long").alias("n_passages")).distinct(), "passages")
    stash.drop(per_doc, twice)

    # classes that collide, and how many shards a bucket takes
    full = posts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.greatest(F.ceil(F.count(F.lit(1)) / SHARD_DOCS), F.ceil(F.sum("w") * 8 / SHARD_BYTES)).alias("k")).where("m > 1")
    full = stash.put(full, "buckets")
    buckets = stash.put(posts.join(full, "key").select(F.col("key").alias("g"), "k", "c"), "buckets")
    stash.drop(posts, full)
    first = units.groupBy("c").agg(F.min(F.struct("id", "h", "from")).alias("p"), F.count(F.lit(1)).alias("m"))
    hit = buckets.select("c").distinct().withColumn("hit", F.lit(True))
    first = stash.put(first.join(hit, "c", "left").where("m > 1 or hit"), "firsts")
    live = first.where("hit").groupBy(F.col("p.id").alias("id"), F.col("p.h").alias("h")).agg(F.collect_list("c").alias("want"))

    def sets(frames):
        for pdf in frames:
            texts = X.encode(pdf["text"])
            for a, b in X.batches(texts):
                doc, cls, _, _, sh, offs = paragraphs(texts[a:b], k)
                cls = cls.view(np.int64)
                rows = []
                for d, want in enumerate(pdf["want"].iloc[a:b]):
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    where = {int(c): i for i, c in zip(range(lo, hi), cls[lo:hi])}
                    for c in want:
                        i = where[c]
                        rows.append((c, np.unique(sh[offs[i] : offs[i + 1]]).view(np.int64)))
                yield pd.DataFrame(rows, columns=["c", "s"])

    whole = stash.put(src.join(live.hint("merge"), doc_key).mapInPandas(sets, "c long, s array<long>"), "sets")
    members = buckets.join(whole, "c").select("g", "k", "c", F.lit(1).cast("long").alias("weight"), "s")
    found = stash.put(search(members, num, den), "links")
    stash.drop(whole)
    comp = components(spark, found.where("v is not null").select("u", "v"), stash)
    first = first.join(comp.withColumnRenamed("id", "c"), "c", "left").where("m > 1 or component is not null").withColumn("component", F.coalesce("component", "c"))
    stays = first.groupBy("component").agg(F.min("p").alias("stay"))
    first = first.join(stays, "component").where((F.col("m") > 1) | (F.col("p") != F.col("stay"))).select("c", "stay")
    first = stash.put(first, "stay")
    gone = units.join(first.hint("merge"), "c").where(F.struct("id", "h", "from") != F.col("stay"))
    spans = gone.groupBy(*doc_key).agg(F.collect_list("from").alias("from"), F.collect_list("to").alias("to"), F.count_distinct("from").alias("n_repeated"))
    spans = stash.put(passages.join(spans, doc_key, "left"), "spans")
    stash.drop(units, found, passages)
    out = without_spans(src, spans.select(*doc_key, "from", "to"))
    return out.join(spans.select(*doc_key, "n_passages", "n_repeated"), doc_key, "left").fillna(0, ["n_passages", "n_repeated"]).drop("h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_near_passages(spark, docs)
    return found.select(F.col("id").alias("doc_id"), "n_passages", "n_repeated", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
