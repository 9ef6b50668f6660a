"""Exact n-gram Jaccard self-join by T-occurrence search (DivideSkip), with components.

Two documents link when |A and B| >= t |A or B| for their sets of word shingles.
The search has two levels:

1. Over the cluster. Documents of equal sets are one class, so copies are never compared.
   A document looks at its first n - ceil(t n) + 1 + L tokens in hash order (n tokens in
   all, L = n // extra), so it shares at least L + 1 of the tokens that both look at with
   every partner. Because L + 1 occurrences are required, each document may set its
   S <= t L most frequent tokens (longest lists) aside and still meet each partner in a
   short list: of the shared tokens the rarest is set aside by neither. Lines and
   passages that many documents share are the long lists. What short lists still
   connect are candidate groups; a link never leaves one.
2. In a group (`links_within`), by the documents' whole sets: inverted lists of the group,
   the short lists merged on a heap that skips (`merge_skip`), the long ones probed by
   binary search for the documents that can still reach the overlap. A large group is cut
   into shards and searched cell by cell, each shard against each. A task returns a
   spanning forest of its links and each document's number of links, so no output has a
   row a pair."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textnp as X
from .common import Stash, components

EXTRA = 10  # L = n // EXTRA
#: A shard of a candidate group, and what one search takes together.
SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20
#: A probe of a list by binary search costs as much as merging so many of its entries.
PROBE = 40
#: The weight of a long list's length in the number of lists set aside (DivideSkip's mu).
MU = 0.0085
#: Short lists of more entries in all are merged by one array count: there, near copies are
#: in most of the lists, a heap could skip nothing, and the count gives the same numbers.
HEAP = 600


def set_aside(t: int, longest: int) -> int:
    """How many of the longest lists DivideSkip probes instead of merging, for t occurrences."""
    return max(0, min(t - 1, int(t / (MU * math.log2(max(longest, 2)) + 1))))


def merge_skip(post: list[int], at: list[int], end: list[int], t: int) -> tuple[list[int], list[int]]:
    """The entries that stand in t of the ascending lists post[at[i]:end[i]] at least, and in
    how many. The heap holds each list's next entry. If fewer than t lists have the
    smallest one, t - 1 lists are popped in all, and each jumps by binary search to the
    entry that is then on top: nothing before it can be in t lists."""
    k, at = len(at), list(at)
    heap = [post[a] * k + i for i, a in enumerate(at) if a < end[i]]
    heapq.heapify(heap)
    found, counts = [], []
    while len(heap) >= t and heap:
        top, out = heap[0] // k, []
        while heap and heap[0] // k == top:
            out.append(heapq.heappop(heap) % k)
        if len(out) >= t:
            found.append(top)
            counts.append(len(out))
            for i in out:
                at[i] += 1
        else:
            while heap and len(out) < t - 1:
                out.append(heapq.heappop(heap) % k)
            if not heap:
                break  # fewer than t lists are left
            top = heap[0] // k
            for i in out:
                at[i] = bisect_left(post, top, at[i], end[i])
        for i in out:
            if at[i] < end[i]:
                heapq.heappush(heap, post[at[i]] * k + i)
    return found, counts


def links_within(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All links among `sets` (distinct sorted hashes) by DivideSkip: a spanning forest as
    pairs of indices, and for each set the total weight of the sets it links with. With
    two sides only pairs across them are compared.

    Sets are numbered by size; a set is a query against those after it, so the required
    overlap T is at least that of two sets of its size, and a list is the tail behind
    the query. The L longest lists are set aside, and the others merged for the sets in
    T - L of them. Sets that miss more than the lists set aside are dropped; the rest are
    probed in the long lists, or these are counted as well where that is cheaper."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, side, weight = size[order], side[order], weight[order]
    flat = np.concatenate([sets[i] for i in order]) if m else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(m), size)
    by = np.argsort(flat, kind="stable")  # stable: documents ascend in each list
    tok, lists = flat[by], doc[by]
    new = np.concatenate([[True], tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    end = np.repeat(np.append(first[1:], len(tok)), np.diff(np.append(first, len(tok))))  # of the list, at each entry
    where = np.empty(len(by), np.int64)
    where[by] = np.arange(len(by))
    keys = (np.cumsum(new) - 1) * m + lists if len(tok) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    post = None
    label, links, forest = np.arange(m), np.zeros(m, np.int64), []
    for x in range(m):
        p = where[starts[x] : starts[x + 1]]
        tail = end[p] - p - 1
        p, tail = p[tail > 0], tail[tail > 0]
        n = int(size[x])
        least = -(-2 * num * n // (num + den))
        if len(p) < least or not n:
            continue
        by_length = np.argsort(tail, kind="stable")
        p, tail = p[by_length], tail[by_length]
        aside = set_aside(least, int(tail[-1]))
        cut = len(p) - aside
        short, total = tail[:cut], int(tail[:cut].sum())
        if total <= HEAP:
            post = lists.tolist() if post is None else post
            y, count = merge_skip(post, (p[:cut] + 1).tolist(), end[p[:cut]].tolist(), least - aside)
            y, count = np.array(y, np.int64), np.array(count, np.int64)
        else:
            at = np.repeat(p[:cut] + 1 - np.concatenate([[0], np.cumsum(short)[:-1]]), short) + np.arange(total)
            count = np.bincount(lists[at] - x, minlength=m - x)
            y = np.flatnonzero(count >= least - aside)
            y, count = y + x, count[y]
        need = -(-num * (n + size[y]) // (num + den))
        fine = (count + aside >= need) & (side[y] != side[x] if side.any() else True)
        y, count, need = y[fine], count[fine], need[fine]
        if not len(y):
            continue
        long = tail[cut:]
        if len(y) * len(long) * PROBE < long.sum():
            ask = (keys[p[cut:]] // m * m)[:, None] + y[None]
            got = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
            count = count + (keys[got] == ask).sum(0)
        elif len(long):
            at = np.repeat(p[cut:] + 1 - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(long.sum())
            count = count + np.bincount(lists[at] - x, minlength=m - x)[y - x]
        y = y[count >= need]
        if not len(y):
            continue
        links[x] += weight[y].sum()
        links[y] += weight[x]
        near, own = label[y], label[x]
        forest += [(int(order[x]), int(order[y[near == a][0]])) for a in np.unique(near) if a != own]
        joined = np.append(near, own)
        label[np.isin(label, joined)] = joined.min()
    back = np.empty(m, np.int64)
    back[order] = links
    return forest, back


def _fingerprint(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(X.mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return X.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64))


def digests(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, extra: int) -> DataFrame:
    """(id, n, class, tokens): set size, fingerprint of the set, tokens that are looked at."""

    def run(frames):
        for pdf in frames:
            texts = X.encode(pdf["text"])
            for a, b in X.batches(texts):
                s, offs = X.shingle_sets(texts[a:b], k)
                n = np.diff(offs)
                look = np.where(n > 0, np.minimum(n, n - (-(-num * n // den)) + 1 + n // extra), 0)
                signed = s.view(np.int64)
                yield pd.DataFrame({"id": pdf["id"].values[a:b], "n": n, "class": _fingerprint(s, offs).view(np.int64), "tokens": [signed[i : i + m] for i, m in zip(offs, look)]})

    # ids pass as text: beside a null, pandas would make them floats
    src = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(run, "id string, n long, class long, tokens array<long>").withColumn("id", F.col("id").cast("long"))


def shingle_sets(rows: DataFrame, k: int) -> DataFrame:
    """Rows (g, k, c, weight, text) with the text replaced by its whole set s. Texts that are
    not of the class c, such as another row's of the same id, go."""

    def run(frames):
        for pdf in frames:
            texts = X.encode(pdf["text"])
            for a, b in X.batches(texts):
                s, offs = X.shingle_sets(texts[a:b], k)
                own = _fingerprint(s, offs).view(np.int64) == pdf["c"].to_numpy()[a:b]
                s = s.view(np.int64)
                out = pdf[["g", "k", "c", "weight"]].iloc[a:b].assign(s=[s[i:j] for i, j in zip(offs[:-1], offs[1:])])
                yield out[own]

    return rows.select("g", "k", "c", "weight", "text").mapInPandas(run, "g long, k long, c long, weight long, s array<long>")


def search(members: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, links) from members (g, k, c, n, weight, s): forest links (u, v, null) and
    numbers of links (u, null, links). k: the number of shards of group g."""
    own = F.pmod(F.xxhash64("c"), F.col("k")).cast("int")
    rows = members.withColumn("o", own).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    rows = rows.select("g", "k", F.least("o", "j").alias("a"), F.greatest("o", "j").alias("b"), "o", "c", "weight", "s")

    def run(frames):
        key, held, size = None, [], 0

        def flush():
            if len(held) < 2:
                return
            apart = held[0][0] > 1 and held[0][1] != held[0][2]
            side = np.array([apart and r[3] == r[2] for r in held])
            if apart and side.all() == side.any():
                return  # one of the shards is empty
            forest, links = links_within([r[6] for r in held], np.array([r[5] for r in held], np.int64), side, num, den)
            c = [r[4] for r in held]
            some = np.flatnonzero(links)
            yield pd.DataFrame({"u": [c[i] for i, _ in forest] + [c[i] for i in some], "v": pd.array([c[j] for _, j in forest] + [None] * len(some), "Int64"), "links": pd.array([None] * len(forest) + links[some].tolist(), "Int64")})

        for pdf in frames:
            for g, k, a, b, o, c, w, s in zip(pdf["g"], pdf["k"], pdf["a"], pdf["b"], pdf["o"], pdf["c"], pdf["weight"], pdf["s"]):
                if held and (g, a, b) == key and held[-1][4] == c:
                    continue  # a repeated row
                # whole small groups are searched together; a cell of a large one by itself
                if (g, a, b) != key:
                    if held and (k > 1 or held[0][0] > 1 or len(held) >= SHARD_DOCS // 4 or size >= SHARD_BYTES // 4):
                        yield from flush()
                        held, size = [], 0
                    key = (g, a, b)
                held.append((k, a, b, o, c, w, np.asarray(s, np.int64).view(np.uint64)))
                size += 8 * len(s)
        yield from flush()

    return rows.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "c").mapInPandas(run, "u long, v long, links long")


def jaccard_components(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, extra: int = EXTRA) -> DataFrame:
    """(id, n_shingles, component_id, class_id, n_links) for every row of `docs`.

    Words are maximal runs without ASCII white space, A-Z lower-cased; the set holds
    k-word shingles, or the whole sequence if there are fewer words. A null, empty or
    blank text has an empty set, links with nothing and is its own component. class_id
    is the smallest id of an equal set. n_links is the number of other documents linked
    directly, copies included. A document is an id and its set: rows that repeat both are
    one document and get equal rows; rows of one id with different texts are documents of
    their own. Rows without an id are not compared: they have no component and no class,
    and no links. Texts of any length are taken whole (a task holds some 100 bytes for
    each of the longest text's words); other columns of `docs`, whatever their names, are
    not read. An empty table gives no rows. Sets of equal 64-bit fingerprint and size count
    as equal."""
    stash = Stash(spark)
    dig = stash.put(digests(docs, id_col, text_col, k, num, den, extra), "digests")
    posts = dig.where("n > 0 and id is not null").select(F.explode("tokens").alias("t"), F.col("class").alias("c"), "n")
    # a token may stand in a third of all rows: counts are tables, so that joins can split it
    twice = stash.put(posts.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("t"), "twice")
    posts = stash.put(posts.join(twice, "t").groupBy("t", "c").agg(F.first("n").alias("n")), "postings")
    ids = stash.put(dig.select("id", "n", "class"), "ids")
    stash.drop(dig, twice)
    df = stash.put(posts.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "lengths")
    by_doc = Window.partitionBy("c").orderBy(F.desc("df"), "t")
    # the longest lists of each document are set aside
    lists = posts.join(df, "t").withColumn("r", F.row_number().over(by_doc)).where(F.col("r") > F.floor(F.col("n") * num / (den * extra)))
    lists = stash.put(lists.select("t", "c", "n"), "lists")
    stash.drop(posts, df)
    # what the short lists connect, and how many shards that takes
    lead = stash.put(lists.groupBy("t").agg(F.min("c").alias("l"), F.max("c").alias("h")).where("l < h").select("t", "l"), "lead")
    # near copies meet in nearly all of their lists: each link once, or every task gets its own part of the same ones
    near = lists.join(lead, "t").where(F.col("c") != F.col("l")).select(F.col("l").alias("u"), F.col("c").alias("v")).distinct()
    groups = stash.put(components(spark, near, stash), "groups")
    stash.drop(lists, lead)
    classes = ids.where("n > 0 and id is not null").groupBy("class", "n").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("weight"))
    classes = stash.put(classes, "classes")
    live = classes.join(groups, F.col("class") == F.col("id")).select(F.col("component").alias("g"), F.col("class").alias("c"), "n", "class_id", "weight")
    shards = live.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SHARD_DOCS), F.ceil(F.sum("n") * 8 / SHARD_BYTES)).alias("k"))
    live = stash.put(live.join(shards, "g"), "live")
    texts = docs.select(F.col(id_col).cast("long").alias("class_id"), F.col(text_col).cast("string").alias("text"))
    found = stash.put(search(shingle_sets(texts.join(live.hint("merge"), "class_id"), k), num, den), "links")
    comp = components(spark, found.where("v is not null").select("u", "v"), stash)

    # back to documents: the smallest id of a class, then of a component
    degree = found.where("links is not null").groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))
    classes = classes.join(comp.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    classes = classes.join(least, "component").select("class", "n", "class_id", "component_id", n_links)
    # a class may hold a third of all rows: both sides are tables, so that the join can split it
    classes = stash.put(classes.select(F.col("class").alias("cls"), F.col("n").alias("m"), "class_id", "component_id", "n_links"), "result")
    out = ids.join(classes.hint("merge"), (F.col("class") == F.col("cls")) & (F.col("n") == F.col("m")) & F.col("id").isNotNull(), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(spark, docs).withColumnRenamed("id", "doc_id")
