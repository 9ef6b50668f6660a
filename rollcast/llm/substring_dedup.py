"""Exact substring dedup by longest previous factors in suffix order.

Every byte is removed that lies in a string of `length` bytes which also starts earlier
(in a document of smaller id, or earlier in the same one); the first copy stays.

A string of `length` bytes is routed by its minimizer, so all its copies meet, and each
window is routed once. The windows that one minimizer owns are a segment of text. Where
segments of one minimizer meet, their suffixes are sorted to depth `length`
(`suffix_order`), neighbours' common prefixes are measured, and one stack pass finds the
previous and next smaller position of each suffix in that order, the longer common prefix
with which is its longest previous factor (`previous_factors`). A window is repeated if
that reaches `length`.

Before that, segments whose minimizer occurs once go, as they hold nothing repeated, and of
equal segments all but the first are repeated throughout, which hashes tell without a
sort (`collapse`; without it the same bytes are removed). A minimizer with more than HOT
different segments is too much for a task, and a window that stands in a third of all
documents is in as many of them: its windows are hashed one by one and the first of
equal ones is found by an aggregation, with map-side combining."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp as X
from .anchors import owned_windows
from .common import Stash

LENGTH, GRAM = 100, 20
HOT = 50_000
KERNEL_BYTES = 1 << 20


def merge(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a set of half-open intervals; adjacent ones join."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[new], stop[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def segments(docs: DataFrame, length: int, gram: int, collapse: bool = True) -> DataFrame:
    """From (id, h, text): a row a document with its segments (key, hash, start, n windows,
    offset of the anchor) and the intervals that its batch shows to be repeated."""

    def run(frames):
        for pdf in frames:
            pdf = pdf.sort_values(["id", "h"], kind="stable")
            texts, ids, hs = X.encode(pdf["text"]), pdf["id"].to_numpy(), pdf["h"].to_numpy()
            for a, b in X.batches(texts):
                buf, offs = X.lay(texts[a:b], b"\0")
                key, first, last, anchor = owned_windows(buf, offs, length, gram)
                doc = np.searchsorted(offs, first, "right") - 1
                h = X.span_hash(X.prefix_hash(buf), first, last + length)
                h = X.mix(h + X.mix((anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
                seen = np.zeros(len(key), bool)
                if collapse:
                    # a repeated row is not compared with its like
                    other = (ids[a + 1 : b] != ids[a : b - 1]) | (hs[a + 1 : b] != hs[a : b - 1])
                    row = np.concatenate([[0], np.cumsum(other)])[doc] if b > a else doc
                    _, at, back = np.unique(key ^ X.mix(h), return_index=True, return_inverse=True)
                    lead = at[back]
                    seen = (lead != np.arange(len(key))) & ((row[lead] != row) | (doc[lead] == doc))
                own = ~seen
                rel = first - offs[doc]
                cut, seen_cut = np.searchsorted(doc[own], np.arange(b - a + 1)), np.searchsorted(doc[seen], np.arange(b - a + 1))
                k, s, st = key[own].view(np.int64), h[own].view(np.int64), rel[own].astype(np.int32)
                nw, of = (last - first)[own].astype(np.int32), (anchor - first)[own].astype(np.int32)
                lo, hi = rel[seen], rel[seen] + (last - first)[seen] + length
                rows = []
                for i in range(b - a):
                    x, y = cut[i], cut[i + 1]
                    f, e = merge(lo[seen_cut[i] : seen_cut[i + 1]], hi[seen_cut[i] : seen_cut[i + 1]])
                    rows.append((ids[a + i], hs[a + i], k[x:y], s[x:y], st[x:y], nw[x:y], of[x:y], f.astype(np.int32), e.astype(np.int32)))
                yield pd.DataFrame(rows, columns=["id", "h", "key", "hash", "start", "n", "anchor", "from", "to"])

    ints = "array<int>"
    return docs.where("id is not null").mapInPandas(run, f"id long, h long, key array<long>, hash array<long>, start {ints}, n {ints}, anchor {ints}, from {ints}, to {ints}")


def suffix_order(buf: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the positions `at` (as indices) in order of the `depth` bytes behind
    each, ties by position, and the length of each one's common prefix with the one
    before it, `depth` at most. By prefix doubling; the ranks of every doubling are kept and
    measure the prefixes. `buf` ends in 2 * depth bytes that are no window's."""
    size = len(buf) - 7
    word = np.zeros(size, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | buf[j : j + size].astype(np.uint64)

    def dense(keys):
        order = np.argsort(keys)
        ordered = keys[order]
        out = np.empty(len(keys), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        return out

    levels, d = [(8, dense(word))], 8  # ranks by 8, 16, 32, ... bytes
    while 2 * d <= depth:
        rank = levels[-1][1]
        rank = dense(rank[:-d] * np.int64(size + 1) + rank[d:])
        d *= 2
        levels.append((d, rank))
    rank = levels[-1][1]
    last = rank[at] * np.int64(size + 1) + rank[at + (depth - d)]
    order = np.argsort(last, kind="stable")
    common = np.zeros(len(at), np.int64)
    if len(at) > 1:
        a, b = at[order[:-1]], at[order[1:]]
        n = np.zeros(len(a), np.int64)
        for d, rank in reversed(levels):
            n += d * (rank[a + n] == rank[b + n])
        apart = word[a + n] ^ word[b + n]
        for j in range(7):  # equal bytes at the front of a word
            n += apart < np.uint64(1 << (56 - 8 * j))
        common[1:] = np.minimum(n, depth)
    return order, common


def previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of positions 0 to n - 1, from their suffix order and common
    prefixes: of each, the longer of the common prefixes with the nearest smaller position
    before and behind it in that order. One pass: the stack holds positions that ascend,
    each with its common prefix with the one below, which is its previous smaller one; a
    position that is taken off has met its next smaller one."""
    out = [0] * len(order)
    stack, shared = [-1], [0]
    for p, n in zip(order.tolist(), common.tolist()):
        while stack[-1] > p:
            below = shared.pop()
            out[stack.pop()] = below if below > n else n
            if below < n:
                n = below
        stack.append(p)
        shared.append(n)
    for p, n in zip(stack[1:], shared[1:]):
        out[p] = n
    return np.array(out, np.int64)


def factors(texts: list[bytes], n: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factors, `length` at most, of the first n + 1 windows of each text
    (texts in order of position), flat."""
    buf = np.frombuffer(b"\0".join(texts) + b"\0" * (2 * length + 8), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    at = np.repeat(offs - np.concatenate([[0], np.cumsum(n + 1)[:-1]]), n + 1) + np.arange((n + 1).sum())
    return previous_factors(*suffix_order(buf, at, length))


def by_suffix_order(rows: DataFrame, length: int) -> DataFrame:
    """(id, h, from, to) of repeated intervals, from rows (key, id, h, start, n, bytes); all
    rows of a key are compared with each other."""

    def run(frames):
        held, size, key = [], 0, None

        def flush():
            rows = sorted(held, key=lambda r: r[:3])
            rows = [r for r, q in zip(rows, [None, *rows]) if q is None or r[:3] != q[:3]]  # repeated rows of the table
            n = np.array([r[3] for r in rows], np.int64)
            hit = factors([r[4] for r in rows], n, length) >= length
            row = np.repeat(np.arange(len(rows)), n + 1)
            at = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n + 1)[:-1]]), n + 1)
            row, at = row[hit], at[hit]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])[: len(row)])
            end = np.append(new[1:], len(row))[: len(new)] - 1
            ids, hs, base = (np.array([rows[i][c] for i in row[new]], np.int64) for c in range(3))
            return pd.DataFrame({"id": ids, "h": hs, "from": (base + at[new]).astype(np.int32), "to": (base + at[end] + length).astype(np.int32)})

        for pdf in frames:
            for k, i, h, s, n, b in zip(pdf["key"], pdf["id"], pdf["h"], pdf["start"], pdf["n"], pdf["bytes"]):
                if k != key and size > KERNEL_BYTES:
                    yield flush()
                    held, size = [], 0
                key = k
                held.append((i, h, s, n, bytes(b)))
                size += len(b) + 1
        if held:
            yield flush()

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "id long, h long, from int, to int")


def by_hash(rows: DataFrame, length: int) -> DataFrame:
    """As by_suffix_order, for keys with any number of rows: windows are hashed and the first
    of each hash found by aggregation."""

    def run(frames):
        for pdf in frames:
            for i, h, s, n, b in zip(pdf["id"], pdf["h"], pdf["start"], pdf["n"], pdf["bytes"]):
                at = np.arange(n + 1)
                w = X.span_hash(X.prefix_hash(np.frombuffer(bytes(b), np.uint8)), at, at + length)
                yield pd.DataFrame({"w": w.view(np.int64), "id": i, "h": h, "from": (s + at).astype(np.int32)})

    windows = rows.mapInPandas(run, "w long, id long, h long, from int")
    first = windows.groupBy("w").agg(F.min(F.struct("id", "h", "from")).alias("first"))
    later = windows.join(first, "w").where(F.struct("id", "h", "from") != F.col("first"))
    return later.select("id", "h", "from", (F.col("from") + length).alias("to"))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): a document is an id and a text, which h stands for; rows that repeat both
    are one document."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def without_spans(src: DataFrame, spans: DataFrame) -> DataFrame:
    """From texts (id, h, text) and spans (id, h, from, to; arrays of byte positions): a row
    (id, h, n_bytes, n_removed, n_spans, kept, spans) for each text."""

    def keep(frames):
        for pdf in frames:
            out = []
            for i, h, text, lo, hi in zip(pdf["id"], pdf["h"], X.encode(pdf["text"]), pdf["from"], pdf["to"]):
                lo, hi = ([], []) if lo is None else merge(np.asarray(lo, np.int64), np.minimum(np.asarray(hi, np.int64), len(text)))
                edges = [0, *(int(x) for pair in zip(lo, hi) for x in pair), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((i, h, len(text), len(text) - len(kept), len(lo), kept, [{"from": int(a), "to": int(b)} for a, b in zip(lo, hi)]))
            yield pd.DataFrame(out, columns=["id", "h", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    # neither side has a bound: both are dealt by id at every size
    # ids pass as text: beside a null, pandas would make them floats
    both = src.join(spans.hint("merge"), ["id", "h"], "left").withColumn("id", F.col("id").cast("string"))
    return both.mapInPandas(keep, "id string, h long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<from: int, to: int>>").withColumn("id", F.col("id").cast("long"))


def remove_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, collapse: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, spans) for every row of `docs`: the bytes that
    stay (binary) and the removed half-open byte spans, maximal and in order.

    Texts are UTF-8 bytes, taken whole (a task holds some 100 bytes for each of the longest
    text's); null is empty. A document is an id and a text: rows that repeat both are one
    document and get equal rows; texts that share an id come in order of their hash. A
    row without an id is not compared and keeps all its bytes. Other columns of `docs`,
    whatever their names, are not read. An empty table gives no rows."""
    stash = Stash(spark)
    src, doc = texts_of(docs, id_col, text_col), ["id", "h"]
    per_doc = stash.put(segments(src, length, gram, collapse), "segments")
    rows = per_doc.select(*doc, F.explode(F.arrays_zip("key", "hash", "start", "n", "anchor")).alias("s")).select(*doc, "s.*")
    keys = per_doc.select(F.explode("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    keys = stash.put(keys, "keys")  # a table: a minimizer may be in a third of all rows, and the join can split it
    rows = stash.put(rows.join(keys, "key"), "shared")
    local = stash.put(per_doc.where(F.size("from") > 0).select(*doc, "from", "to"), "local")
    stash.drop(per_doc, keys)

    # equal segments: all but the first are repeated
    place = F.struct("id", "h", "start", "n", "anchor")
    by = ["key", "hash"] if collapse else ["key", "hash", "id", "h", "start"]
    first = stash.put(rows.groupBy(*by).agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("m")).select("key", "hash", "p", "m"), "firsts")
    earliest = first.where("m > 1" if collapse else "false").select("key", "hash", "p")
    later = rows.join(earliest, ["key", "hash"]).where(F.struct("id", "h", "start") != F.struct("p.id", "p.h", "p.start"))
    later = stash.put(later.select(*doc, F.col("start").alias("from"), (F.col("start") + F.col("n") + length).alias("to")), "later")
    stash.drop(rows)

    # different segments of one minimizer
    several = stash.put(first.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    todo = first.drop("m").join(several, "key").select("key", F.col("m") > HOT, "p.*").toDF("key", "hot", "id", "h", "start", "n", "anchor")
    todo = todo.groupBy(*doc).agg(F.collect_list(F.struct("key", "hot", "start", "n")).alias("s"))

    def cut(frames):
        for pdf in frames:
            out = []
            for i, h, text, s in zip(pdf["id"], pdf["h"], X.encode(pdf["text"]), pdf["s"]):
                out += [(r["key"], r["hot"], i, h, r["start"], r["n"], text[r["start"] : r["start"] + r["n"] + length]) for r in s]
            yield pd.DataFrame(out, columns=["key", "hot", "id", "h", "start", "n", "bytes"])

    pieces = src.join(todo.hint("merge"), doc).mapInPandas(cut, "key long, hot boolean, id long, h long, start int, n int, bytes binary")
    pieces = stash.put(pieces, "pieces")
    found = stash.put(by_suffix_order(pieces.where("not hot").drop("hot"), length).unionByName(by_hash(pieces.where("hot").drop("hot"), length)), "found")
    stash.drop(pieces, first, several)

    spans = later.unionByName(found).groupBy(*doc).agg(F.collect_list("from").alias("from"), F.collect_list("to").alias("to"))
    spans = spans.unionByName(local)
    spans = stash.put(spans.groupBy(*doc).agg(F.flatten(F.collect_list("from")).alias("from"), F.flatten(F.collect_list("to")).alias("to")), "spans")
    stash.drop(later, local, found)
    return without_spans(src, spans).drop("h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(spark, docs)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
