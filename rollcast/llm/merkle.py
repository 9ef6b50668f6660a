"""Merkle manifest of a dataset on a trie of ranks.

1. Ranks: a leaf's place in its source is the number of leaves with smaller ids. Ids are read
   as digits of 12 bits; a histogram by each prefix, and running sums over the at most 4,097
   sisters of one prefix, give what stands before an id, so nothing is sorted as a whole and
   no window holds more than the sisters (`radix_before`). Rows that repeat an id are ranked
   by the digits of their digests in the same way.
2. Trie: the digits of a rank in base FANOUT are a leaf's path. Nodes of the longest prefix
   are reduced first: FANOUT sisters become their digest. The lowest two levels are reduced
   in blocks of FANOUT^2 leaves, one row a block; above, a level is one aggregation over a
   table that is FANOUT times smaller than the one before. A source's root is a leaf of the
   trie of sources.
3. Proofs go down again: a node's path is its sisters and its parent's path; leaves get
   theirs by a join of blocks.

All of it is JVM expressions. What goes to the driver is the largest number of leaves in a
source and the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stash
from .ranks import by_range

FANOUT = 16
BLOCK = FANOUT * FANOUT
DIGIT, DIGITS = 12, 5  # bits of a digit, and digits of a 60-bit key
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*texts: Column) -> Column:
    """Lowercase hex of the SHA-256 of the texts, one behind the other."""
    return F.sha2(F.concat(*texts), 256)


def leaf(*values: Column) -> Column:
    """Digest of values, each as the length of its UTF-8 bytes, `:` and itself, or `-` if null."""
    told = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told])


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def proof(path: Column) -> Column:
    """Digest of all sisters along a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda at, s: digest(s.left, at, s.right))


def radix_before(stash: Stash, df: DataFrame, group: list[str], order: str) -> DataFrame:
    """`df` (group, p, n, order), with `before`: the sum of n over the rows of its group with a
    smaller (p, order). p is a key of 60 bits, signed or not; of one p there are few rows. The
    columns of `group` hold no nulls."""
    counts = stash.put(df.groupBy(*group, "p").agg(F.sum("n").alias("n")), "digits")
    names, found = [f"__g{i}" for i in range(len(group))], None
    for level in reversed(range(DIGITS)):
        h = counts.withColumn("p", F.shiftright("p", DIGIT * level))
        h = (h.groupBy(*group, "p").agg(F.sum("n").alias("n")) if level else h).withColumn("up", F.shiftright("p", DIGIT))
        sisters = [*group, "up"] if level < DIGITS - 1 else group
        h = h.withColumn("own", F.coalesce(F.sum("n").over(Window.partitionBy(*sisters).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if found is not None:
            h = h.join(found, [*(F.col(a) == F.col(b) for a, b in zip(group, names)), F.col("up") == F.col("__p")])
            h = h.withColumn("own", F.col("own") + F.col("__before"))
        found = h.select(*[F.col(a).alias(b) for a, b in zip(group, names)], F.col("p").alias("__p"), F.col("own").alias("__before"))
    inner = Window.partitionBy(*group, "p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    df = df.join(found, [*(F.col(a) == F.col(b) for a, b in zip(group, names)), F.col("p") == F.col("__p")])
    return df.withColumn("before", F.col("before") + F.col("__before")).drop(*names, "__p", "__before")


def ranked_leaves(stash: Stash, leaves: DataFrame) -> DataFrame:
    """(g, id, leaf, seen, first, n): n equal leaves with the ranks from `first` in their group,
    from leaves (g, id, leaf, seen). Null ids come first, equal ids go by leaf, then seen."""
    leaves = stash.put(leaves, "leaves")
    both = F.struct("leaf", "seen")
    ids = leaves.groupBy("g", "id").agg(F.count(F.lit(1)).alias("n"), F.min(both).alias("low"), F.max(both).alias("high"))
    none = -(1 << 59) - 1  # before all ids
    ids = radix_before(stash, ids.withColumn("p", F.coalesce(F.shiftright("id", 4), F.lit(none))), ["g"], "id")
    ids = stash.put(ids.select("g", "id", "low", "high", "before", "n"), "ids")
    one = ids.where("low = high").select("g", "id", "low.leaf", "low.seen", F.col("before").alias("first"), "n")
    # ids with different leaves
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    many = ids.where("low <> high").select(F.col("g").alias("g2"), key.alias("key2"), F.col("before").alias("from"))
    rest = leaves.withColumn("key", key).join(many, (F.col("g") == F.col("g2")) & (F.col("key") == F.col("key2")))
    rest = rest.groupBy("g", "key", "id", "leaf", "seen", "from").agg(F.count(F.lit(1)).alias("n"))
    rest = rest.withColumn("p", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")).withColumn("both", both)
    # the columns of a group with some of 60 bits are few, as digests are even
    rest = radix_before(stash, rest, ["g", "key"], "both")
    return one.unionByName(rest.select("g", "id", "leaf", "seen", (F.col("from") + F.col("before")).alias("first"), "n"))


def up_levels(stash: Stash, nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Reduces nodes (g, i, h, c), c of them in their group and `most` in the largest. Gives
    each level's runs (g, k, c, kids): the c nodes below in runs of FANOUT, and the roots
    (g, h, level), of the level at which a group has one node."""
    runs, roots, level = [], nodes.where("c = 1").select("g", "h", F.lit(0).alias("level")), 0
    while most > 1:
        run = nodes.where("c > 1").groupBy("g", F.floor(F.col("i") / FANOUT).cast("long").alias("k"), "c").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("kids"))
        run = stash.put(run.withColumn("kids", F.col("kids.h")), "runs")
        runs.append(run)
        most, level = -(-most // FANOUT), level + 1
        nodes = run.select("g", F.col("k").alias("i"), F.sha2(F.array_join("kids", ""), 256).alias("h"), F.ceil(F.col("c") / FANOUT).cast("long").alias("c"))
        roots = roots.unionByName(nodes.where("c = 1").select("g", "h", F.lit(level).alias("level")))
    return runs, roots


def sisters(kids: Column, j: Column) -> Column:
    """What stands left and right of the j-th (from 0) of its run of FANOUT in `kids`."""
    start = (F.floor(j / FANOUT) * FANOUT).cast("int")
    left = F.array_join(F.slice(kids, start + 1, (j - start).cast("int")), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(kids, (j + 2).cast("int"), start + FANOUT - 1 - j.cast("int")), "").alias("right"))


def down_levels(runs: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(g, i, path) of every node at the bottom of `runs`, from the paths (g, path, level) of
    each group's root, at the level of it."""
    last = ends.select("g", F.lit(0).cast("long").alias("i"), "path", "level")
    at = last.where(F.col("level") == len(runs)).drop("level")
    for level in reversed(range(len(runs))):
        up = at.select(F.col("g").alias("ug"), F.col("i").alias("ui"), F.col("path").alias("above"))
        kids = runs[level].join(up, (F.col("g") == F.col("ug")) & (F.col("k") == F.col("ui")))
        kids = kids.select("g", "k", "above", "kids", F.posexplode("kids").alias("j", "h"))
        path = F.concat(F.array(sisters(F.col("kids"), F.col("j"))), F.col("above"))
        at = kids.select("g", (F.col("k") * FANOUT + F.col("j")).alias("i"), path.alias("path"))
        at = at.unionByName(last.where(F.col("level") == level).drop("level"))
    return at


def manifest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(id, source, leaf, seen, subroot, root, path) of every row of `rows` (id, source, leaf,
    seen): leaf is its digest, seen the one that is to be verified. Per source, leaves ascend
    by id, and while several nodes remain, every FANOUT consecutive ones (the last run may
    be shorter, even one) become their digest; a lone leaf is its source's subroot. The
    subroots in order of source (null first, UTF-8 bytewise) give the root in the same
    way. path is an array of (left, right), from the leaf's sisters to those of its subroot.

    Null ids come before all others. Rows that repeat an id in a source stand in order of
    their leaf; wholly equal rows are leaves of their own, each with its own path. Any
    number of sources and rows a source is fine. Empty tables give no rows."""
    stash = Stash(spark)
    # a null source before all others
    g = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))
    ranked = ranked_leaves(stash, rows.select(g.alias("g"), "id", "leaf", "seen"))
    ranked = stash.put(ranked, "ranked")
    sizes = stash.put(ranked.groupBy("g").agg(F.sum("n").alias("m")), "sizes")
    most = sizes.agg(F.max("m")).first()[0]
    if most is None:
        steps = F.array().cast("array<struct<left: string, right: string>>")
        return rows.limit(0).select("id", "source", "leaf", "seen", F.lit("").alias("subroot"), F.lit("").alias("root"), steps.alias("path"))
    # blocks: what one equal leaf has in a block comes as one row
    last = F.col("first") + F.col("n") - 1
    cut = ranked.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(last / BLOCK))))
    cut = cut.select("g", "b", F.struct(F.greatest("first", F.col("b") * BLOCK).alias("a"), F.least(last, F.col("b") * BLOCK + BLOCK - 1).alias("z"), "id", "leaf", "seen").alias("x"))
    cut = cut.groupBy("g", "b").agg(F.sort_array(F.collect_list("x")).alias("x"))
    each = F.flatten(F.transform("x", lambda x: F.array_repeat(F.struct(x.id.alias("id"), x.leaf.alias("leaf"), x.seen.alias("seen")), (x.z - x.a + 1).cast("int"))))
    cut = cut.select("g", "b", each.alias("leaves"))
    m = sizes.select(F.col("g").alias("gm"), "m")
    low = F.col("leaves.leaf")
    runs = F.transform(F.sequence(F.lit(0), ((F.size(low) - 1) / FANOUT).cast("int")), lambda i: F.sha2(F.array_join(F.slice(low, i * FANOUT + 1, FANOUT), ""), 256))
    # a source may hold nearly all blocks, which are one row for FANOUT^2 leaves
    cut = stash.put(cut.join(m, F.col("g") == F.col("gm")).select("g", "b", "m", "leaves", runs.alias("nodes")), "blocks")
    top = F.when(F.col("m") == 1, low[0]).when(F.col("m") <= FANOUT, F.col("nodes")[0]).otherwise(F.sha2(F.array_join("nodes", ""), 256))
    nodes = cut.select("g", F.col("b").alias("i"), top.alias("h"), F.ceil(F.col("m") / BLOCK).cast("long").alias("c"))
    above, roots = up_levels(stash, nodes, -(-most // BLOCK))
    # the trie of sources
    roots = by_range(stash, roots.select("g", F.col("h").alias("subroot"), "level"), [F.asc("g")], "i")
    roots = stash.put(roots, "subroots")
    n = roots.count()
    over, root = up_levels(stash, roots.select(F.lit("").alias("g"), "i", F.col("subroot").alias("h"), F.lit(n).cast("long").alias("c")), n)
    end = root.first()
    no_path = F.array().cast("array<struct<left: string, right: string>>")
    paths = down_levels(over, spark.createDataFrame([("", end["level"])], "g string, level int").withColumn("path", no_path))
    paths = paths.select(F.col("i").alias("pi"), "path")
    roots = stash.put(roots.join(paths, F.col("i") == F.col("pi")).select("g", "subroot", "level", "path"), "sources")
    up = down_levels(above, roots.select("g", "path", "level")).select(F.col("g").alias("ug"), F.col("i").alias("ui"), F.col("path").alias("above"))
    out = cut.join(up, (F.col("g") == F.col("ug")) & (F.col("b") == F.col("ui")))
    subroots = roots.select(F.col("g").alias("gs"), "subroot")
    out = out.join(subroots, F.col("g") == F.col("gs"))
    out = out.select("g", "m", "subroot", "above", "nodes", low.alias("low"), F.posexplode("leaves").alias("j", "x"))
    own = F.array(sisters(F.col("low"), F.col("j")), sisters(F.col("nodes"), F.floor(F.col("j") / FANOUT)))
    own = F.slice(own, 1, F.when(F.col("m") == 1, 0).when(F.col("m") <= FANOUT, 1).otherwise(2))
    source = F.when(F.col("g") != "", F.substring("g", 2, (1 << 31) - 1))
    return out.select("x.id", source.alias("source"), "x.leaf", "x.seen", "subroot", F.lit(end["h"]).alias("root"), F.concat(own, F.col("above")).alias("path"))


def document_manifest(spark: SparkSession, docs: DataFrame, altered: Column | None = None, *, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: tuple = FIELDS) -> DataFrame:
    """`manifest` of the columns `fields` of `docs`. Where `altered` holds, the leaf that is
    verified is of the text with A-Z lower-cased. Nulls in any column are fine, texts of any
    length are hashed whole, and other columns, whatever their names, are not read."""
    told = {c: F.col(c) for c in fields}
    first = leaf(*told.values())
    seen = first if altered is None else F.when(altered, leaf(*(told | {text_col: lowered(F.col(text_col).cast("string"))}).values())).otherwise(first)
    return manifest(spark, docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("source"), first.alias("leaf"), seen.alias("seen")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = document_manifest(spark, docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    folded = found.withColumn("folded_root", fold(F.col("seen"), F.col("path"))).withColumn("proof_sha256", proof(F.col("path")))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
