"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns the columns of documents with the values they had, whatever other columns there
are and whatever their names; the last mixes and shards, and returns each document's
shard and slot. Texts of any length are taken whole, and an empty table gives no rows in
every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcast.llm import common, decontaminate, jaccard_join, lang_id, mixing, sharding

#: A document whose best language has less than this share of its windows' probability is
#: rejected like one without letters.
LEAST_SCORE = 0.35


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` without the rows whose doc_id is in `ids`; rows without a doc_id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null, empty, without letters, or of no clear language.
    If no document names its language there is no model, and only the first three kinds go.
    A row's fate depends on its text, so repeated rows and rows without an id share it."""
    common.tune(spark)
    model = lang_id.train(spark, docs.select("doc_id", "text", "lang"), ~lang_id.held_out("doc_id", 5, 0))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = lang_id.identify(common.aside(docs, "text"), model)
    return common.back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs, ("text",))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of near duplicates. Rows that
    repeat an id and a text are one document and stay or go together; rows without an id
    are not compared and stay, as do null and empty texts. Where texts that share an id are
    of several components, the id goes if one of them is not its component's smallest."""
    found = jaccard_join.jaccard_components(spark, docs.select("doc_id", "text")).where("id <> component_id")
    gone = common.Stash(spark).put(found.select(F.col("id").alias("doc_id")), "copies")
    return _without(docs, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that cover a benchmark item. Null and empty texts cover none; a row's
    fate depends on its text, so repeated rows and rows without an id share it."""
    common.tune(spark)
    found = decontaminate.decontaminate(spark, common.aside(docs, "text"), common.table(spark, sf_dir, "benchmark"))
    return common.back(found.where(~F.col("contaminated")), docs, ("text",))


def mix_and_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix, which by default are all that are left. The
    mix is an order: each shard's slots follow the documents' mix_position, so whoever
    reads shards by slot meets the sources as the targets say. Repeated rows, rows without
    an id, null sources and null texts are in the mix like any and have slots of their own."""
    common.tune(spark)
    # rows that share an id, or have none, are told apart by their texts
    rows = sharding.sizes(docs, "source").withColumn("key", F.struct("doc_id", "size", "text_crc32"))
    mixed = mixing.mix(spark, rows, id_col="key").where("in_mix").select("doc_id", "size", "text_crc32", "mix_position")
    return sharding.shard_in_order(spark, common.Stash(spark).put(mixed, "mixed"), "mix_position")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix_and_shard", mix_and_shard)]

#: Language ID and the mixing schedule have no SQL form; tests hold stages and the order of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again. What
    a stage wrote on the way is deleted once its result is there. An empty table gives no
    rows."""
    stash, docs = common.Stash(spark), common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = list(common.Stash.held)
        after = stash.put(stage(spark, docs, sf_dir), name)
        common.release(but=before)
        if name != STAGES[0][0]:
            stash.drop(docs)
        docs = after
    return docs
