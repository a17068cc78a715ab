"""The corpus pipeline: stages that each apply one operator to all documents that the stage before kept.

language: documents without a letter go, and all if nothing is learned. near_duplicates: one document of each
group of near copies stays. benchmark: documents with a benchmark window go. personal_data: personal data
are replaced by their kind in brackets. packing: the documents' tokens in windows. All but the last return
the columns that they got, whatever their names.

Alike in all stages: an empty table gives an empty one; rows with null ids or repeated ids are judged by their
own text; null and empty texts have no letter, so they end at the first stage, and later ones would keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import jaccard_join, language_id, packing, phrase_index, pii
from textmill.shared import removed, scratch, shared_folder


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter, whose ties go to the first language in order; repeated rows are judged alike."""
    return docs.where(language_id.judged(docs, language_id.fit(docs))["lang_pred"] != "und")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each component, one of rows that repeat an id and a text; all documents without words."""
    return jaccard_join.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any window of a benchmark item, by their own text: ids may be null or repeat."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = phrase_index.judged(docs, items)
    if hit is not None:
        return docs.where(~hit)
    # Several blocks of items: these are searched one after another in a stored index.
    key = F.xxhash64("text", F.col("text").isNull())
    who = docs.select(F.struct(F.col("doc_id").alias("id"), key.alias("key")).alias("who"), "text")
    bad = phrase_index.decontaminate(who, items, id_col="who").where("contaminated").select(F.col("who.id").alias("bad_id"), F.col("who.key").alias("bad_key")).distinct()
    # The key alone would do; the id keeps texts apart that share it by chance.
    return docs.alias("d").join(bad.alias("b"), (F.xxhash64("d.text", F.col("d.text").isNull()) == F.col("b.bad_key")) & F.col("d.doc_id").eqNullSafe(F.col("b.bad_id")), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text, and a null text keeps its n_chars."""
    masked = pii.spans_of(docs, pii.fit(docs), mask=True)
    out = docs.select(*(masked.alias(c) if c == "text" else _column(c) for c in docs.columns))
    if "n_chars" in docs.columns:
        n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        out = out.select(*(n.alias(c) if c == "n_chars" else _column(c) for c in docs.columns))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, neighbours in id order; null ids first."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", pack)]

#: Cross parsing, the random field and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again; what it stored besides, and its input, are then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = shared_folder(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = folder
    return docs
