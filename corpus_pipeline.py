"""A training corpus from ``documents``: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from limpid.llm.common import drop_staged, staged, table
from limpid.llm.sketch import sifted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


FAMILIAR = 0.75  # of held-out known texts the least has 0.81, of texts in languages not learned the most 0.70


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (null and empty texts too), or whose words are made of affixes and n-grams that no
    learned language has. Null and repeated ids and repeated rows are rows like others; an empty table stays empty."""
    found = language_id.language_id(docs, language_id.fit(docs))
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("familiar") >= FAMILIAR)).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which nothing is left. Null texts become empty and stay, as nothing was taken
    from them; ids and rows are kept as in ``line_dedup``."""
    out = line_dedup.line_dedup(docs)
    kept = out.filter((F.col("_n_dropped") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal texts one row stays: of those with the smallest id, the one with the smallest hash
    of its text. Rows are told apart by id and text, so another text under the same id stays, of rows
    equal in both one does, and copies without id leave one too. Texts without words are linked with nothing."""
    ident = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    # a row goes by what it holds, so no copy of the texts is written to number them
    key = F.unhex(F.substring(F.sha2(F.concat(ident, F.sha2(text, 256)), 256), 1, 32))
    rows = docs.withColumn("_limpid_key", key)
    joined = jaccard_join.jaccard_join(rows, id_col="_limpid_key")
    # the ids of components are keys here: the class of rows, whatever their documents' ids; without words only equal rows are one
    classes = joined.groupBy("_limpid_key").agg(F.min("component_id").alias("_limpid_class"), F.count("*").alias("n"))
    narrow = rows.select("_limpid_key", "doc_id", F.xxhash64(text).alias("h")).groupBy("_limpid_key").agg(F.min("doc_id").alias("doc_id"), F.min("h").alias("h"))
    known = staged(narrow.join(classes, "_limpid_key"), "classes")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "_limpid_key")  # of a class the least id, nulls last
    best = known.groupBy("_limpid_class").agg(F.min_by("_limpid_key", first).alias("_limpid_key"))
    stays = known.join(best.select("_limpid_key", F.lit(True).alias("stays")), "_limpid_key", "left")
    verdicts = staged(stays.select("_limpid_key", "n", F.coalesce("stays", F.lit(False)).alias("stays")), "verdicts")
    drop_staged(known)
    return sifted(rows, "_limpid_key", verdicts).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; an empty table stays empty."""
    found = decontaminate.find_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("_items") == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the blocks they are to be read in, as often as their source's weight asks. Rows without
    a word are never drawn; a null source is a source of its own; an empty table stays empty."""
    return mixing.mix_sources(docs).select(
        *docs.columns, F.col("_weight").alias("weight"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_order").alias("position")
    )


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
]

ORACLE_SQL = None  # language identification and BM25 retrieval are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
