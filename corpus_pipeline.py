"""Corpus pipeline: five stages of the training-data operators over `documents`.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the
shared folder and read back as the next one's docs, so a lost executor never
costs more than one stage.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.llm import bloom
from vitrail.llm.exact_dedup import without_copies
from vitrail.llm.language_id import identify_language, train_language_model
from vitrail.llm.ngram_join import ngram_join
from vitrail.llm.packing import pack_documents
from vitrail.llm.scratch import written
from vitrail.llm.suffix_dedup import without_repeats

#: A document goes if its language can't be told at all, or is told with less confidence.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null texts too) and those whose language is a guess.

    Ids are not looked at; rows that repeat are told alike."""
    model = train_language_model(docs)
    told = identify_language(docs, model, prefix="_")
    return told.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays, once.

    Null texts are empty ones; null ids are less than any; a row that repeats
    is one document."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, the one with the smallest doc_id stays.

    Rows without id or words are linked with nothing and stay.  Ids are
    shuffled, texts are not, but for those few that the filters can't settle."""
    linked = written(ngram_join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    told = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_doc"))  # its columns may have any names
    key, their_key, same = F.xxhash64("_doc"), F.xxhash64("_id"), F.col("_doc") == F.col("_id")
    kept, open_ = bloom.settled(told, told.select("_doc"), key, linked, their_key, same, "near-filter")
    return kept.unionByName(open_.join(linked, same, "left_anti")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that start earlier; a document with nothing left, or of null text, goes.

    A row without id loses nothing; rows of one id and text are one document."""
    return (
        without_repeats(docs)
        .where(F.length("text") > 0)
        .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        .select(*docs.columns)
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the remaining documents, in sequences of 2048 tokens; null ids stay null."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("suffix_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: Language ID, components and best fit are beyond SQL; tests/llm hold the
#: pipeline against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
