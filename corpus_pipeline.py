"""Raw documents to training sequences: language, exact copies, near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeworks.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from plumeworks.llm.queries import table, tokenizer_path
from plumeworks.llm.shared import among, discard, not_among, saved

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: A language's score is 1 where its classifier is sure, 0 where it is sure of the contrary, and 0.5 where it can't tell.
LEAST_SCORE = 0.25


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a row's own _key, in the order of doc_id, nulls last. Only rows that repeat both id and text share one."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("high"), F.xxhash64(F.lit(7), text).alias("low")))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs (with _key) that found keeps; of kept rows that repeat both id and text, one. Only rows that go, and these, travel."""
    marks = saved(found.groupBy("_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "decisions")
    rest = not_among(docs, "_key", marks.select("_key")).select(*DOCUMENT)
    again = marks.filter("kept").select("_key")
    if again.isEmpty():
        return rest
    return rest.union(among(docs, "_key", again).groupBy("_key").agg(F.min(F.struct(*DOCUMENT)).alias("row")).select("row.*"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language's classifier claims. Those without a letter go, and those that every classifier calls foreign with LEAST_SCORE or less; where lang is null it becomes the classifier's."""
    rest = tuple(c for c in DOCUMENT if c != "doc_id")
    found = language_id.identify(docs, carry=rest).filter((F.col("lang_pred") != "und") & (F.col("score") > LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*DOCUMENT)


def one_of_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, rows that repeat both id and text included."""
    docs = keyed(docs)
    return one_of_each(docs, exact_dedup.exact_groups(docs, id_col="_key"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of documents that share four fifths of their five-word shingles."""
    docs = keyed(docs)
    return one_of_each(docs, near_dedup.near_groups(docs, id_col="_key", shingle=5, percent=80))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    docs = keyed(docs)
    gone = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), id_col="_key").filter("contaminated").select("_key").distinct()
    return not_among(docs, "_key", saved(gone, "contaminated")).select(*DOCUMENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer=tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_exact_copies),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the kernel classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input; a stage's table goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
