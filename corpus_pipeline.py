"""A corpus pipeline over ``documents``: five stages, each by one corpus operator.

A stage takes all that the stage before it kept, and what it decides takes
effect: documents go, lose words, or lose secrets. Between stages the documents
stand as Parquet in the shared folder, so that a lost executor costs no more than
the stage it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import language_id, near_dedup, packing, secret_scan, substring_dedup
from quarryline.llm.common import remove_path, shared_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosines of random texts are smaller; those of texts of a word or two are not.
LEAST_COSINE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; those without a letter or unlike any language go.

    Where no document tells its language, none can be learned: all with a letter stay.
    """
    prototypes = language_id.train(docs)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    judged = language_id.predict(docs, prototypes, keep=COLUMNS[1:])
    kept = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_COSINE))
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return near_dedup.one_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that documents with smaller ids have; those with no word left go."""
    cut = substring_dedup.remove_repeats(docs, keep=COLUMNS[2:4]).where("n_removed < n_words")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    clean = docs.withColumn("text", secret_scan.redact("text"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into token sequences."""
    return packing.packed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("sequences", sequences),
]

#: Tokenising, signatures and learned languages have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)  # the next one stands whole
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
