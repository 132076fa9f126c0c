"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage reads what the stage before wrote. All but the last return the columns of documents. Rows are told apart by
place, not by doc_id: a repeated or null id never takes another text with it. Null texts count as empty, extra columns
are left out, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, packing, quality, simhash, substrings
from ledgerline.llm.common import load, materialise, stage_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, fitted on labels, rejects."""
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (0.8 or more of their five-word runs in common) the document with the smallest id
    stays, one of several equal rows. A null id counts as the largest."""
    return simhash.one_of_similar(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words of 20-word windows that start earlier too; a text that loses words is its kept words, others stay as
    they are (a null one empty). Documents of which nothing is left go."""
    done = substrings.dedup_substrings(docs, carry=["lang", "source", "n_chars"], unchanged=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.filter("n_removed = 0 or n_removed < n_words").withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an 8-word window of a benchmark item."""
    rows = materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")  # stored, so that numbers stay
    found = decontaminate.find_contamination(rows, load(spark, sf_dir, "benchmark"), id_col="row")
    # a stored list has a known size: the join broadcasts it where it is small, and else doesn't
    leaked = materialise(found.filter(F.size("items") > 0).select(F.col("doc_id").alias("row")), "leaked")
    return rows.join(leaked, "row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins of the permitted lengths."""
    return packing.pack_documents(docs.select("doc_id", packing.count_words("text").alias("n_tokens")))


STAGES = [
    ("quality", keep_quality),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_leaked),
    ("packing", pack),
]

#: SQL can't express the classifier; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_output(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
