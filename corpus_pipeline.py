"""The corpus pipeline: language ID, quality rules, near duplicates, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of documents.
Rows are what counts, not ids: rows whose doc_id is null or repeated go through every stage as any other does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.llm import jaccard, langid, packing, quality, secrets
from veladura.llm.base import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which a language is given; learned from all rows with a language. Rejected are those that get `und`: null
    texts and texts without a letter. Where nothing could be learned every document is rejected."""
    sample = langid.fit(docs, F.lit(True))
    return langid.identify(docs, sample).where(F.col("lang_pred") != "und").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the reference of a language, references learned from all rows."""
    return quality.judged(docs, quality.fit(docs)).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links connect, that of the smallest doc_id (rows without one last, then by a hash of the
    text; of rows equal in both any one). Rows without words are linked with nothing and stay, each of them, also where they
    repeat. Rows are known by id and text, in one way for tables with and without ids."""
    groups = jaccard.grouped(docs.select("doc_id", "text")).where("group IS NOT NULL")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    first = groups.groupBy("group").agg(F.min(key).alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.t1").alias("__t1"), F.col("first.t2").alias("__t2"))
    times = groups.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1")
    kept = first.join(times, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")), "left")
    kept = written(kept.select("__id", "__t1", "__t2", F.col("n").isNotNull().alias("__repeats")), "nd-kept")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).withColumns(dict(zip(("__h1", "__h2"), jaccard.text_hashes(F.col("text")), strict=True)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__t1")) & (F.col("__h2") == F.col("__t2"))
    once = rows.join(kept.where(~F.col("__repeats")), same).select(docs.columns)
    again = rows.join(kept.where("__repeats"), same).dropDuplicates(["__id", "__t1", "__t2"]).select(docs.columns)
    return once.unionByName(again).unionByName(docs.where(~worded))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by its kind in brackets; n_chars follows. Null texts stay null."""
    rows = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return rows
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids, the end id after each document."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack),
]
#: SQL has no suffix automata, trained references or subset-sum packing; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder; every stage's result is a table of the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
