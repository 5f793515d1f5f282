"""A training-corpus pipeline over the table of documents.

Stages: quality rules, line dedup, near-duplicate removal, benchmark
decontamination, packing. Each takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes every
stage as Parquet to the shared folder of the session and hands the reread table
to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, line_templates, packing, quality_rules, simhash
from plumbline.llm.queries import added, vocabulary
from plumbline.llm.storage import stored, table


# Texts from which on a long passage recurs; the query of line dedup follows its SQL, which has one threshold for all lines.
LONG_DOCS = 2


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, unchanged."""
    return quality_rules.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, ``n_chars`` counted anew; documents of which no word is left go."""
    judged = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("doc_id"), F.col("text"))
    done = line_templates.drop_recurring_lines(judged, long_docs=LONG_DOCS).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontaminate.contamination(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.withColumn("_found", F.size(found)).filter("_found = 0").select(*_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, mixed by source."""
    return packing.pack(docs.select("doc_id", "source", "text"), vocabulary(), added=added())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]

# Fingerprints, alignments and token ids are not expressible; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
