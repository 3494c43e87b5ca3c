"""The pipeline from raw documents to packed training sequences.

Every stage is one of the operators of ``eventloom.llm``, over all the rows
that the stage before it kept. All but the last return the columns of
``documents`` and ignore any others. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import keep, table
from eventloom.llm.decontamination import decontaminate
from eventloom.llm.jaccard_join import near_duplicates
from eventloom.llm.line_dedup import dedup_lines
from eventloom.llm.packing import pack_documents
from eventloom.llm.quality_rules import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject.

    A null or empty text has no words and goes. A null id is judged like any
    other and never labelled; rows that repeat a text share its verdict.
    """
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that many documents share.

    Every row stays, one that loses all its lines as the empty text. A null
    text becomes empty. A row without an id neither counts nor loses lines.
    """
    kept = dedup_lines(docs, carry=["lang", "source"])
    n_chars = F.char_length("kept_text").cast("long").alias("n_chars")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every component of near duplicates.

    Texts without words resemble nothing and stay, and so do rows without an
    id. Rows that share an id are one document and go or stay together.
    """
    found = near_duplicates(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.select(*COLUMNS).join(keep(found, "copies"), F.col("doc_id") == F.col("_copy"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null or empty texts, of documents or items, hold and are nothing. Rows
    without an id stay; rows that share one go together.
    """
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a null or empty text is its end id alone, and repeated rows are each packed."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Three of the stages are no SQL; the tests hold the rows against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the written rows of the one before."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
