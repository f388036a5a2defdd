"""The corpus pipeline: stages of the corpus operators, one after the other.

Each stage takes documents of any columns beside doc_id (a whole number of any width, or null) and text (null counts as
empty), and all but the last return the same columns. Repeated rows are documents of their own up to exact dedup. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, packing, quality_rules, suffix_dedup
from tessera.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts with them; failed lines of the others are removed.
    Repeated rows are judged alike."""
    return _counted(quality_rules.clean(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones being equal, the row with the largest doc_id stays; null keys are smaller than
    all others, and of rows equal in both one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, the one with the smallest doc_id, null keys last; rows are told apart
    by key and text. Rows without words all stay."""
    return jaccard_join.keep_one(docs)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are removed from all documents; every row stays, null texts null."""
    return _counted(suffix_dedup.remove(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, with their sequences and places; a null or empty text is the end token alone."""
    return packing.pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of changed texts, where the column is there."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("suffix-array dedup", suffix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs


#: Packing and tokenization have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None
