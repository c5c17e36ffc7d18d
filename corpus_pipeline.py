"""From raw documents to packed sequences: toxic documents go, then repeated lines, near-duplicates and repeated passages, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard, line_dedup, packing, substring_dedup, toxicity
from tessella.llm.common import cut, read, temporary_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts stay; null labels teach nothing; rows are judged one by one, whatever their ids."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go from the later one; a document left without words goes.

    Null and empty texts and rows without an id stay as they are; rows of one id are no earlier documents of each other.
    """
    return measured(line_dedup.without_repeats(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 one row stays, that of the least id.

    Repeated rows are one group; of several texts under one id only those that are near-duplicates go; null and empty texts stay.
    """
    return jaccard.without_near_duplicates(docs, n=5, percent=80)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that an earlier document has go from the later one; a document left without words goes.

    Null and empty texts and rows without an id stay as they are; rows of one id are no earlier documents of each other.
    """
    return measured(substring_dedup.without_repeats(docs, drop_emptied=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. A null or empty text is its end token; rows are packed one by one, whatever their ids."""
    return packing.pack(docs, remembered=100_000)  # the executors' memory is also that of the other stages


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", dedup_substrings),
    ("best_fit_packing", pack),
]

#: Learned scores, alignment, automata and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents; each stage's rows are written and read again, and what it wrote on the way is deleted."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with temporary_tables(spark):
            docs = cut(stage(spark, docs, sf_dir), outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
