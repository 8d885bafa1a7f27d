"""The corpus pipeline: five of the training-data operators, one after another.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybar.llm import decontaminate, mixing, quality, radix_dedup, simhash
from tallybar.llm.common import materialize, read_table

#: A passage that repeats in this many bytes is cut out: about forty words, so that one of over fifty words is caught.
PASSAGE = 240


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is at least as likely as not; fitted on the labelled among docs."""
    return quality.kept(docs, quality.train(spark, docs, read_table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id (nulls last), of each group of linked texts.

    Linked are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return simhash.one_of_each(spark, docs, shingle=5, similarity=0.8, null_ids_stay=False)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too."""
    return radix_dedup.without_repeats(spark, docs, window=PASSAGE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.drop_contaminated(spark, docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the training position of its first copy; the order of all copies is written."""
    return mixing.mix_in_order(spark, docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Fingerprints, the classifier and the cuts have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes a table that the next one reads."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
