"""Corpus pipeline: five stages from documents to packed sequences.

Each stage takes what its predecessor kept, and its decisions take effect: texts that the
quality model rejects go, one of each set of equal texts stays, one of each group of near
copies stays, texts that hold a benchmark item go, and the rest is packed. All stages but the
last return the columns of documents, whatever further ones there are and however they are named;
an empty table passes through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontamination, exact_dedup, near_copies, packing, quality
from logloom.llm.shared import crc_mod, table
from logloom.plans.staging import stage


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more by the model learned from ids whose crc32 mod 4 is not 2.

    Null and empty texts are scored like others; repeated rows and null ids are judged row by row.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"), "quality",
                          usable=lambda doc_id: crc_mod(doc_id, 4) != 2)
    return quality.keep_good(docs, model, 0.7)


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of texts that are equal without blanks: the longest, then the smallest id.

    Null and empty texts are equal; null ids come last; of repeated rows one stays.
    """
    return exact_dedup.keep_one(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts linked by a Jaccard similarity of 0.8 or more over five-word shingles.

    Candidates come from SimHash fingerprints, links are checked exactly. The smallest id stays, null
    ids last; blank and null texts are alike; of repeated rows one stays.
    """
    return near_copies.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to half of its words or more.

    Null and empty texts are clean; repeated rows and null ids are judged row by row.
    """
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048; every row is packed, an empty one as its end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_texts),
    ("exact_dedup", one_of_equals),
    ("simhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", clean_of_benchmark),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the learned and greedy stages; the tests hold them against brute force.
ORACLE_SQL = None
