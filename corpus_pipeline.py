"""The corpus pipeline: STAGES in order, each on the documents that the one before it kept.

The last stage packs what is left. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import inverted_index, langid, packing, simhash_neardup, toxicity
from readlake.llm.common import learning, table, written
from readlake.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5; the labels of four fifths of the documents are learned from."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), learning("doc_id", 5, 0)))


def keep_identified_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least 0.5."""
    return langid.keep_identified(docs, langid.fit(docs, learning("doc_id", 4, 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

    Fingerprints at most 22 bits apart are found by bit-sliced comparison inside buckets, then whole sets decide: a pair at
    0.8 is found with 0.9999 by calculation, a more similar one more surely.
    """
    return simhash_neardup.deduplicate_similar(docs, least=(4, 5), shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under one word in 20 lies in a 13-word passage of the benchmark."""
    return inverted_index.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=13, one_in=20)


def pack_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, each document ended by id 2."""
    return packing.pack(docs, tokenizer_path(), end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified_languages),
    ("simhash_neardup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_mixture),
]

#: No SQL: learned scores, XXH64 and a tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
