"""The corpus pipeline: five stages over documents, each kept as Parquet for the next.

toxicity drops the documents that the factorization machine scores at the threshold or above;
near_duplicates keeps one document of each SimHash component (the smallest id);
decontamination drops documents that hold a benchmark item; pii replaces personal data by its
kind in brackets; packing returns the packed pieces. All but the last return documents' columns.

Edge cases: rows with a null or empty text have no toxic terms, no benchmark item and no personal data, and are
packed as their end id; they are each other's copies, as their fingerprints are all zero. Rows with a null doc_id
stay in near_duplicates, which has no smallest id to keep. Exact copies and repeated rows leave one row, and of a tie
the smallest id stays; texts of any length are treated whole. Other columns come back unchanged, whatever their names
and types. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlake.llm import decontaminate, packing, pii, simhash, toxicity
from lumenlake.llm.common import read, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("pii", redact),
    ("packing", pack),
]

#: A learned score and a sequential packing are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
    return docs
