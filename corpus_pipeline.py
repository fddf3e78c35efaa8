"""The corpus pipeline: quality rules, near-duplicates, suffix dedup, personal data, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``. Each stage works on everything that the one
before kept. Texts that the suffix stage empties go on as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftmap.llm import neardup, packing, pii, quality, suffix
from driftmap.llm._common import shared_path
from driftmap.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules or the compression bands reject go."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, one with the smallest doc_id; five words, similarity 0.8."""
    return neardup.first_of_each(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that an earlier document or passage has go from the texts; n_chars follows."""
    return suffix.without_repeats(docs, length=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind; n_chars follows."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids along related documents: one row for each piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2, 4096)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("suffix dedup", repeated_passages),
    ("personal data", personal_data),
    ("packing", packed),
]
#: SQL can express neither zstandard's ratios nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
