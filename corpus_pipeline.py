"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs and only drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.common import table, written
from ridgeline.llm.decontaminate import drop_contaminated
from ridgeline.llm.exact_dedup import drop_copies
from ridgeline.llm.language_id import keep_known_languages, learn_levels
from ridgeline.llm.near_dedup import keep_one_of_each
from ridgeline.llm.packing import pack_documents


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that resemble no language learned from docs itself."""
    prototypes, levels = learn_levels(docs)
    return keep_known_languages(docs, prototypes, levels=levels)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at five-word shingles and a Jaccard of 0.8."""
    return keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: Language ID and packing are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
