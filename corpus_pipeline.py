"""A corpus from raw documents to packed sequences.

Each stage takes what the one before it kept, as it was written and read again; all but the last return the columns of
``documents``. :func:`run` writes each stage to the shared folder, so a later stage never computes an earlier one.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from fairlead.llm import decontaminate, jaccard, lines, packing, quality
from fairlead.llm.common import materialize, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents hold; no document goes, though its text may be empty."""
    return lines.deduplicated_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document of least id stays."""
    return jaccard.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as pieces of packed sequences."""
    return packing.pack_min_slack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: SQL can't express tokenization; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote for itself, and what it read, is removed once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), release(spark, since=sys.maxsize)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since=before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
