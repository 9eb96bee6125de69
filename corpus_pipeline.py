"""From raw documents to packed training sequences, one stored stage after the other.

Toxic documents go, then documents that a quality rule rejects, then all but one document of each group of near
copies, then documents that hold a benchmark item; the rest is packed. Every stage works on all that
the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, near_groups, pack_bm25, quality_cascade, toxicity_zstd
from tessella.llm import textkit as K


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """7: documents with a toxicity score of 0.7 or more go."""
    return toxicity_zstd.clean(docs, toxicity_zstd.fit(docs, K.read(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: documents that a rule of the cascade rejects go."""
    return quality_cascade.cascade(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """6: of each group of near copies, the document of the smallest doc_id stays."""
    return near_groups.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: documents with a window like a benchmark item go."""
    return decontaminate.clean(docs, K.read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """2: windows filled with lexical neighbours; a row for each piece."""
    return pack_bm25.retrieval_pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: The stages fit models and follow links; the test compares run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = K.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = K.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
