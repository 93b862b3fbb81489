"""The corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the
last return the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import exact_dedup, language, mixing, near_copies, packing
from latticework.llm.common import documents, materialize, release, scope


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like no language go."""
    return language.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked by a similarity of 0.8 or more the least doc_id stays."""
    return near_copies.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words each source's target takes: a document once for each pass that takes words of it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language identification", identify_languages),
    ("exact deduplication", drop_exact_copies),
    ("near-deduplication", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL has neither the trigram model nor XXH64 nor byte-pair tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage is written, the one before it and all that the operator wrote on its way are deleted."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scope() as made:
            after = materialize(stage(spark, docs, sf_dir), f"stage-{i}", codec="snappy")
        release(docs, *(x for x in made if x is not after))
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
