"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

toxicity: rows that the model calls toxic go. near_duplicates: of each SimHash component the row with the least
(doc_id, hash of the text) stays, whatever ids other components have. repeats: repeated 400-byte strings are cut out of the texts. secrets:
spans are masked. packing: texts are packed into sequences of 2048 ids.

Every stage keeps null and empty texts; all but the last return the columns that they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import packing, repeats, secrets, simhash, toxicity
from palimpsest.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled rows of ``documents``, held-out fold apart, and judges ``docs``."""
    return toxicity.clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Trained trees, graph components and subword ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder, which cuts the lineage."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
