"""From documents to packed training batches, in four stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftfield.llm import neardup, packing, quality, toxicity
from driftfield.llm.common import materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the severity model rejects. It is fitted on labelled documents of this stage's input.

    Null and empty texts hold no features and stay; repeated rows stay or go together. With
    labels of one kind only, or none, nothing goes. Columns of any name pass through.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or repeat too much.

    Null and empty texts have no words, so they go; repeated rows stay or go together; an
    empty table stays empty, and columns of any name pass through.
    """
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates, by content: that of the least doc_id.

    Unlike texts of one id are classes of their own. A class without any id keeps a row too;
    null and empty texts are one class; of rows that agree in id and text one stays. An
    empty table stays empty, and columns of any name pass through.
    """
    return neardup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all kept documents into token-budget batches: one row per piece.

    Null and empty texts are a piece of the end token alone; repeated rows are packed as
    often as they occur; an empty table packs into nothing; other columns are not read.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL has neither the fitted model nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
