"""The training-corpus pipeline: five stages over ``documents``, each one's rows the next one's input.

Every function takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. The last adds how often the mix takes each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetscope.llm.common import table
from sheetscope.llm.decontaminate import drop_contaminated
from sheetscope.llm.extendible import drop_exact_duplicates
from sheetscope.llm.jaccard import drop_similar
from sheetscope.llm.mixing import mixed
from sheetscope.llm.toxicity import drop_toxic, train_toxicity
from sheetscope.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic, by a model fitted on the labelled ones among them."""
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of the largest id of each text."""
    return drop_exact_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents towards the sources' target weights, with the words and passes of each."""
    return mixed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the support vector machine of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the rows are written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
