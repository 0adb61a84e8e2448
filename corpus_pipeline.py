"""A training corpus from documents: rules, toxicity, near duplicates, personal data, packing.

``STAGES`` are applied one after the other; each is written as Parquet and
read again as the input of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from copse.llm import neardup, packing, pii, quality, toxicity
from copse.llm.batches import free_name, named, table
from copse.session import written

#: Score from which a document is rejected as toxic.
TOXIC = 0.3


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the standard policy."""
    return quality.filtered(docs, quality.STANDARD)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC`` under a lexicon learned from the labelled ones among them."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    box = free_name(docs, "_toxicity")
    rows = toxicity.scored(docs, lexicon, keep=docs.columns, into=box)
    return rows.where(F.col(f"{box}.score") < TOXIC).select(*named(*docs.columns))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicated(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, generalised."""
    return pii.sanitised(docs)


def as_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of bounded length."""
    return packing.packed(packing.pieces(docs))


STAGES = [
    ("quality", by_quality),
    ("toxicity", by_toxicity),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("packing", as_sequences),
]

#: Toxicity learns weights, and packing depends on how items meet: SQL says neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
