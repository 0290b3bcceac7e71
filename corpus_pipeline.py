"""From raw documents to packed token sequences, in five stages that are written as Parquet one after another.

Every stage reads all that the one before it kept. In all of them ids may be null, repeated or of any type, extra columns
pass through whatever their names, and an empty table gives an empty one. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import curriculum, language_id, packing, quality, simhash
from lexloom.llm.base import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose attention-based quality score is at least 0.3.

    A null text scores like an empty one. Equal texts have equal scores, so repeated rows stay or go together. Without
    labels of both kinds all documents have one score.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(F.col("text"), model) >= 0.3)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cross-parsing by a learned language describes; all of them if no language is learned.

    Null, empty and letterless texts go. A null language teaches nothing and decides nothing. Equal texts stay or go
    together.
    """
    model = language_id.fit(docs)
    return docs if model is None else docs.where(language_id.is_told(F.col("text"), model, spark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that of the smallest id; rows without an id come last.

    Rows of one id with different texts are rows of their own. Ties between rows of an id go to the smaller hash of the
    whole row, and of rows equal in all columns one stays, so reruns agree.
    """
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the curriculum takes it.

    A null source is a source of its own; texts without words are never taken. Ties of position are broken by id.
    """
    mixed = curriculum.curriculum(docs, keep=True)
    return curriculum.training_order(mixed).select("document.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in a sequence. A null text is packed like an empty one."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language identification", keep_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing by curriculum", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned stages can't be said in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
