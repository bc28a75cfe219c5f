"""A training-data pipeline over documents: quality, near-duplicates, benchmark leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscope.llm import decontaminate, mixing, near_duplicates, quality, sharding
from chronoscope.llm.storage import stored

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier accepts (score >= 0.7); it learns from `labels`. Without any
    usable label nothing is known against a document, and all stay."""
    labels = _table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels)
    if model.untrained:
        return docs
    scored = quality.score_quality(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.where(F.col("score") >= quality.ACCEPT).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_duplicates.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_copies(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, shard and slot; copies of a text share a shard."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier, the rounding and the sketches have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", docs)
    return STAGES[-1][1](spark, docs, sf_dir)
