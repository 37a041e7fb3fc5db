"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import langid, mixing, packing, secrets, simhash
from tallyfold.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, lang being the prediction; those without a letter or of an even guess go."""
    return langid.labelled(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked mixture samples. Its targets move the shares that the documents have only a little, so that
    most documents stay."""
    return mixing.sample(docs, powers=POWERS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' segments in their buckets and batches."""
    return packing.pack(docs)


#: Powers of the shares of sources, languages and topics that give the mixture's targets.
POWERS = (0.9, 0.9, 0.9)
STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix), ("packing", pack)]
#: The first three stages are beyond SQL (fitted models, hashed fingerprints, span replacement): tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
