"""From raw documents to a weighted corpus: the stages, in order, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclust.llm import decontaminate, mixing, ngram_join, suffix_dedup, toxicity
from duoclust.llm.common import fresh, table, written

#: Least score of a document that is rejected; weights of the domains of what is kept.
TOXIC, TARGETS = 0.7, {"high": 0.9, "low": 0.1}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is TOXIC or more go."""
    name = fresh("score", docs.columns)
    scored = toxicity.score(docs, toxicity.fitted(spark, docs, sf_dir), name)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard of 0.8 or more on five-word shingles stays."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that stand earlier in the corpus are cut from the texts."""
    return suffix_dedup.clean(docs, length=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, texts and all columns, with tokens, posteriors and the rate of each for the weights of TARGETS."""
    return mixing.weighted(docs, mixing.quality_domains(spark, sf_dir), TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", weigh),
]

#: No SQL states these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", docs)
    return docs
