"""From raw documents to training-order token shards: five stages, each an operator of quernstone.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import common, decontamination, mixing, quality_classifier, simhash_dedup, token_shards

#: Shares of the mix's tokens by domain, the mix's tokens as a multiple of its input's, and the smallest rate. What has come so far has passed the quality
#: classifier: to reach the shares by dropping what looks like another domain would drop clean documents too, so the mix only adds copies.
MIX, GROWTH, LEAST = {"q1t0": 0.98, "q1t1": 0.01, "q0t0": 0.007, "q0t1": 0.003}, 1.15, 1.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    common.small_batches(spark)
    return quality_classifier.good_ones(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    common.small_batches(spark)
    return simhash_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say. The classifier learns from the labelled ones among all documents, as those kept are nearly all of one domain."""
    labels = mixing.quality_domains(common.table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labels, MIX, GROWTH, common.table(spark, sf_dir, "documents"), LEAST)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences at their slots."""
    common.small_batches(spark)
    return token_shards.training_order(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("token_shards", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written and read again, as the next one's documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
