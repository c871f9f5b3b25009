"""The corpus pipeline: five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm import decontaminate, langid, mixing, sharding, simhash
from tidalframe.llm.common import documents, scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell; it learns from the labelled folds of ``docs``."""
    model = langid.fit(langid.training_rows(docs))
    judged = langid.identify_languages(docs, model)
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= langid.LEAST_SCORE)
    return judged.where(sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id."""
    return simhash.one_of_each(docs).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark passages are cut out of the others."""
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    kept = judged.where(~F.col("contaminated"))
    cut = F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("text"))
    kept = kept.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))).withColumn("text", cut)
    return kept.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for."""
    out = mixing.copies(mixing.mix_sources(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard of near equal bytes, and their place in it."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: A trained network and connected components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written and read again as the next one's."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, "stage-" + name.split()[0].lower())
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
