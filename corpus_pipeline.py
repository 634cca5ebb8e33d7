"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written
as Parquet and read again as the next one's docs.  All stages but the last return
the columns of documents; clean documents stay in every one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid.llm import bpe, decontaminate, near_dup, pii, toxicity
from evigrid.llm.queries import tokenizer_path
from evigrid.session import shared_dir, ship, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay; the labels of the held-out fifth are never read."""
    columns = docs.columns
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine, into=("_score", "_predicted")).where("_predicted = 0").select(*columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group stays."""
    return near_dup.deduplicate(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows the new text."""
    columns = docs.columns
    done = pii.replace(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and of the decoded text."""
    return bpe.round_trip(docs, tokenizer_path(), keep=("lang", "source"), ids="ids")


STAGES = [("toxicity", toxic_out), ("near_dup", copies_out), ("decontaminate", benchmark_out), ("pii", private_out), ("bpe", tokens)]
#: No stage but the filters on words is within SQL's reach; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    ship(spark)
    docs, base = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
