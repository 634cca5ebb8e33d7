"""Question sets kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "id string, `group` string, question string, expect string, gold_text_anchor string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(qid, grp, question, expect, anchor) of a file or folder; blank lines are skipped, a broken line stops the read."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("id").alias("qid"), F.col("group").alias("grp"), "question", "expect", F.col("gold_text_anchor").alias("anchor"))
