"""Small helpers that need the running session: worker imports, shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows are whole texts or blocks of an index, so batches to Python workers are bounded by rows and by bytes; a setting of the user stands.
ROWS, DEFAULT_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
BYTES, DEFAULT_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864", str(4 << 20)
#: Large freed blocks of a worker go back to the system, so a reused worker does not hold what an earlier stage needed.
ALLOCATOR = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from a checkout.

    On a cluster the package is installed or passed with ``--py-files``; the
    extra path entry is then without effect.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, env.get("PYTHONPATH", "")) if p)
    for name, value in ALLOCATOR.items():
        env.setdefault(name, value)
    if spark.conf.get(ROWS) == DEFAULT_ROWS:
        spark.conf.set(ROWS, BATCH_ROWS)
    if spark.conf.get(BYTES).rstrip("b") == DEFAULT_BYTES:
        spark.conf.set(BYTES, BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Only where a local master has no such setting (single-machine tests) a
    temporary folder is used; a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(sc, "_evigrid_dir", None)
        if not base:
            base = sc._evigrid_dir = tempfile.mkdtemp(prefix="evigrid-")
    return f"{base.rstrip('/')}/evigrid-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
