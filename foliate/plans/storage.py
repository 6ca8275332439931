"""Cutting lineage and spreading work.

Everything written here lies in the folder that the cluster names in ``spark.checkpoint.dir``, which all
executors share, so that a lost executor never loses an intermediate table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set (tests, a laptop)."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="foliate-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it from reliable storage from then on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`materialize`, but as a columnar, compressed table, for rows that hold long texts."""
    path = f"{checkpoint_dir(df.sparkSession)}/foliate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores before a costly narrow stage when the input came in fewer pieces than there are cores.

    Large inputs have more splits than cores and pass through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` holds at most ``rows`` rows; looks at no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows
