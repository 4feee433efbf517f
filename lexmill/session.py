"""Session helpers: worker import path, durable materialisation and table reading."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it.

    On a cluster whose executors do not share that path, ship the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's ``spark.checkpoint.dir``.

    A folder of our own is set only in local mode where the session names none; on a cluster that is an error, as
    no folder of the driver's machine would do. Old checkpoints go with Spark's own
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, which must be set when the session starts.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if need be."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexmill-checkpoint-"))
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder, not yet there, beside the session's checkpoints; what is written to it stays."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver-supplied table."""
    return ensure_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than the session has cores, such as one small file, dealt over all of them.

    Meant before costly map-only work; a table of enough partitions is left as it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
