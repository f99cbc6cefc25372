"""Cutting lineage: reliable checkpoints and tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, where lineage is cut.

    Unset, a temporary folder serves in local mode, where one machine runs everything, and is remembered by the
    context. On a cluster its executors couldn't see such a folder, so there an error asks for the setting.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    named = named or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="predaudit-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Compute the table once, into reliable storage, so a lost executor does not recompute it.

    ``drop_shuffles`` removes the shuffle files of this computation as soon as it has ended; else they stay until the driver collects its garbage.
    """
    shared_dir(df.sparkSession)
    return (_passing(df) if drop_shuffles else df).checkpoint(eager=True)


def _passing(df: DataFrame) -> DataFrame:
    """The same table as a plan that removes its shuffle files when an action on it has ended; a plan keeps what the session says when it is made."""
    conf = df.sparkSession.conf
    former = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        return df.select("*")
    finally:
        if former is None:
            conf.unset(DROP_SHUFFLES)
        else:
            conf.set(DROP_SHUFFLES, former)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write the table under the shared folder and read it back: narrow scans, and its size is known to the optimizer.

    Every call takes a folder of its own, so a repeated or concurrent job never meets the files of another.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
