"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local session that names none."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        require_local(context.master)
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidepanel-"))
        root = context.getCheckpointDir()
    return root


def require_local(master: str) -> None:
    """Other machines cannot see a temporary folder of this one."""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives executor loss.

    Used where several branches of one job start from the same rows.  Runs a job at once.  The
    result may be read for as long as the session lives, so nothing here deletes it; the folder's
    owner removes ``tidepanel-*`` when the session has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidepanel-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
