"""Session settings the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide feature projections compile to methods past the JIT's 8,000-byte limit and would
    # then run interpreted; below this limit Spark falls back to per-operator projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Capturing a call site per column expression dominates plan construction.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings.  Shuffle partitions, memory and spark.checkpoint.dir stay with the cluster."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
