"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    # Weeks, windows and rendered instants are all defined in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Hot projects are split at run time by the adaptive skew join.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows hold whole texts, or a digest of each of their words: by Spark's own limit a Python worker, and the JVM beside it,
    # would hold 64 MB of them several times over.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to an existing session. On a cluster, send the package along with ``--py-files``."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
