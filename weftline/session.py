"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution on. Partitions are left to the cluster and to AQE."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
