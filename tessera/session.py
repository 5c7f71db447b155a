"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=CONF | conf)
    return (builder.master(master) if master else builder).getOrCreate()
