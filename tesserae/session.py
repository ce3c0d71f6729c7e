"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # row_number() <= K must be cut before the shuffle for the K of a tile (25,000) too
    "spark.sql.optimizer.windowGroupLimitThreshold": "30000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_or_create(name: str = "tesserae") -> SparkSession:
    return configure(SparkSession.builder.appName(name).getOrCreate())
