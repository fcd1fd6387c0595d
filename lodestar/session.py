"""Sessions with the settings that the operators are written for; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(name: str = "lodestar", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config(map=DEFAULTS | conf)
    b = b.master(master) if master else b
    b = b.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else b
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
