"""Sessions with the settings that the engine's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI: overflow and bad casts raise.  UTC: timestamps mean the same everywhere.  AQE: partitions are coalesced,
#: skewed joins split and join strategies revised at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session; ``more`` are settings with underscores for dots."""
    b = SparkSession.builder.appName("ferrule")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    for k, v in more.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
