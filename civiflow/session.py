"""Session construction with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# NTZ timestamps are turned into epoch micros through a cast, so the zone must
# be one without daylight saving. AQE coalesces small shuffle partitions,
# splits skewed join partitions and re-plans joins from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

PARTITION_BYTES = 128 * 1024 * 1024
MIN_PARTITIONS = 200


def build_session(
    app_name: str = "civiflow",
    master: str | None = None,
    extra: dict[str, str] | None = None,
    shuffle_bytes: int | None = None,
) -> SparkSession:
    """Create (or get) a session; ``master`` stays unset on a cluster.

    ``shuffle_bytes`` is the size of the largest shuffle expected. It sets the
    number of shuffle partitions, and with it the slices of range-partitioned
    tables, so that none exceeds what a task holds comfortably; AQE merges them
    where less arrives.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    sized = {}
    if shuffle_bytes is not None:
        sized["spark.sql.shuffle.partitions"] = str(max(MIN_PARTITIONS, -(-shuffle_bytes // PARTITION_BYTES)))
    for key, value in {**SETTINGS, **sized, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
