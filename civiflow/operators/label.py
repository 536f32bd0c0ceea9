"""Delay labels against exact upper-quartile thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiflow.functions.columns import routing_target
from civiflow.plans.joins import lookup
from civiflow.plans.ordered import exact_quantiles
from civiflow.plans.staging import stage

GROUP = ["city", "category"]


def delay_thresholds(cleaned: DataFrame) -> DataFrame:
    """Upper quartile of the resolution time per (city, category), with the rows behind it."""
    return exact_quantiles(cleaned, GROUP, "resolution_hours", {"delay_threshold_hours": 0.75})


def with_routing_target(df: DataFrame) -> DataFrame:
    return df.withColumn("service_routing_target", routing_target(F.col("agency"), F.col("category")))


def label(cleaned: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Add threshold, ``delayed`` (strictly above it) and the routing target.

    Thresholds have one row per (city, category), so the join cannot add rows.
    """
    if thresholds is None:
        thresholds = delay_thresholds(cleaned)
    joined = lookup(cleaned, stage(thresholds, "thresholds").drop("n"), GROUP)
    late = F.coalesce(F.col("resolution_hours") > F.col("delay_threshold_hours"), F.lit(False))
    return with_routing_target(joined.withColumn("delayed", late.cast("int")))


def labeling_summary(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("city").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("delayed").alias("delayed_positive"),
        F.avg("delayed").alias("delayed_rate"),
        # Counted with missing categories, which have a threshold of their own.
        (F.countDistinct("category") + F.max(F.col("category").isNull().cast("int"))).alias(
            "threshold_groups"
        ),
        F.countDistinct("service_routing_target").alias("service_routing_target_classes"),
        F.min("delay_threshold_hours").alias("threshold_min"),
        F.max("delay_threshold_hours").alias("threshold_max"),
    )
