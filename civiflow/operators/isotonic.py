"""Isotonic calibration without a driver-side or single-task sort.

Scores, combined to one row per distinct value, are range-partitioned. Each slice
is reduced to blocks of rising mean (sum, weight), as pooling of adjacent violators
may start anywhere; blocks of several slices then meet in fewer and fewer tasks.
Only blocks move on, whose number is that of the steps of the fitted curve and not
of the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiflow.plans.joins import lookup
from civiflow.plans.staging import stage

# ``pool`` travels with the tasks, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = "low double, high double, total double, weight double"
# Slices whose blocks meet in one task of the next pass.
MERGE = 8


def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in ascending order, neighbours merged until their means rise."""
    done: list[list[float]] = []
    for batch in batches:
        for low, high, total, weight in zip(batch["low"], batch["high"], batch["total"], batch["weight"]):
            block = [low, high, total, weight]
            while done and done[-1][2] * block[3] >= block[2] * done[-1][3]:
                before = done.pop()
                block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
            done.append(block)
    yield pd.DataFrame(done, columns=["low", "high", "total", "weight"])


def isotonic_blocks(df: DataFrame, score: str, label: str) -> DataFrame:
    """Steps of the non-decreasing curve that fits ``label`` best: low, high, total, weight."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    x = F.col(score).cast("double")
    pooled = known.groupBy(x.alias("low")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    blocks = pooled.select("low", F.col("low").alias("high"), "total", "weight")
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        ranged = blocks.repartitionByRange(slices, "low").sortWithinPartitions("low")
        blocks = stage(ranged.mapInPandas(pool, BLOCK), "blocks")
        if slices == 1:
            return blocks
        slices = max(1, slices // MERGE)


def with_isotonic(df: DataFrame, blocks: DataFrame, score: str, out: str) -> DataFrame:
    """Add the curve's value at ``score``: flat inside a step and beyond the ends, linear between steps.

    Distinct scores and the ends of steps are swept together by ranges, so the
    curve is not sent to every task.
    """
    y = F.col("total") / F.col("weight")
    ends = blocks.select(F.explode(F.array("low", "high")).alias("x"), y.alias("y")).distinct()
    asked = df.select(F.col(score).cast("double").alias("x")).filter("x IS NOT NULL").distinct()
    both = ends.unionByName(asked.withColumn("y", F.lit(None).cast("double")))
    rows = stage(both.repartitionByRange("x").withColumn("slice", F.spark_partition_id()), "sweep")
    knot = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    # One row per slice: the nearest step before and after it.
    edges = rows.groupBy("slice").agg(F.max(knot).alias("last"), F.min(knot).alias("first"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(F.col("slice").alias("s"), F.max("last").over(before).alias("from"), F.min("first").over(after).alias("to"))
    up = Window.partitionBy("slice").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("slice").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns({"a": F.max(knot).over(up), "b": F.min(knot).over(down)}).filter("y IS NULL")
    near = near.join(carried, F.col("slice") == F.col("s"))
    a, b = F.coalesce("a", "from"), F.coalesce("b", "to")
    near = near.select("x", a.alias("a"), b.alias("b"))
    rising = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    value = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (F.col("a.x") == F.col("b.x")), F.col("a.y"))
    curve = stage(near.select(F.col("x").alias("__x"), value.otherwise(rising).alias(out)), "curve")
    return lookup(df.withColumn("__x", F.col(score).cast("double")), curve, ["__x"]).drop("__x")
