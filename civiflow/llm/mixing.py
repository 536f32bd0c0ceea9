"""Mixing sources to target weights.

Every document gets a hash-random key; rows are range-sorted by (source, key),
token counts are cumulated by a distributed prefix sum, and each source is cut at
its exact budget, after as many whole epochs as the budget holds.

Null text has size 0. Null source is a source of its own, sorted last. Rows tied
in key are ordered by id and size; repeated rows are separate documents. Empty
tables and sources of size 0 take nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiflow.plans.staging import stage

WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Target per source: weights share out ``share`` of all sizes, capped at ``most`` times a source.

    ``sizes`` has one row per source (source, source_size). The excess of capped
    sources is shared again among the others, one aggregate per pass.
    """
    # One row per source, not per document; the order of sources sets the weights.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    table = stage(sizes.withColumn("weight", weight), "weights")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    for _ in range(10_000):
        full = F.col("weight") * level > most * F.col("source_size")
        capped, free = table.agg(
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        new = (budget - capped) / free if free else level
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("weight") * level, most * F.col("source_size")).alias("target"))


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("key")), "sizes")
    targets = stage(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), share, most), "targets")
    order = ["source", "key", "doc_id", "size"]
    ranged = stage(
        narrow.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id()),
        "ranged",
    )
    # A slice holds a run of each source, so only slice totals are cumulated.
    totals = ranged.groupBy("source", "slice").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(totals.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total"), "bases")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    b, t = base.withColumnsRenamed({"source": "b_source", "slice": "b_slice"}), targets.withColumnRenamed("source", "t_source")
    joined = run.join(b, run.source.eqNullSafe(b.b_source) & (run.slice == b.b_slice)).join(t, F.col("source").eqNullSafe(t.t_source))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("base") - F.col("inside")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: whole documents, once per epoch that takes any of their words.

    Rows under one id share the sum of what is taken of them.
    """
    plan = mix(docs).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.ceil(F.col("taken") / F.col("size")).alias("__times"))
    plan = plan.groupBy("__id", "__size").agg(F.max("__times").alias("__times"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))
    rows = docs.join(plan, docs.doc_id.eqNullSafe(plan["__id"]) & (size == F.col("__size")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)
