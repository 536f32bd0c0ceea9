"""Membership-inference risk from score confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiflow.functions.columns import attack_confidence
from civiflow.operators.split import first_in_time
from civiflow.plans.joins import lookup
from civiflow.plans.ordered import quantile_columns, running_sums
from civiflow.plans.staging import stage

# Threshold quantiles 0.05, 0.10 ... 0.95.
STEP = (0.95 - 0.05) / 18
PROBS = [*(0.05 + i * STEP for i in range(18)), 0.95]


def attack_sample(members: DataFrame, others: DataFrame, member_limit: int | None = None) -> DataFrame:
    """Members (the earliest per model and city, if limited) and non-members together."""
    if member_limit is not None:
        members = first_in_time(members, ["model", "city"], member_limit)
    columns = ["model", "score"]
    return members.select(*columns, F.lit(1).alias("is_member")).unionByName(
        others.select(*columns, F.lit(0).alias("is_member"))
    )


def membership_attack(sample: DataFrame) -> DataFrame:
    """Attack AUC, best accuracy over quantile thresholds and advantage per model."""
    member = F.col("is_member").cast("bigint")
    counts = (
        sample.groupBy("model", attack_confidence(F.col("score")).alias("conf"))
        .agg(F.sum(member).alias("members"), F.sum(1 - member).alias("others"))
        .withColumn("n", F.col("members") + F.col("others"))
    )
    ranked = running_sums(counts, ["model"], ["conf"], ["members", "others", "n"])
    aggs, finals = quantile_columns("conf", {f"q{i}": p for i, p in enumerate(PROBS)})
    pairs = F.col("members") * (F.col("before_others") + F.col("others") / F.lit(2.0))
    facts = ranked.groupBy("model").agg(
        *aggs,
        F.sum(pairs).alias("pairs"),
        F.max("total_members").alias("m"),
        F.max("total_others").alias("o"),
    )
    auc = F.when(
        (F.col("m") > 0) & (F.col("o") > 0),
        F.col("pairs") / (F.col("m").cast("double") * F.nullif(F.col("o"), F.lit(0))),
    )
    thresholds = stage(facts.select("model", "m", "o", auc.alias("auc"), F.array(*finals.values()).alias("q")))
    # One pass over the distinct confidences serves all thresholds.
    judged = lookup(ranked.select("model", "conf", "members", "others"), thresholds, ["model"], "inner")
    right = [
        F.sum(F.when(F.col("conf") >= F.get("q", F.lit(i)), F.col("members")).otherwise(F.col("others")))
        for i in range(len(PROBS))
    ]
    return judged.groupBy("model").agg(
        (F.greatest(*right) / F.max(F.col("m") + F.col("o"))).alias("attack_accuracy"),
        F.max("auc").alias("attack_auc"),
        (F.abs(F.max("auc") - F.lit(0.5)) * 2).alias("attack_advantage"),
    )


def with_risk_reduction(attacks: DataFrame, base_model: str = "FedAvg") -> DataFrame:
    """Percent by which the advantage falls below the base model's.

    The largest advantage stands in for a missing base. One row per model.
    """
    everything = Window.partitionBy(F.lit(1))
    advantage = F.col("attack_advantage")
    base = F.coalesce(
        F.max(F.when(F.col("model") == base_model, advantage)).over(everything),
        F.max(advantage).over(everything),
    )
    fallen = F.lit(100.0) * F.greatest(base - advantage, F.lit(0.0)) / F.greatest(base, F.lit(1e-12))
    return attacks.withColumn("privacy_risk_reduction_pct", F.when(advantage.isNotNull(), fallen))
