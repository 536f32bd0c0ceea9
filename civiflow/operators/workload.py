"""Trailing request counts per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiflow.functions.columns import MICROS_PER_DAY, epoch_micros
from civiflow.plans.joins import lookup
from civiflow.plans.ordered import running_sums
from civiflow.plans.staging import stage


def trailing_counts(df: DataFrame, base: list[str], kinds: list[str], ts: str, days: int = 7) -> DataFrame:
    """Rows of the same (base, kind value) with ``t - days <= ts < t``.

    One output row per distinct (base, kind, value, ts), with ``n`` rows behind
    it. A row counts from just after its time until just after ``days`` later,
    so the answer at t is the sum of all +n and -n steps before t. The steps are
    swept in (key, time) order by ranges, so neither a key nor a day is tied to
    one task.
    """
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds])
    key = [*base, "kind", "value"]
    points = (
        df.filter(F.col(ts).isNotNull())
        .select(*base, ts, F.inline(values))
        .groupBy(*key, ts)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__t", epoch_micros(F.col(ts)))
    )
    # Where a row's time is the end of another's week, that one still counts: own steps go first.
    steps = F.array(
        F.struct(F.col("__t").alias("__at"), F.lit(0).alias("__end"), F.col("n").alias("step")),
        F.struct((F.col("__t") + F.lit(days * MICROS_PER_DAY)).alias("__at"), F.lit(1).alias("__end"), (-F.col("n")).alias("step")),
    )
    swept = running_sums(points.select(*key, ts, "n", F.inline(steps)), key, ["__at", "__end"], ["step"])
    return swept.filter("__end = 0").select(*key, ts, "n", F.col("before_step").alias("trailing"))


def with_trailing_counts(
    df: DataFrame, base: list[str], names: dict[str, str], ts: str, days: int = 7
) -> DataFrame:
    """Add a trailing count per kind column; ``names`` maps kind to output name.

    The counts of each kind are joined to the rows; those of few values are broadcast.
    """
    table = stage(trailing_counts(df, base, list(names), ts, days), "trailing", ["kind"])
    out = df
    for kind, name in names.items():
        counts = table.filter(F.col("kind") == kind).select(
            *base, F.col("value").alias("__value"), ts, F.col("trailing").cast("int").alias(name)
        )
        out = lookup(out.withColumn("__value", F.col(kind).cast("string")), counts, [*base, "__value", ts]).drop("__value")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in names.values()})
