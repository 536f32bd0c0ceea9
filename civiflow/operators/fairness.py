"""Gaps between subgroups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiflow.operators.metrics import CONFUSION, bin_sums, fold_bins, rates
from civiflow.plans.joins import lookup

GROUP_COLUMNS = ["city", "category", "area"]
SUMS = ["n", "sum_y", "sum_s", "sum_sq", *CONFUSION]


def gap(name: str) -> Column:
    """Largest minus smallest, nulls aside."""
    return F.max(name) - F.min(name)


def fairness_summary(
    predictions: DataFrame, group_columns: list[str] = GROUP_COLUMNS, min_rows: int = 100
) -> DataFrame:
    """Per (model, group column): number of large enough groups and metric gaps.

    Rows are combined to one set of sums per (model, all group values, bin)
    first; only those are repeated per group column. Group values are compared
    without regard to the other columns, so equal area names of two cities are
    one group. A model without any large group gets NULL gaps.
    """
    sums = bin_sums(predictions, ["model", *group_columns])
    values = F.array(
        *[
            F.struct(F.lit(c).alias("group_column"), F.col(c).cast("string").alias("group_value"))
            for c in group_columns
        ]
    )
    by = ["model", "group_column", "group_value"]
    long = sums.select("model", F.inline(values), "bin", *SUMS)
    merged = long.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in SUMS])
    r = rates()
    groups = fold_bins(merged, by).select(
        *by, "n", *[r[m].alias(m) for m in ("precision", "recall", "macro_f1", "fpr", "fnr")], "ece"
    )
    large = F.col("n") >= min_rows
    kept = groups.withColumns({m: F.when(large, F.col(m)) for m in groups.columns if m not in [*by, "n"]})
    return kept.groupBy("model", "group_column").agg(
        F.count_if(large).alias("groups"),
        gap("precision").alias("precision_gap"),
        gap("recall").alias("recall_gap"),
        gap("macro_f1").alias("macro_f1_gap"),
        gap("fpr").alias("false_positive_rate_gap"),
        gap("fnr").alias("false_negative_rate_gap"),
        gap("recall").alias("equal_opportunity_difference"),
        gap("ece").alias("calibration_ece_gap"),
    )


def align_predictions(predictions: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the subgroup columns of the scored rows by key."""
    return lookup(predictions, rows.select(*keys, *[c for c in GROUP_COLUMNS if c not in keys]), keys, "inner")
