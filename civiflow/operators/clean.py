"""Cleaning rules in their fixed sequence, with the attrition per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiflow.functions.columns import (
    has_final_status,
    has_valid_coordinates,
    hours_between,
    to_double_or_null,
    to_timestamp_or_null,
)
from civiflow.operators.harmonize import DATE_COLUMNS, NUMBER_COLUMNS, TARGET_SCHEMA
from civiflow.plans.joins import lookup
from civiflow.plans.staging import stage

DATE_RULES = ["missing_created_date", "missing_closed_date", "closed_before_created"]
ROW_RULES = ["cancelled_invalid_incomplete_status", "impossible_coordinates"]
RULE = "__rule"
DATE_RULE = "__date_rule"

# The duplicate kept is the earliest; the other columns make that order total.
TIE_ORDER = [
    "created_date", "closed_date", "category", "descriptor", "agency",
    "latitude", "longitude", "area", "status",
]


def coerce_types(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: to_timestamp_or_null(F.col(c)) for c in DATE_COLUMNS}
        | {c: to_double_or_null(F.col(c)) for c in NUMBER_COLUMNS}
    )


def tag_date_rule(df: DataFrame) -> DataFrame:
    """Name of the first date rule a row fails, NULL if it passes all."""
    created, closed = F.col("created_date"), F.col("closed_date")
    failed = (
        F.when(created.isNull(), DATE_RULES[0])
        .when(closed.isNull(), DATE_RULES[1])
        .when(closed < created, DATE_RULES[2])
    )
    return df.withColumn(RULE, failed)


def tag_row_rule(df: DataFrame) -> DataFrame:
    status_ok = F.coalesce(has_final_status(F.col("status")), F.lit(False))
    place_ok = F.coalesce(has_valid_coordinates(F.col("latitude"), F.col("longitude")), F.lit(False))
    return df.withColumn(RULE, F.when(~status_ok, ROW_RULES[0]).when(~place_ok, ROW_RULES[1]))


def drop_duplicates(df: DataFrame, tie_order: list[str] = TIE_ORDER) -> DataFrame:
    """Earliest row per (city, request_id); missing ids are copies of each other.

    Filtering ``row_number() = 1`` lets Spark cut every group down to one row
    per task before the shuffle (WindowGroupLimit), so an id with very many
    copies costs one row per input partition.
    """
    w = Window.partitionBy("city", "request_id").orderBy(*tie_order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def deduplicated(df: DataFrame) -> DataFrame:
    """Rows that pass the date rules, one per id, tagged with the row rule they fail."""
    dated = tag_date_rule(coerce_types(df)).filter(F.col(RULE).isNull()).drop(RULE)
    return tag_row_rule(drop_duplicates(dated))


def frequent_categories(df: DataFrame, minimum: int) -> DataFrame:
    """(city, category) groups with enough rows; a missing category is a category."""
    counts = df.groupBy("city", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= minimum)


def clean(df: DataFrame, min_category_samples: int = 100) -> DataFrame:
    """Cleaned requests with ``resolution_hours``."""
    valid = stage(deduplicated(df).filter(F.col(RULE).isNull()).drop(RULE), "valid")
    return _cleaned(valid, min_category_samples)


def _cleaned(valid: DataFrame, min_category_samples: int) -> DataFrame:
    keep = stage(frequent_categories(valid, min_category_samples), "categories")
    kept = lookup(valid, keep.drop("n"), ["city", "category"], "inner")
    hours = hours_between(F.col("created_date"), F.col("closed_date"))
    return kept.select(*TARGET_SCHEMA, hours.alias("resolution_hours"))


def counted(df: DataFrame, tie_order: list[str] = TIE_ORDER) -> DataFrame:
    """The rows of ``deduplicated`` with the ``copies`` behind each, from one scan.

    Rows that fail a date rule are counted along, one row per city and rule named
    in the column ``__date_rule``. Copies are combined before the shuffle.
    """
    tagged = tag_date_rule(coerce_types(df)).withColumnRenamed(RULE, DATE_RULE)
    dated = F.col(DATE_RULE).isNull()
    rest = [*tie_order, *[c for c in df.columns if c not in (*tie_order, "city", "request_id")]]
    groups = tagged.groupBy("city", F.when(dated, F.col("request_id")).alias("request_id"), DATE_RULE).agg(
        F.min(F.when(dated, F.struct(*rest))).alias("row"), F.count(F.lit(1)).alias("copies")
    )
    return tag_row_rule(groups.select("city", "request_id", DATE_RULE, "copies", "row.*"))


def clean_with_report(df: DataFrame, min_category_samples: int = 100) -> tuple[DataFrame, DataFrame]:
    """Cleaned requests and their attrition report from one scan of the rows."""
    rows = stage(counted(df), "counted")
    passed = rows.filter(F.col(DATE_RULE).isNull() & F.col(RULE).isNull()).drop(DATE_RULE, RULE, "copies")
    return _cleaned(passed, min_category_samples), _report(rows, min_category_samples)


def attrition(df: DataFrame, min_category_samples: int = 100) -> DataFrame:
    """Per city: rows removed by each rule in sequence, and what is left."""
    return _report(counted(df), min_category_samples)


def _report(rows: DataFrame, min_category_samples: int) -> DataFrame:
    # Everything follows from one count table.
    groups = rows.groupBy("city", "category", DATE_RULE, RULE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")
    )

    def total(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    dated = F.col(DATE_RULE).isNull()
    passed = dated & F.col(RULE).isNull()
    small = F.col("n") < min_category_samples
    return groups.groupBy("city").agg(
        F.sum("copies").alias("input_rows"),
        *[total("copies", F.col(DATE_RULE) == r).alias(r) for r in DATE_RULES],
        (total("copies", dated) - total("n", dated)).alias("duplicate_request_id"),
        *[total("n", dated & (F.col(RULE) == r)).alias(r) for r in ROW_RULES],
        total("n", passed & small).alias("category_lt_100"),
        total("n", passed & ~small).alias("output_rows"),
        (F.sum("copies") - total("n", passed & ~small)).alias("total_removed"),
    )


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("city").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("created_date").alias("created_date_min"),
        F.max("created_date").alias("created_date_max"),
        F.min("resolution_hours").alias("resolution_hours_min"),
        F.max("resolution_hours").alias("resolution_hours_max"),
        F.countDistinct("category").alias("categories"),
    )


def write_sorted(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One folder per city, rows in time order over the files of a city."""
    order = order or ["created_date", "request_id"]
    (
        df.repartitionByRange("city", *order)
        .sortWithinPartitions("city", *order)
        .write.partitionBy("city")
        .parquet(path)
    )
