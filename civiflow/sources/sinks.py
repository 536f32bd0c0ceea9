"""Result tables and step manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiflow.functions.columns import finite_or_null
from civiflow.sources.readers import CSV

FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report-sized table as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").options(**CSV).csv(path)


def rounded(df: DataFrame, decimals: int = 4) -> DataFrame:
    """Every fractional column rounded half to even."""
    return df.withColumns(
        {f.name: F.bround(f.name, decimals) for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)}
    )


def save_table(df: DataFrame, path: str, decimals: int = 4) -> None:
    write_csv(rounded(df, decimals), path)


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite numbers become NULL."""
    return df.withColumns(
        {
            f.name: finite_or_null(F.col(f.name))
            for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        }
    )


def manifest(summary: DataFrame, **facts: str) -> DataFrame:
    """One-row audit record: fixed facts and the step's summary rows.

    The summary has one row per city or split, so the array stays small.
    """
    rows = F.sort_array(F.collect_list(F.struct(*summary.columns)))
    return json_safe(summary).agg(rows.alias("outputs")).select(
        *[F.lit(v).alias(k) for k, v in facts.items()], "outputs"
    )


def write_manifest(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    """Write a manifest as JSON, missing values spelled out."""
    if sort_keys:
        df = df.select(*sorted(df.columns))
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
