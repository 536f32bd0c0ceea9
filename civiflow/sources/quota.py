"""Extract selection by yearly quotas, and checks of extract sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiflow.plans.joins import lookup
from civiflow.plans.ordered import first_n, page
from civiflow.plans.staging import stage


def in_years(df: DataFrame, date: str, first_year: int, last_year: int) -> DataFrame:
    """Rows of the years, up to the last full second of each, with their ``year``."""
    bounds = [
        F.col(date).between(
            F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz"), F.lit(f"{y}-12-31 23:59:59").cast("timestamp_ntz")
        )
        for y in range(first_year, last_year + 1)
    ]
    keep = bounds[0]
    for b in bounds[1:]:
        keep = keep | b
    return df.filter(keep).withColumn("year", F.year(date))


def yearly_quota(df: DataFrame, quotas: DataFrame, source: str, order: list[str]) -> DataFrame:
    """First ``quota`` rows of every (source, year) in a total order."""
    limited = lookup(df, stage(quotas, "quotas"), [source], "inner")
    return first_n(limited, [source, "year"], order, F.col("quota")).drop("quota")


def page_slice(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return page(df, order, offset, limit)


def quota_check(df: DataFrame, quotas: DataFrame, source: str) -> DataFrame:
    """Row count against the quota per source; an extract is reused only if they agree."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("records"))
    joined = lookup(quotas, counts, [source])
    records = F.coalesce("records", F.lit(0).cast("bigint"))
    status = F.when(F.col("records").isNull(), "missing").when(records == F.col("quota"), "verified")
    return joined.select(source, "quota", records.alias("records"), status.otherwise("mismatch").alias("status"))


def require_count(df: DataFrame, expected: int) -> None:
    """Raise unless a written table has the expected number of rows."""
    actual = df.count()
    if actual != expected:
        raise RuntimeError(f"verification mismatch: wrote {expected}, counted {actual}")
