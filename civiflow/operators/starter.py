"""First-pass preparation with aliased column names and a fixed delay threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiflow.functions.columns import day_of_week, days_between
from civiflow.functions.names import snake_case_columns

# Aliases and the name each stands for.
ALIASES = {
    "created_date": "opened_at",
    "creation_date": "opened_at",
    "open_date": "opened_at",
    "requested_datetime": "opened_at",
    "closed_date": "closed_at",
    "closure_date": "closed_at",
    "resolved_at": "closed_at",
    "completion_date": "closed_at",
    "service_request_type": "request_type",
    "complaint_type": "request_type",
    "type_of_service_request": "request_type",
    "zip": "zip_code",
    "zipcode": "zip_code",
    "postal_code": "zip_code",
}
DELAY_DAYS = 30


def canonical_columns(df: DataFrame) -> DataFrame:
    """Snake-case names, aliases renamed; columns meeting in one name are coalesced."""
    normal = snake_case_columns(df)
    sources: dict[str, list[str]] = {}
    for c in normal.columns:
        sources.setdefault(ALIASES.get(c, c), []).append(c)
    rank = {name: i for i, name in enumerate(ALIASES)}
    return normal.select(
        *[
            F.coalesce(*[F.col(c) for c in sorted(cs, key=lambda c: rank.get(c, -1))]).alias(name)
            for name, cs in sources.items()
        ]
    )


def with_utc_times(df: DataFrame, columns: tuple[str, ...] = ("opened_at", "closed_at")) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("timestamp") for c in columns if c in df.columns})


def with_resolution_days(df: DataFrame) -> DataFrame:
    missing = sorted({"opened_at", "closed_at"} - set(df.columns))
    if missing:
        raise KeyError(f"resolution days need the columns {missing}")
    return df.withColumn("resolution_days", days_between(F.col("opened_at"), F.col("closed_at")))


def with_fixed_delay_label(df: DataFrame, days: int = DELAY_DAYS) -> DataFrame:
    """NULL where the duration is unknown."""
    if "resolution_days" not in df.columns:
        df = with_resolution_days(df)
    known = F.col("resolution_days")
    return df.withColumn("delayed_resolution", F.when(known.isNotNull(), (known > days).cast("byte")))


def with_opened_calendar(df: DataFrame) -> DataFrame:
    if "opened_at" not in df.columns:
        return df
    opened = F.col("opened_at")
    return df.withColumns(
        {
            "opened_year": F.year(opened),
            "opened_month": F.month(opened),
            "opened_dayofweek": day_of_week(opened),
            "opened_hour": F.hour(opened),
        }
    )


def prepare(df: DataFrame) -> DataFrame:
    return (
        df.transform(canonical_columns)
        .transform(with_utc_times)
        .transform(with_resolution_days)
        .transform(with_fixed_delay_label)
        .transform(with_opened_calendar)
    )
