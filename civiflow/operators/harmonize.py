"""Differently shaped city extracts mapped onto one schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiflow.functions.columns import (
    blank_to_null,
    first_nonempty,
    to_double_or_null,
    to_timestamp_or_null,
)

# The common schema, in order.
TARGET_SCHEMA = [
    "request_id", "created_date", "closed_date", "status", "category", "descriptor",
    "agency", "latitude", "longitude", "area", "city",
]
TEXT_COLUMNS = ["request_id", "status", "category", "descriptor", "agency", "area", "city"]
DATE_COLUMNS = ["created_date", "closed_date"]
NUMBER_COLUMNS = ["latitude", "longitude"]


@dataclass(frozen=True)
class CityMapping:
    """Where each target column of one city comes from.

    A source is a column name, a list of columns of which the first non-blank
    one counts, or a function of the raw DataFrame returning a Column.
    """

    city: str
    sources: dict[str, str | list[str] | Callable[[DataFrame], Column]]
    timestamp_formats: list[str] = field(default_factory=list)

    def columns(self) -> list[str]:
        """Raw columns worth scanning."""
        names: list[str] = []
        for source in self.sources.values():
            names += [source] if isinstance(source, str) else source if isinstance(source, list) else []
        return list(dict.fromkeys(names))


# Column names of the four public extracts.
CITY_MAPPINGS = {
    "nyc": CityMapping(
        "nyc",
        {
            "request_id": "unique_key",
            "created_date": "created_date",
            "closed_date": "closed_date",
            "status": "status",
            "category": "complaint_type",
            "descriptor": "descriptor",
            "agency": "agency",
            "latitude": "latitude",
            "longitude": "longitude",
            "area": ["community_board", "borough"],
        },
    ),
    "chicago": CityMapping(
        "chicago",
        {
            "request_id": "sr_number",
            "created_date": "created_date",
            "closed_date": "closed_date",
            "status": "status",
            "category": "sr_type",
            "descriptor": "sr_short_code",
            "agency": "owner_department",
            "latitude": "latitude",
            "longitude": "longitude",
            "area": ["community_area", "ward"],
        },
    ),
    "boston": CityMapping(
        "boston",
        {
            "request_id": "case_enquiry_id",
            "created_date": "open_dt",
            "closed_date": "closed_dt",
            "status": "case_status",
            "category": "reason",
            "descriptor": "type",
            "agency": ["subject", "department"],
            "latitude": "latitude",
            "longitude": "longitude",
            "area": ["neighborhood", "ward"],
        },
    ),
    "los_angeles": CityMapping(
        "los_angeles",
        {
            "request_id": "srnumber",
            "created_date": "createddate",
            "closed_date": "closeddate",
            "status": "status",
            "category": "requesttype",
            "descriptor": "actiontaken",
            "agency": "owner",
            "latitude": "latitude",
            "longitude": "longitude",
            "area": ["ncname", "nc", "cd"],
        },
    ),
}


def harmonize(raw: DataFrame, mapping: CityMapping) -> DataFrame:
    """One projection: sources that are absent give NULL, blanks become NULL,
    unparseable dates and numbers become NULL."""

    def source_of(target: str) -> Column:
        source = F.lit(mapping.city) if target == "city" else mapping.sources[target]
        if isinstance(source, Column):
            return source
        if isinstance(source, list):
            return first_nonempty(raw, source)
        if callable(source):
            return source(raw)
        return F.col(source) if source in raw.columns else F.lit(None).cast("string")

    def typed(target: str) -> Column:
        value = source_of(target)
        if target in DATE_COLUMNS:
            return to_timestamp_or_null(value, mapping.timestamp_formats)
        if target in NUMBER_COLUMNS:
            return to_double_or_null(value)
        return blank_to_null(value.cast("string"))

    return raw.select(*[typed(t).alias(t) for t in TARGET_SCHEMA])


def harmonize_all(extracts: dict[str, DataFrame], mappings: dict[str, CityMapping]) -> DataFrame:
    """All cities in one table."""
    parts = [harmonize(raw, mappings[city]) for city, raw in extracts.items()]
    return reduce(DataFrame.unionByName, parts)


def harmonization_summary(df: DataFrame) -> DataFrame:
    """Per city: rows, date range and missing values."""
    return df.groupBy("city").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("created_date").alias("created_date_min"),
        F.max("created_date").alias("created_date_max"),
        F.count_if(F.col("closed_date").isNull()).alias("closed_date_missing"),
        F.count_if(F.col("latitude").isNull()).alias("latitude_missing"),
        F.count_if(F.col("longitude").isNull()).alias("longitude_missing"),
    )
