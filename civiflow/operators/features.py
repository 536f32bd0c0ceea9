"""Features known when a request is created."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiflow.functions.columns import day_of_week, grid, is_weekend
from civiflow.operators.tfidf import TfidfModel
from civiflow.operators.workload import with_trailing_counts

# The functions over batches travel with the tasks, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Feature column names, in order.
BASE_FEATURES = [
    "city", "category", "descriptor", "agency", "area", "hour", "day_of_week", "month",
    "is_weekend", "latitude_grid", "longitude_grid", "area_request_count_7d",
    "category_request_count_7d", "agency_request_count_7d",
]
IDENTITY = ["request_id", "created_date"]
TARGETS = ["delayed", "service_routing_target"]
CATEGORICAL = ["city", "category", "descriptor", "agency", "area"]
NUMERIC = [c for c in BASE_FEATURES if c not in CATEGORICAL]
FEATURE_COLUMNS = [*IDENTITY, *BASE_FEATURES, *TARGETS]
WORKLOAD = {k: f"{k}_request_count_7d" for k in ("area", "category", "agency")}


def with_calendar(df: DataFrame) -> DataFrame:
    created = F.col("created_date")
    return df.withColumns(
        {
            "hour": F.hour(created),
            "day_of_week": day_of_week(created),
            "month": F.month(created),
            "is_weekend": is_weekend(created),
        }
    )


def with_grid(df: DataFrame, precision: int = 2) -> DataFrame:
    return df.withColumns(
        {
            "latitude_grid": grid(F.col("latitude"), precision),
            "longitude_grid": grid(F.col("longitude"), precision),
        }
    )


def with_workload(df: DataFrame, days: int = 7) -> DataFrame:
    return with_trailing_counts(df, ["city"], WORKLOAD, "created_date", days)


def fit_descriptor_model(
    labeled: DataFrame, cities: list[str], min_df: int = 10, max_features: int = 100
) -> TfidfModel:
    """TF-IDF vocabulary of the participating cities only."""
    return TfidfModel.fit(labeled.filter(F.col("city").isin(cities)), "descriptor", min_df, max_features)


def engineer(labeled: DataFrame, model: TfidfModel | None = None, precision: int = 2) -> DataFrame:
    """Feature table; pass a staged or stored table, it is read more than once."""
    base = with_grid(with_calendar(with_workload(labeled)), precision).select(
        *FEATURE_COLUMNS
    )
    return model.with_columns(base, "descriptor") if model else base


def feature_summary(features: DataFrame) -> DataFrame:
    """Per city: rows, columns, label rate and the largest workloads."""
    return features.groupBy("city").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(features.columns)).cast("bigint").alias("columns"),
        F.avg("delayed").alias("delayed_rate"),
        F.countDistinct("service_routing_target").alias("service_routing_target_classes"),
        *[F.max(c).alias(f"max_{c}") for c in WORKLOAD.values()],
    )


def column_totals(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group and column: rows other than zero and the total. A task adds up its batches, so a cell does not become a row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).dictionary_encode(null_encoding="encode")
            names, group = groups.dictionary.to_pylist(), groups.indices.to_numpy()
            met = np.zeros((3, len(names), len(columns)))
            for i, column in enumerate(batch.columns[1:]):
                x = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                known = np.ones(len(x), dtype=bool)
                if column.null_count:
                    known = column.is_valid().to_numpy(zero_copy_only=False)
                    x = np.where(known, x, 0.0)
                met[0, :, i] = np.bincount(group, x != 0, len(names))
                met[1, :, i] = np.bincount(group, x, len(names))
                met[2, :, i] = np.bincount(group, known, len(names))
            for j, name in enumerate(names):
                sums[name] = sums.get(name, 0.0) + met[:, j]
        for name, (n, total, known) in sums.items():
            cells = [pa.array([name] * len(n), pa.string()), pa.array(np.arange(len(n), dtype=np.int32))]
            cells += [pa.array(n.astype(np.int64)), pa.array(total), pa.array(known.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cells, names=[by, "i", "n", "total", "known"])

    numbers = [F.col(f"`{c}`") for c in columns]
    numbers = [c.cast("double") if isinstance(df.schema[n].dataType, T.DecimalType) else c for c, n in zip(numbers, columns)]
    cells = df.select(F.col(by).cast("string").alias(by), *[c.alias(f"c{i}") for i, c in enumerate(numbers)])
    parts = cells.mapInArrow(add, f"`{by}` string, i int, n long, total double, known long")
    sums = parts.groupBy(by, "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("known").alias("known"))
    feature = F.get(F.from_json(F.lit(json.dumps(columns)), "array<string>"), "i").alias("feature")
    return sums.select(by, feature, "n", F.when(F.col("known") > 0, F.col("total")).alias("total"))
