"""Imputation, scaling and one-hot encoding, fitted on training rows only."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiflow.functions.columns import to_double_or_null
from civiflow.operators.features import CATEGORICAL, IDENTITY, TARGETS
from civiflow.plans.joins import lookup
from civiflow.plans.ordered import weighted_quantiles
from civiflow.plans.staging import stage

# The functions over batches travel with the tasks, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INFREQUENT = "__infrequent__"
MISSING = "missing"
NOT_FEATURES = {*IDENTITY, *TARGETS, "split", "y_true", "weight"}

NUMBERS = ("scale", "center", "min_frequency", "by_type", "categorical", "numeric", "fill", "category_fill", "mean", "std", "labels")

# Columns the first-pass pipeline never learns from.
LEAKAGE = {"delayed_resolution", "opened_at", "closed_at", "resolution_days", "source_file"}


def feature_columns(df: DataFrame, excluded: set[str] = NOT_FEATURES) -> list[str]:
    """Every column that is neither identity nor target."""
    return [c for c in df.columns if c not in excluded]


def feature_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """Categorical and numeric feature names."""
    names = feature_columns(df)
    return [c for c in CATEGORICAL if c in names], [c for c in names if c not in CATEGORICAL]


def kinds_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Every column the first-pass pipeline learns from: those that are no numbers, and the numbers."""
    names = feature_columns(df, LEAKAGE | {"y_true", "weight"})
    numeric = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    return [c for c in names if c not in numeric], numeric


def build_xy(df: DataFrame, target: str = "delayed_resolution", drop: set[str] = frozenset()) -> DataFrame:
    """Rows with a known target: the feature columns and the target as an integer."""
    names = feature_columns(df, LEAKAGE | {target} | set(drop))
    return df.dropna(subset=[target]).select(*names, F.col(target).cast("int").alias(target))


def unpivot(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(feature, value) rows of the named columns."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def as_double(df: DataFrame, column: str) -> Column:
    """Number of a column; a column that is one by its type needs no test of its text."""
    c = F.col(f"`{column}`")
    return c.cast("double") if isinstance(df.schema[column].dataType, T.NumericType) else to_double_or_null(c)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``n`` per (feature, value) of the named columns; NULL, also for NaN and text that is no number, is a value.

    Zeros, most of a wide table, are only counted; the rest is combined batch by
    batch before it becomes rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values, counts = [], [], []
            for i, column in enumerate(batch.columns):
                x = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                found, n = np.unique(x[x != 0], return_counts=True)
                zeros = len(x) - int(n.sum())
                if zeros:
                    found, n = np.append(found, 0.0), np.append(n, zeros)
                places.append(np.full(len(n), i, dtype=np.int32))
                values.append(found)
                counts.append(n.astype(np.int64))
            if places:
                parts = [pa.array(np.concatenate(p)) for p in (places, values, counts)]
                yield pa.RecordBatch.from_arrays(parts, names=["i", "value", "n"])

    numbers = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = numbers.mapInArrow(count, "i int, value double, n long")
    names = F.from_json(F.lit(json.dumps(columns)), "array<string>")
    # Numpy has NaN for both missing values and NaN.
    value = F.nullif(F.col("value"), F.lit(float("nan")))
    return parts.groupBy("i", value.alias("value")).agg(F.sum("n").alias("n")).select(F.get(names, "i").alias("feature"), "value", "n")


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median per column; columns without any value are left out."""
    return median_of(value_counts(df, columns))


def median_of(counts: DataFrame) -> DataFrame:
    return weighted_quantiles(counts, ["feature"], "value", {"median": 0.5}).drop("n")


def column_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median per column, and mean and population deviation with that median in place of missing values; one scan of the rows.

    A column without any value has no median, and zeros instead of its values.
    """
    counts = stage(value_counts(df, columns), "counts")
    middle = stage(median_of(counts), "medians")
    filled = lookup(counts, middle, ["feature"]).withColumn("value", F.coalesce("value", "median", F.lit(0.0)))
    means = filled.groupBy("feature").agg(
        F.max("median").alias("median"), F.sum("n").alias("rows"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        (F.min("value") == F.max("value")).alias("constant"),
    )
    both = lookup(filled.drop("median"), stage(means, "means"), ["feature"])
    apart = F.col("value") - F.col("mean")
    spread = F.sqrt(F.sum(apart * apart * F.col("n")) / F.max("rows"))
    # Rounding must not give a column of equal values a deviation.
    return both.groupBy("feature").agg(
        F.max("median").alias("median"), F.max("mean").alias("mean"),
        F.when(F.max("constant"), F.lit(0.0)).otherwise(spread).alias("std"),
    )


def imputed(columns: list[str], fill: dict[str, float]) -> dict[str, Column]:
    return {c: F.coalesce(to_double_or_null(F.col(c)), F.lit(fill.get(c, 0.0))) for c in columns}


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of every column, in one row."""
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns]
    )


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per categorical value; NULL is kept as a value."""
    return unpivot(df, columns, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def encoded_levels(
    df: DataFrame, columns: list[str], min_frequency: int, fill: str | dict[str, str] | None = MISSING
) -> DataFrame:
    """Label of every known value: itself, or the shared infrequent one.

    ``fill`` stands for missing values, one for all columns or one for each.
    """
    counts = level_counts(df, columns)
    if fill is not None:
        value = F.lit(fill) if isinstance(fill, str) else F.lit(MISSING)
        for c, v in fill.items() if isinstance(fill, dict) else ():
            value = F.when(F.col("feature") == c, F.lit(v)).otherwise(value)
        counts = counts.withColumn("value", F.coalesce("value", value))
        counts = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    label = F.when(F.col("n") >= min_frequency, F.col("value")).otherwise(INFREQUENT)
    return counts.withColumn("label", label)


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-null value per column, the smallest of equals."""
    counts = level_counts(df, columns).filter(F.col("value").isNotNull())
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("feature", "value")


def class_weights(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Per group and class: balanced weight; and the positive weight of the group."""
    n1 = F.sum(label)
    n = F.count(F.lit(1))
    counts = df.groupBy(*by).agg(n.alias("n"), n1.cast("bigint").alias("positives"))
    pos, neg = F.col("positives"), F.col("n") - F.col("positives")
    return counts.select(
        *by,
        "n",
        "positives",
        (F.col("n") / (F.lit(2.0) * F.nullif(pos, F.lit(0)))).alias("weight_1"),
        (F.col("n") / (F.lit(2.0) * F.nullif(neg, F.lit(0)))).alias("weight_0"),
        F.greatest(neg / F.greatest(pos, F.lit(1)), F.lit(1.0)).alias("pos_weight"),
    )


@dataclass
class Preprocessor:
    """Turns feature rows into a ``features`` vector.

    Medians, moments and level counts come from the training rows. Missing
    categories are the value 'missing', or with ``by_type`` the most frequent one
    of their column; columns then are numbers or categories by their data type
    instead of by name. Values below ``min_frequency`` share one
    column; values never seen in training have no column set.
    """

    scale: bool = True
    center: bool = False
    min_frequency: int = 20
    by_type: bool = False
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    fill: dict[str, float] = field(default_factory=dict)
    category_fill: dict[str, str] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    levels: DataFrame | None = None

    def fit(self, train: DataFrame) -> Preprocessor:
        self.categorical, self.numeric = (kinds_by_type if self.by_type else feature_kinds)(train)
        if self.by_type:
            self.category_fill = {r["feature"]: r["value"] for r in most_frequent(train, self.categorical).collect()}
        # One row per column comes back to the driver, and the labels that become columns of the vector.
        facts = {r["feature"]: r for r in column_facts(train, self.numeric).collect()}
        self.fill = {c: r["median"] for c, r in facts.items() if r["median"] is not None}
        if self.scale:
            self.mean = {c: (facts[c]["mean"] if c in facts else 0.0) or 0.0 for c in self.numeric}
            self.std = {c: (facts[c]["std"] if c in facts else 1.0) or 1.0 for c in self.numeric}
        self.levels = stage(encoded_levels(train, self.categorical, self.min_frequency, self.category_fill if self.by_type else MISSING), "levels")
        found: dict[str, list[str]] = {c: [] for c in self.categorical}
        for r in self.levels.select("feature", "label").distinct().collect():
            found[r["feature"]].append(r["label"])
        # The order of Java's strings.
        self.labels = {c: sorted(v, key=lambda x: x.encode("utf-16-be", "surrogatepass")) for c, v in found.items()}
        return self

    @property
    def width(self) -> int:
        return sum(len(v) for v in self.labels.values()) + len(self.numeric)

    def attributes(self) -> dict:
        """Column attributes as MLlib's trees read them: labels are binary, so a rare one can be split on too."""
        labels = self.width - len(self.numeric)
        kinds = {"binary": [{"idx": i} for i in range(labels)], "numeric": [{"idx": i} for i in range(labels, self.width)]}
        return {"ml_attr": {"attrs": kinds, "num_attrs": self.width}}

    def transform(self, df: DataFrame, noted: bool = False) -> DataFrame:
        """Add ``features``: a column for each label of each category, then the numbers.

        Only values that share the infrequent column are joined; the others are their own labels.
        With ``noted`` numbers are scaled but not shifted, so their zeros take no room, and
        the shift is in the column's metadata.
        """
        out, flags = df, {}
        for i, c in enumerate(self.categorical):
            if INFREQUENT in self.labels[c]:
                rare = self.levels.filter((F.col("feature") == c) & (F.col("label") == INFREQUENT))
                rare = rare.select(F.col("value").alias("__v"), F.lit(True).alias(f"__rare_{i}"))
                out = lookup(out.withColumn("__v", self._category(c)), rare, ["__v"]).drop("__v")
                flags[c] = F.col(f"__rare_{i}")
        numbers = [as_double(df, c) for c in self.numeric]
        cells = [self._category(c) for c in self.categorical] + [flags.get(c, F.lit(None).cast("boolean")) for c in self.categorical] + numbers
        labels, fill, shift, scale = self._settings()
        metadata = {"shift": {"first": self.width - len(shift), "values": (shift / scale).tolist()}} if noted else {}
        build = F.arrow_udf(_vectors(labels, fill, 0.0 * shift if noted else shift, scale), VectorUDT())
        return out.select(*[F.col(f"`{c}`") for c in df.columns if c != "features"], build(*cells).alias("features", metadata=metadata))

    def _category(self, c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.category_fill.get(c, MISSING)))

    def _settings(self) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        fill = np.array([self.fill.get(c, 0.0) for c in self.numeric])
        shift = np.array([self.mean[c] if self.scale and self.center else 0.0 for c in self.numeric])
        return [self.labels[c] for c in self.categorical], fill, shift, np.array([self.std[c] if self.scale else 1.0 for c in self.numeric])

    def save(self, spark: SparkSession, path: str) -> None:
        """Store levels and the numbers and labels per column below ``path``."""
        numbers = {k: getattr(self, k) for k in NUMBERS}
        spark.createDataFrame([(json.dumps(numbers),)], "numbers string").coalesce(1).write.parquet(f"{path}/numbers")
        self.levels.write.parquet(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        numbers = json.loads(spark.read.parquet(f"{path}/numbers").first()["numbers"])
        return cls(**numbers, levels=spark.read.parquet(f"{path}/levels"))


def _vectors(labels: list[list[str]], fill: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> Callable[..., pa.Array]:
    """Function from a batch's categories, their infrequent flags and numbers to sparse vectors."""
    known = [pa.array(v, pa.string()) for v in labels]
    rare = [v.index(INFREQUENT) if INFREQUENT in v else -1 for v in labels]
    starts = np.cumsum([0, *[len(v) for v in labels]])
    width = int(starts[-1]) + len(fill)

    def build(*cells: pa.Array) -> pa.Array:
        rows, places, values = [], [], []
        count = len(cells[0])
        for i, names in enumerate(known):
            at = pc.fill_null(pc.index_in(cells[i], names), -1).to_numpy(zero_copy_only=False)
            if rare[i] >= 0:
                at = np.where(pc.fill_null(cells[len(known) + i], False).to_numpy(zero_copy_only=False), rare[i], at)
            row = np.flatnonzero(at >= 0)
            rows.append(row)
            places.append(starts[i] + at[row])
            values.append(np.ones(len(row)))
        for i, column in enumerate(cells[2 * len(known) :]):
            x = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            x = (np.where(np.isnan(x), fill[i], x) - shift[i]) / scale[i]
            row = np.flatnonzero(x)
            rows.append(row)
            places.append(np.full(len(row), starts[-1] + i))
            values.append(x[row])
        row = np.concatenate(rows)
        # Columns were met in ascending order, which a stable sort by row keeps.
        order = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=count))]).astype(np.int32)
        indices = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places)[order].astype(np.int32)))
        entries = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)[order]))
        kind, size = pa.array(np.zeros(count, dtype=np.int8)), pa.array(np.full(count, width, dtype=np.int32))
        return pa.StructArray.from_arrays([kind, size, indices, entries], names=["type", "size", "indices", "values"])

    return build


def starter_preprocessor() -> Preprocessor:
    """The first-pass form: kinds by data type, most frequent categories, centred numbers."""
    return Preprocessor(scale=True, center=True, min_frequency=10, by_type=True)
