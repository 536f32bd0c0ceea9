"""Chronological splits, pooled splits and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiflow.plans.joins import lookup
from civiflow.plans.ordered import cut_keys, first_n

ID_KEY = "__id_key"
TIME_ORDER = ["created_date", ID_KEY]


def _tagged(df: DataFrame) -> DataFrame:
    # Missing ids sort last.
    return df.withColumn(ID_KEY, F.struct(F.col("request_id").isNull(), F.col("request_id")))


def time_split(
    df: DataFrame,
    cities: list[str],
    external: str | None = None,
    train_fraction: float = 0.70,
    val_fraction: float = 0.15,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: train, val, test by time within each participating city.

    The external city is kept whole as ``external_test``; other cities are left
    out. Only the two boundary keys per city are looked up and rows are labelled
    where they are, so no row is numbered or moved. ``keys`` has the city, time and
    id of the same rows, where they are cheaper to read than ``df``.
    """
    wanted = [*cities, external] if external else list(cities)
    rows = _tagged(df.filter(F.col("city").isin(wanted)))
    looked = _tagged(df if keys is None else keys).filter(F.col("city").isin(cities))
    positions = {
        "__train_end": lambda n: F.floor(n * F.lit(train_fraction)),
        "__val_end": lambda n: F.floor(n * F.lit(train_fraction + val_fraction)),
    }
    cuts = cut_keys(looked, ["city"], TIME_ORDER, positions, repeated=True)
    key = F.struct(*TIME_ORDER)

    def before(cut: str) -> Column:
        return F.col(cut).isNull() | (key < F.col(cut))

    part = F.when(before("__train_end"), "train").when(before("__val_end"), "val").otherwise("test")
    if external:
        part = F.when(F.col("city") == external, "external_test").otherwise(part)
    joined = lookup(rows, cuts, ["city"])
    return joined.withColumn("split", part).drop("__train_end", "__val_end", ID_KEY)


def pooled(split: DataFrame, cities: list[str], name: str) -> DataFrame:
    """Same-named splits of the participating cities together."""
    return split.filter((F.col("split") == name) & F.col("city").isin(cities))


def write_pooled(split: DataFrame, cities: list[str], name: str, path: str) -> None:
    """One pooled split as files in the order of time, city and id."""
    order = ["created_date", "city", "request_id"]
    rows = pooled(split, cities, name)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def pooled_summary(split: DataFrame, cities: list[str]) -> DataFrame:
    """Per pooled split: rows, time range, label rate and the rows of each city, from one scan."""
    by_city = split.filter(F.col("city").isin(cities)).groupBy("split", "city").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("created_date").alias("first"),
        F.max("created_date").alias("last"),
        F.sum("delayed").alias("delayed"),
        F.count("delayed").alias("known"),
    )
    return by_city.groupBy("split").agg(
        F.sum("rows").alias("rows"),
        F.min("first").alias("created_date_min"),
        F.max("last").alias("created_date_max"),
        (F.sum("delayed") / F.nullif(F.sum("known"), F.lit(0))).alias("delayed_rate"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("city", "rows")))).alias("city_rows"),
    )


def split_summary(split: DataFrame, by: list[str] | None = None) -> DataFrame:
    return split.groupBy(*(by or ["city", "split"])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("created_date").alias("created_date_min"),
        F.max("created_date").alias("created_date_max"),
        F.avg("delayed").alias("delayed_rate"),
    )


def sample_rows(df: DataFrame, by: list[str], limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows per group, chosen by the digest of seed and id.

    Groups below the limit are kept whole. Any engine with md5 picks the same rows.
    """
    hashed = _tagged(df).withColumn("__hash", F.md5(F.concat_ws(":", F.lit(seed), F.col("request_id").cast("string"))))
    return first_n(hashed, by, ["__hash", *TIME_ORDER], limit).drop("__hash", ID_KEY)


def first_in_time(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The ``limit`` earliest rows of each group."""
    return first_n(_tagged(df), by, TIME_ORDER, limit).drop(ID_KEY)
