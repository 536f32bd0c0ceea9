"""Exact order statistics without a single-task sort.

Everything here rests on a two-level prefix sum. Rows, already combined to one
per distinct key, are range-partitioned by (group, order), which cuts a heavy
group into many slices. Slice totals are a table of at most groups + slices
rows; its running sums are the offsets of the running sums inside each slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiflow.plans.joins import lookup
from civiflow.plans.staging import stage

SLICE = "__slice"


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Add ``before_x`` (strictly earlier keys), ``upto_x`` and ``total_x`` for each x.

    ``df`` has one row per (group, order). The slice number is staged with the
    rows, so both levels see the same slices.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn(SLICE, F.spark_partition_id())
    rows = stage(ranged, "slices")
    totals = rows.groupBy(*group, SLICE).agg(*[F.sum(x).alias(f"__s_{x}") for x in sums])
    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    # One struct key serves the join and the window alike, so the rows are
    # shuffled once; struct equality lets null groups match each other.
    key = F.struct(*group, SLICE)
    offsets = totals.select(
        key.alias("__offset_key"),
        *[F.coalesce(F.sum(f"__s_{x}").over(earlier), F.lit(0)).alias(f"__o_{x}") for x in sums],
        *[F.sum(f"__s_{x}").over(whole).alias(f"total_{x}") for x in sums],
    )
    keyed = rows.withColumn("__key", key)
    joined = keyed.join(offsets, F.col("__key") == F.col("__offset_key"), "inner")
    inside = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumns({f"upto_{x}": F.col(f"__o_{x}") + F.sum(x).over(inside) for x in sums})
    joined = joined.withColumns({f"before_{x}": F.col(f"upto_{x}") - F.col(x) for x in sums})
    return joined.drop(SLICE, "__key", "__offset_key", *[f"__o_{x}" for x in sums])


def quantile_columns(
    value: str, probs: dict[str, float], upto: str = "upto_n", total: str = "total_n"
) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates and final expressions for linearly interpolated quantiles.

    Applied to the output of ``running_sums`` grouped as before: the value at
    0-based rank r is the least one whose running count exceeds r.
    """
    aggs, finals = [], {}
    for i, (name, p) in enumerate(probs.items()):
        rank = (F.col(total) - 1) * F.lit(float(p))
        aggs += [
            F.min(F.when(F.col(upto) > F.floor(rank), F.col(value))).alias(f"__lo{i}"),
            F.min(F.when(F.col(upto) > F.ceil(rank), F.col(value))).alias(f"__hi{i}"),
            F.max(rank - F.floor(rank)).alias(f"__t{i}"),
        ]
        lo, hi, t = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__t{i}")
        finals[name] = lo + (hi - lo) * t
    return aggs, finals


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group, and the ``n`` values behind them.

    Null values are left out, and so are groups that have nothing else.
    """
    return weighted_quantiles(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")), group, value, probs)


def weighted_quantiles(counts: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The same from one row per (group, value) with the rows ``n`` that have it."""
    known = running_sums(counts.filter(F.col(value).isNotNull()), group, [value], ["n"])
    aggs, finals = quantile_columns(value, probs)
    folded = known.groupBy(*group).agg(*aggs, F.max("total_n").alias("n"))
    return folded.select(*group, *[e.alias(n) for n, e in finals.items()], "n")


def cut_keys(
    df: DataFrame,
    group: list[str],
    order: list[str],
    positions: dict[str, Callable[[Column], Column]],
    repeated: bool = False,
) -> DataFrame:
    """Order key found at given 0-based positions of each group.

    ``positions`` maps an output name to a function of the group's row count.
    The result has one row per group and one struct column per name, NULL where
    the position lies outside the group. ``repeated`` says that many rows share a
    value of the first order column: those values are looked up first, from their
    counts, and the rest of the key only among the rows with the values found.
    """
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), f(F.col("total")).cast("bigint").alias("at")) for name, f in positions.items()]
    )
    first, *rest = order
    if repeated and rest:
        coarse = _located(df, group, [first], lambda sums: sums.withColumn("wanted", wanted))
        value = [*group, first]
        asked = stage(coarse.groupBy(*value).agg(F.collect_list(F.struct("name", "at")).alias("wanted")), "asked")
        near = lookup(df, asked.select(*value), value, "left_semi")
        found = _located(near, value, rest, lambda sums: lookup(sums, asked, value))
    else:
        found = _located(df, group, order, lambda sums: sums.withColumn("wanted", wanted))
    key = F.struct(*order)
    return stage(
        found.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, key)).alias(name) for name in positions]),
        "cuts",
    )


def _located(df: DataFrame, group: list[str], order: list[str], ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The key at every position that ``ask`` adds to the groups, as an array ``wanted`` of (name, at).

    Gives group, order, name and ``at``, the position among the rows of that key. Keys, combined to one row per distinct
    key, are cut into ranges; row counts of the ranges tell which of them hold a
    position, and only those are looked into. Ranges, targets and the keys found
    are staged tables, so the size of the last is known when it is joined.
    """
    keys = df.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("n"))
    rows = stage(keys.repartitionByRange(*group, *order).withColumn(SLICE, F.spark_partition_id()), "ranges")
    place = F.struct(*group, SLICE).alias("__place")
    totals = rows.groupBy(*group, SLICE).agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    sums = ask(totals.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(upto)}))
    start = F.col("upto") - F.col("n")
    here = F.filter("wanted", lambda w: (w["at"] >= start) & (w["at"] < F.col("upto")))
    held = sums.select(place, start.alias("start"), F.inline(here))
    targets = stage(held.select("__place", "name", (F.col("at") - F.col("start")).alias("at")), "targets")
    inside = Window.partitionBy("__place").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("__place", place).join(targets.select("__place").distinct(), "__place", "left_semi")
    near = near.select("__place", *group, *order, "n", F.sum("n").over(inside).alias("upto"))
    found = near.join(targets, "__place").withColumn("at", F.col("at") - (F.col("upto") - F.col("n")))
    return found.filter((F.col("at") >= 0) & (F.col("at") < F.col("n"))).select(*group, *order, "name", "at")


def first_n(df: DataFrame, group: list[str], order: list[str], limit: Column | int) -> DataFrame:
    """First ``limit`` rows of each group in a total order; ``limit`` may be a column of ``df``.

    The first excluded key is looked up per group, then rows are filtered in
    place: full rows are not moved. A column limit must be constant in a group.
    """
    if isinstance(limit, int):
        positions = {"__end": lambda total: F.lit(limit)}
        keys = group
    else:
        df = df.withColumn("__limit", limit)
        positions = {"__end": lambda total: F.col("__limit")}
        keys = [*group, "__limit"]
    out = lookup(df, cut_keys(df, keys, order, positions), keys)
    return out.filter(F.col("__end").isNull() | (F.struct(*order) < F.col("__end"))).drop("__end", "__limit")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows at positions [offset, offset + limit) of a total order."""
    tagged = df.withColumn("__all", F.lit(1))
    positions = {"__from": lambda total: F.lit(offset), "__to": lambda total: F.lit(offset + limit)}
    bounds = cut_keys(tagged, ["__all"], order, positions)
    key = F.struct(*order)
    inside = (key >= F.col("__from")) & (F.col("__to").isNull() | (key < F.col("__to")))
    return lookup(tagged, bounds, ["__all"], "inner").filter(inside).drop("__all", "__from", "__to")
