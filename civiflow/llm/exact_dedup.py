"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical without ASCII white space. A Misra-Gries summary
per partition finds the digests that hold many rows; their winners are computed
exactly and broadcast, so those rows never meet in one task. All other digests
go through an ordinary shuffle.

Null text counts as empty. Of equal texts the longest original stays, then the
smallest id (null ids last); of repeated identical rows exactly one stays. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiflow.plans.staging import stage

WHITE = " \t\n\x0b\x0c\r"
COUNTERS = 1023


def normalised(text: str):
    """Column of the text without ASCII white space."""
    c = F.coalesce(F.col(text), F.lit(""))
    for white in WHITE:
        c = F.replace(c, F.lit(white), F.lit(""))
    return c


def misra_gries(counts: dict[str, int], items: Iterator[str], size: int) -> dict[str, int]:
    """Update at most ``size`` counters; each is low by at most n / (size + 1)."""
    for item in items:
        if item in counts:
            counts[item] += 1
        elif len(counts) < size:
            counts[item] = 1
        else:
            for key in [k for k, v in counts.items() if v == 1]:
                del counts[key]
            for key in counts:
                counts[key] -= 1
    return counts


def frequent(rows: DataFrame, key: str, size: int = COUNTERS) -> DataFrame:
    """Candidate heavy values of ``key``: at most size + 1 rows, every value above 2n/(size+1) among them.

    The summed counter of a value is low by n/(size+1) at most, and all counters
    together do not exceed n, which bounds both.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        seen = 0
        for batch in batches:
            values = batch.column(0).to_pylist()
            seen += len(values)
            misra_gries(counts, iter(values), size)
        yield pa.RecordBatch.from_pydict(
            {"value": [*counts, None], "low": pa.array([*counts.values(), 0], pa.int64()), "seen": pa.array([0] * len(counts) + [seen], pa.int64())},
            schema=pa.schema([("value", pa.string()), ("low", pa.int64()), ("seen", pa.int64())]),
        )

    parts = stage(rows.select(key).mapInArrow(summarise, "value string, low long, seen long"), "heavy")
    total = parts.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    summed = parts.where("value is not null").groupBy("value").agg(F.sum("low").alias("low"))
    # A value held by very few rows needs no special path, whatever its share.
    return summed.where(F.col("low") > max(total / (size + 1), 8)).select(F.col("value").alias(key))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, chars."""
    narrow = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.sha2(normalised(text_col).cast("binary"), 256).alias("text_sha256"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    heavy = stage(frequent(narrow, "text_sha256", counters), "heavy_digests")
    rank = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("low_id"), F.bitwise_not("row").alias("low_row"))).alias("best")

    def winners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("text_sha256").agg(rank, F.count("*").alias("group_size"))

    def decide(rows: DataFrame, won: DataFrame) -> DataFrame:
        return rows.join(won, "text_sha256").select(
            "doc_id",
            F.bitwise_not("best.low_id").alias("keep_id"),
            "group_size",
            (F.bitwise_not("best.low_row") == F.col("row")).alias("kept"),
            "text_sha256",
            "chars",
        )

    # At most counters + 1 rows of two small columns, so the hint is bounded.
    hot = narrow.join(F.broadcast(heavy), "text_sha256", "left_semi")
    rest = narrow.join(F.broadcast(heavy), "text_sha256", "left_anti")
    return decide(hot, F.broadcast(stage(winners(hot), "winners"))).unionByName(decide(rest, winners(rest)))


def keep_rows(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` named by ``ids`` (doc_id, text_sha256), each pair once."""
    digest = f"digest_{uuid.uuid4().hex[:8]}"
    order = f"order_{digest}"
    named = ids.select(F.col("doc_id").alias(f"id_{digest}"), F.col("text_sha256").alias(f"sha_{digest}"), F.col("chars").alias(f"n_{digest}"), F.col("copies").alias(f"copies_{digest}"))
    rows = docs.withColumn(digest, F.sha2(normalised("text").cast("binary"), 256)).join(
        named,
        F.col(id_col).eqNullSafe(F.col(f"id_{digest}"))
        & (F.col(digest) == F.col(f"sha_{digest}"))
        & (F.length(F.coalesce("text", F.lit(""))) == F.col(f"n_{digest}")),
    )
    once = rows.where(F.col(f"copies_{digest}") == 1).select(*docs.columns)
    # Only rows repeated under one id need a second look.
    repeated = rows.where(F.col(f"copies_{digest}") > 1).withColumn(
        order, F.row_number().over(Window.partitionBy(id_col, digest).orderBy(F.xxhash64(*docs.columns)))
    )
    return once.unionByName(repeated.where(F.col(order) == 1).select(*docs.columns))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each group of equal texts."""
    groups = exact_groups(docs)
    ids = groups.groupBy("doc_id", "text_sha256", "chars").agg(F.count("*").alias("copies"), F.max("kept").alias("kept"))
    return keep_rows(docs, stage(ids.where("kept"), "kept"))
