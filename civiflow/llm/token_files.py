"""Token ids in Parquet list columns.

Documents are range-sorted by id, encoded, and written as one row per document:
part, position in the part, n_tokens and the ids. Ids are delta-encoded 32-bit
integers, row groups are small, and column and offset indexes are written, so
that counts are read without ids and single documents without the rest.

Null text counts as empty and gives the end id alone. Null ids come first;
repeated ids are ordered by text. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiflow.llm.encoding import Encoder, spaced
from civiflow.plans.staging import new_path, stage

ROW_GROUP = 32 * 1024 * 1024
PAGE = 256 * 1024
BATCH = 2048
SCHEMA = "doc_id long, part int, position long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end: int = 0) -> None:
    """Encode ``docs`` into a new folder ``path``, in ascending order of doc_id."""
    tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(slices, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )

    kinds = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("position", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = Encoder(tokenizer_path, spaced, end), 0
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                rows = batch.slice(i, BATCH)
                ids = list(encode(rows.column(1)))
                counts = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(np.concatenate(ids).view("<i4")))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2).cast(pa.int32()), pa.array(np.arange(at, at + len(rows))), pa.array(counts), lists], schema=kinds)
                at += len(rows)

    writer = ordered.mapInArrow(tokens, SCHEMA).write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
    # The second version of the format is what has delta encoding.
    writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#ids.list.element", "false").parquet(path)


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids before each document, to rows with part, position and n_tokens."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per part.
    base = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return run.join(base, F.col("part") == F.col("p")).withColumn("start", F.col("base") + F.col("inside")).drop("p", "base", "inside")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, position, n_tokens and start of each document, without reading ids."""
    return with_starts(spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "position", "n_tokens"))


def documents_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens and ids of chosen documents.

    The files are sorted by doc_id, so the filter leaves out row groups by their
    statistics, and pages of the others by the column index.
    """
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def crc_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the digest of the ids in their place."""
    for batch in batches:
        lists = batch.column(4)
        ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "part", "position", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, which are read once."""
    narrow = spark.read.schema(SCHEMA).parquet(path).mapInArrow(crc_of_ids, "doc_id long, part int, position long, n_tokens long, ids_crc32 long")
    return with_starts(stage(narrow, "digests")).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write ``docs`` and digest what the files hold."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path)
    return digests(docs.sparkSession, path)
