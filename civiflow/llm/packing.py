"""Packing documents into fixed-length token sequences.

Bounded-space online packing: each partition keeps a fixed number of open
windows, puts a piece where it fits best, and emits the fullest window when none
fits. The windows left over are merged in a second pass by the same rule.

Null or empty text is a document of the end id alone. Documents longer than a
sequence are cut into full pieces and a rest. Repeated rows are separate
documents; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiflow.llm.encoding import Encoder, bare, release, spaced  # noqa: F401
from civiflow.plans.staging import stage

LENGTH = 2048
OPEN = 64
# Less memory for words than by default, as packing follows other stages in a pipeline.
STORE = 64 * 1024 * 1024
BLOCK = 3 * 1024 * 1024
MERGE = 64
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECE = ", ".join(f"{c} long" for c in COLUMNS) + ", open boolean"


class Windows:
    """At most ``limit`` open windows; ``add`` returns the one that it closes, if any."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.used = np.zeros(0, dtype=np.int64)
        self.items: list[list] = []

    def add(self, size: int, item) -> list | None:
        fits = np.flatnonzero(self.used + size <= self.length)
        if fits.size:
            best = int(fits[np.argmax(self.used[fits])])
            self.items[best].append(item)
            self.used[best] += size
            return self.pop(best) if self.used[best] == self.length else None
        closed = self.pop(int(np.argmax(self.used))) if len(self.items) >= self.limit else None
        self.items.append([item])
        self.used = np.append(self.used, size)
        return closed

    def pop(self, at: int) -> list:
        self.used = np.delete(self.used, at)
        return self.items.pop(at)


def pack(docs: DataFrame, path: str | None = None, end: int = 1, length: int = LENGTH, limit: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    schema = pa.schema([(n, pa.bool_() if n == "open" else pa.int64()) for n in (*COLUMNS, "open")])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier stages left in this worker
        encode, windows, number = Encoder(path, bare, end, STORE, BLOCK), Windows(length, limit), 0

        def rows(window: list, still_open: bool) -> list[tuple]:
            nonlocal number
            out, at = [], 0
            for piece in window:
                out.append((*piece, number, at, still_open))
                at += piece[2]
            number += 1
            return out

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

        for batch in batches:
            number = number or (batch.column(2)[0].as_py() << 40 if len(batch) else 0)
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                for start in range(0, len(ids), length):
                    cut = ids[start : start + length]
                    piece = (doc, start, len(cut), zlib.crc32(cut.tobytes()), len(ids))
                    if closed := windows.add(len(cut), piece) if len(cut) < length else [piece]:
                        out += rows(closed, False)
            yield table(out)
        yield table([r for window in windows.items for r in rows(window, True)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    pieces = stage(source.mapInArrow(first, PIECE), "pieces")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(length, limit)

        def moved(window: list) -> list[tuple]:
            base, out = 0, []
            for number, used in window:
                out.append((number, window[0][0], base))
                base += used
            return out

        for batch in batches:
            closed = [moved(c) for n, u in zip(batch["sequence_id"], batch["used"]) if (c := windows.add(int(u), (n, int(u))))]
            yield pd.DataFrame([r for c in closed for r in c], columns=["old", "new", "base"])
        yield pd.DataFrame([r for w in windows.items for r in moved(w)], columns=["old", "new", "base"])

    # One row per window left open, at most ``limit`` a partition; MERGE partitions meet in a task.
    left = pieces.where("open").groupBy("sequence_id").agg(F.sum("length").alias("used"))
    tasks = max(1, source.rdd.getNumPartitions() // MERGE)
    left = left.repartition(tasks, F.shiftright("sequence_id", 40) % tasks).sortWithinPartitions(F.desc("used"), "sequence_id")
    joined = stage(left.mapInPandas(merge, "old long, new long, base long"), "merged")
    closed = pieces.where("not open").drop("open")
    merged = pieces.where("open").join(joined, F.col("sequence_id") == F.col("old"))
    merged = merged.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("new").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return closed.unionByName(merged)
