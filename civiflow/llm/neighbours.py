"""Approximate nearest neighbours by collision counting.

Every vector is projected on PROJECTIONS random lines; each block of vectors
keeps one sorted array per line. A query opens a window around its own
projection in every array; virtual rehashing widens the windows step by step,
and vectors that fall into at least THRESHOLD of them are verified by the exact
inner product, until each block has given enough candidates. Vectors are
lengthened by one component to equal norm, so that the largest inner product is
the least distance.

Vectors that are null, zero, empty or hold null or non-finite components take no
part, nor do rows without id; vectors of several lengths raise an error. Ties go to the smaller id; repeated rows are
separate candidates, but never candidates of their own id. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiflow.plans.staging import stage

PROJECTIONS = 48
SHARE = 0.35
BLOCK = 4096
# Half widths of the windows in standard deviations of a projection, and the
# share of windows in which a vector must be found at each.
STEPS = ((0.5, 0.5), (0.8, 0.55), (1.2, 0.6), (1.8, 0.7), (np.inf, 0.0))
OUT = "query_id long, vec_id long, score double"


def usable(table: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    low, high = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components; all must be of one length")
    return rows


def search_block(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, largest: float, k: int, share: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For each query the best k verified vectors of one block."""
    lines = np.random.default_rng(7).normal(size=(vectors.shape[1] + 1, PROJECTIONS))
    rest = np.sqrt(np.maximum(largest - (vectors**2).sum(1), 0))
    index = (np.hstack([vectors, rest[:, None]]) @ lines).T
    own = ((queries * (np.sqrt(largest) / np.sqrt((queries**2).sum(1)))[:, None]) @ lines[:-1]).T
    order = np.argsort(index, 1, kind="stable")
    arrays = np.take_along_axis(index, order, 1)
    # Where each vector stands in each sorted array.
    places = np.empty(order.shape, np.uint16 if len(ids) < 2**16 else np.uint32)
    np.put_along_axis(places, order, np.arange(len(ids), dtype=places.dtype)[None], 1)
    spread = index.std(1, keepdims=True) + 1e-12
    small = vectors.astype(np.float32)
    wanted = min(len(ids), max(20 * k, int(share * len(ids))))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def window(step: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places of every query's window in every array."""
        if step not in bounds:
            width = spread * STEPS[step][0]
            low = np.stack([np.searchsorted(a, x) for a, x in zip(arrays, own - width)])
            high = np.stack([np.searchsorted(a, x, "right") for a, x in zip(arrays, own + width)])
            bounds[step] = low.astype(places.dtype), (high - low).astype(places.dtype)
        return bounds[step]

    for q in range(len(queries)):
        for step, (_, part) in enumerate(STEPS):
            low, number = window(step)
            counts = ((places - low[:, q, None]) < number[:, q, None]).sum(0, dtype=np.uint8)
            picked = np.flatnonzero(counts >= part * PROJECTIONS)
            if len(picked) >= wanted:
                break
        picked = picked[ids[picked] != query_ids[q]]
        # Rough scores of the candidates, then exact ones of all that can be among the k best.
        rough = small[picked] @ queries[q].astype(np.float32)
        if len(picked) > k:
            error = 2.4e-7 * (vectors.shape[1] + 2) * np.sqrt(largest) * np.sqrt((queries[q] ** 2).sum())
            picked = picked[rough >= np.partition(rough, -k)[-k] - error]
        score = (vectors[picked] * queries[q]).cumsum(1)[:, -1]
        best = np.lexsort((ids[picked], -score))[:k]
        yield np.full(len(best), query_ids[q]), ids[picked][best], score[best]


def search(table: DataFrame, k: int = 20, every: int = 20, share: float = SHARE) -> DataFrame:
    """The k nearest found of each row whose id is divisible by ``every``."""
    rows = stage(usable(table), "vectors")
    n, largest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    blocks = max(1, -(-n // BLOCK))

    def blocked(df: DataFrame, name: str, count: int) -> DataFrame:
        # Lists of about BLOCK rows each; their number grows, not their size.
        place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).alias(name)
        return df.groupBy(place).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows")).select(name, F.col("rows.vec_id").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_v"))

    vectors = stage(blocked(rows, "b", blocks), "vector_blocks")
    query_blocks = max(1, -(-blocks // every))
    queries = stage(blocked(rows.where(F.col("vec_id") % every == 0), "q", query_blocks), "query_blocks")
    # Each vector block meets each block of the stated queries, which go once to every stripe of vector blocks.
    stripes = min(blocks, 2 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pair = lambda q, stripe: (q * F.lit(stripes) + stripe).cast("long").alias("pair")
    met = vectors.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("to")).select("b_ids", "b_v", pair(F.col("to"), F.col("b") % stripes))
    asked = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("to")).select("q_ids", "q_v", pair(F.col("q"), F.col("to")))
    tasks = query_blocks * stripes

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, qids = np.asarray(r.b_ids), np.asarray(r.q_ids)
                v, qv = np.asarray(r.b_v).reshape(len(ids), -1), np.asarray(r.q_v).reshape(len(qids), -1)
                found = list(search_block(ids, v, qv, qids, largest, k, share))
                if found:
                    a, b, c = (np.concatenate(x) for x in zip(*found))
                    yield pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    hits = met.repartition(tasks, "pair").join(asked.repartition(tasks, "pair"), "pair").mapInPandas(work, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
