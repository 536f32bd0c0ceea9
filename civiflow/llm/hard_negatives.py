"""Hard negatives by lists shared among clusters of anchors.

Scores are inner products of integer vectors. Anchors are dealt into blocks, and
those of a block clustered by direction. For each cluster the candidates of a
block are sorted once by an upper bound of their score with any member of unit
length: norm times the cosine of their angle to the centre, less the largest angle
of a member to it. Every member walks that list and stops when the bound times its
own norm falls below the last score it would still take, so what it skips cannot
count. Two walks: the first finds the best positives of each anchor, the second,
for each positive, the best candidates of other labels in its score range.

An anchor block meets the candidate blocks of one stripe in one task and keeps its
best so far from block to block; the best of all stripes are merged by rank.

Rows with a null id, label or vector, or with any null or non-finite component,
take no part. Rows of an anchor's own id are never its positives or negatives;
repeated rows are separate rows, and repeated anchors answer separately. Ties go to
the smaller id. Vectors of several lengths, or with components too large for exact
double arithmetic, raise an error. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiflow.llm.vector_codes import EXACT, integer_vectors, shape
from civiflow.plans.staging import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
ANCHORS = 4096
BLOCK = 2048
MEMBERS = 32
STEP = 256
FOUND = "anchor long, place int, id long, score double"


def relabelled(rows: DataFrame) -> DataFrame:
    """Labels as numbers, moved on by one where the id is divisible by 7."""
    label = F.col("label").cast("long")
    return rows.where("vec_id is not null and label is not null").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def clusters(vectors: np.ndarray, members: int = MEMBERS) -> list[np.ndarray]:
    """Rows of similar direction, some ``members`` on average."""
    unit = vectors / np.maximum(np.sqrt((vectors**2).sum(1)), 1e-300)[:, None]
    centres = unit[:: max(1, members)].copy()
    for _ in range(5):
        nearest = (unit @ centres.T).argmax(1)
        for c in np.unique(nearest):
            centres[c] = unit[nearest == c].mean(0)
        centres /= np.maximum(np.sqrt((centres**2).sum(1)), 1e-300)[:, None]
    nearest = (unit @ centres.T).argmax(1)
    return [np.flatnonzero(nearest == c) for c in np.unique(nearest)]


class Best:
    """For each of ``n`` askers the ``k`` best (score, id) so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (asker, candidate), minus infinity where a candidate does not count."""
        some = (scores >= self.scores[who, -1:]) & np.isfinite(scores)
        rows = np.flatnonzero(some.any(1))
        if not len(rows):
            return
        who, k = who[rows], self.scores.shape[1]
        s = np.hstack([self.scores[who], scores[rows]])
        i = np.hstack([self.ids[who], np.broadcast_to(ids, (len(rows), len(ids)))])
        order = np.lexsort((i, -s), axis=-1)[:, :k]
        self.scores[who], self.ids[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def last(self) -> np.ndarray:
        return self.scores[:, -1]


class Walk:
    """The anchors of one block and the best they have met."""

    def __init__(self, keys, ids, labels, vectors, scores: np.ndarray | None):
        self.keys, self.ids, self.labels, self.vectors, self.asked = keys, ids, labels, vectors, scores
        self.norms = np.sqrt((vectors**2).sum(1))
        self.clusters = clusters(vectors)
        self.places = 1 if scores is None else scores.shape[1]
        self.best = [Best(len(ids), POSITIVES if scores is None else NEGATIVES) for _ in range(self.places)]
        self.walked = 0

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Walk through the candidates of one block."""
        norms = np.sqrt((vectors**2).sum(1))
        for members in self.clusters:
            own = self.vectors[members]
            unit = own / np.maximum(self.norms[members], 1e-300)[:, None]
            centre = unit.mean(0)
            centre /= max(np.sqrt((centre**2).sum()), 1e-300)
            known = self.norms[members] > 0
            widest = np.arccos(np.clip(unit[known] @ centre, -1, 1)).max(initial=0.0)
            angle = np.arccos(np.clip(vectors @ centre / np.maximum(norms, 1e-300), -1, 1))
            # The margins cover the rounding of angles and products.
            bound = norms * np.minimum(np.cos(np.clip(angle - widest - 1e-7, 0, np.pi)) + 1e-9, 1)
            order = np.argsort(-bound, kind="stable")
            walking = members
            for start in range(0, len(order), STEP):
                walking = walking[self.unfinished(walking, bound[order[start]])]
                if not len(walking):
                    break
                some = order[start : start + STEP]
                self.walked += len(some) * len(walking)
                self.take(walking, self.vectors[walking] @ vectors[some].T, ids[some], labels[some])

    def unfinished(self, who: np.ndarray, bound: float) -> np.ndarray:
        """Which anchors can still gain from candidates below the bound."""
        reach = self.norms[who] * bound * (1 + 1e-9) + 1e-6
        if self.asked is None:
            return self.best[0].last()[who] <= reach
        out = np.zeros(len(who), bool)
        for place, best in enumerate(self.best):
            p = self.asked[who, place]
            out |= (p >= 0) & (100 * reach >= LOW * p) & (best.last()[who] <= reach)
        return out

    def take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        same = self.labels[who][:, None] == labels[None]
        if self.asked is None:
            self.best[0].add(who, np.where(same & (self.ids[who][:, None] != ids[None]), scores, -np.inf), ids)
            return
        for place, best in enumerate(self.best):
            p = self.asked[who, place][:, None]
            fits = ~same & (LOW * p <= 100 * scores) & (100 * scores <= HIGH * p) & (self.ids[who][:, None] != ids[None])
            best.add(who, np.where(fits, scores, -np.inf), ids)

    def rows(self) -> pd.DataFrame:
        out = []
        for place, best in enumerate(self.best):
            a, b = np.nonzero(np.isfinite(best.scores))
            out.append(pd.DataFrame({"anchor": self.keys[a], "place": place, "id": best.ids[a, b], "score": best.scores[a, b]}))
        return pd.concat(out)


def listed(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """One row per value of ``by`` with the columns as lists; vectors are laid end to end."""
    lists = rows.groupBy(by).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return lists.select(by, *[(F.flatten(f"rows.{c}") if c in ("v", "asked") else F.col(f"rows.{c}")).alias(f"{by}_{c}") for c in columns])


def walked(anchors: DataFrame, blocks: DataFrame, anchor_blocks: int, stripes: int) -> DataFrame:
    """(anchor, place, id, score): the best of each stripe."""
    asking = "asked" in anchors.columns
    dealt = anchors.withColumn("q", F.pmod(F.xxhash64("key"), F.lit(anchor_blocks)))
    lists = listed(dealt, "q", ["key", "vec_id", "label", "v", *(["asked"] if asking else [])])

    def pair(q, stripe):
        return (q * F.lit(stripes) + stripe).cast("long")

    askers = lists.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("pair", pair(F.col("q"), F.col("stripe"))).drop("q", "stripe")
    met = blocks.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))).withColumn("pair", pair(F.col("to"), F.col("b") % stripes)).drop("to", "b")
    # Each anchor block meets each stripe once; both sides of a pair are of bounded size.
    together = met.repartition(anchor_blocks * stripes, "pair").join(askers.repartition(anchor_blocks * stripes, "pair"), "pair")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, current = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if walk is None or r.pair != current:
                    if walk is not None:
                        yield walk.rows()
                    ids = np.asarray(r.q_vec_id)
                    scores = np.asarray(r.q_asked, float).reshape(len(ids), -1) if asking else None
                    walk = Walk(np.asarray(r.q_key), ids, np.asarray(r.q_label), np.asarray(r.q_v, float).reshape(len(ids), -1), scores)
                    current = r.pair
                found = np.asarray(r.b_vec_id)
                walk.meet(found, np.asarray(r.b_label), np.asarray(r.b_v, float).reshape(len(found), -1))
        if walk is not None:
            yield walk.rows()

    return together.mapInPandas(work, FOUND)


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(table: DataFrame, every: int = 100, relabel: Callable[[DataFrame], DataFrame] = relabelled) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, rows whose id is divisible by ``every``."""
    rows = stage(relabel(integer_vectors(table, SCALE)).withColumn("key", F.monotonically_increasing_id()), "rows")
    n, width, largest = shape(rows)
    if 100 * width * largest**2 >= EXACT:
        raise ValueError(f"components of up to {largest} are too large for exact scores")
    anchors = rows.where(F.col("vec_id") % every == 0)
    anchor_blocks = max(1, -(-anchors.count() // ANCHORS))
    count = max(1, -(-n // BLOCK))
    stripes = min(count, 2 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = stage(listed(rows.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(count))), "b", ["vec_id", "label", "v"]), "blocks")

    near = walked(anchors, blocks, anchor_blocks, stripes)
    positives = stage(ranked(near, ["anchor"], POSITIVES).select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Scores by place; anchors with fewer positives ask for less than nothing there.
    asked = positives.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("m"))
    asked = asked.select(F.col("anchor").alias("key"), F.transform(F.sequence(F.lit(1), F.lit(POSITIVES)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1.0))).alias("asked"))
    found = walked(anchors.join(asked, "key"), blocks, anchor_blocks, stripes)
    best = ranked(found, ["anchor", "place"], NEGATIVES).select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = best.join(positives, ["anchor", "place"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))
