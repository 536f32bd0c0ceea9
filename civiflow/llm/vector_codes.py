"""Vector compression: product codebooks by Lloyd rounds with norm-of-sum bounds.

Vectors are scaled to integers and cut into PARTS equal parts; each part position
has a codebook of at most ENTRIES entries, at first the parts of the smallest ids.
Rounds assign every part to its nearest entry (ties to the lower index) and
replace each entry by the floor of the mean of its parts.

Entries are dealt into GROUPS groups. For every part and group a row keeps a lower
bound of the distance to the group's entries other than its own, and the round in
which the bound was measured. All codebooks of earlier rounds are kept, so a bound
falls by the largest net way of the group's entries since that round, the norm of
the sum of their steps, instead of the sum of the norms. Only groups whose bound
does not exceed the exact distance to the own entry are scanned again.

Vectors that are null or hold null or non-finite components take no part, nor do
empty ones. Null ids come last among the ids; repeated rows are separate vectors.
Vectors of several lengths, of a length that is no multiple of PARTS, or with
components too large for exact double arithmetic raise an error. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiflow.plans.joins import lookup
from civiflow.plans.staging import stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
GROUPS = 16
SCALE = 1024
EXACT = 2.0**53
STATE = "vec_id long, label string, v array<long>, own binary, bounds binary, stamps binary, error long, scanned long"


def integer_vectors(table: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and floor(scale * x) of all components x, where they are all finite."""
    x = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where((F.size("x") > 0) & finite).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def shape(rows: DataFrame) -> tuple[int, int, float]:
    """Number of vectors, their length, and the largest absolute component."""
    size, most = F.size("v"), F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    n, low, high, largest = rows.agg(F.count("*"), F.min(size), F.max(size), F.max(most)).first()
    if n and low != high:
        raise ValueError(f"vectors of {low} to {high} components; all must be of one length")
    return n, high or 0, largest or 0.0


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]


def grouped(book: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of each entry: entries near each other share one."""
    centres = book[:: max(1, -(-len(book) // groups))].astype(float)
    for _ in range(8):
        group = squared(book, centres).argmin(1)
        for g in np.unique(group):
            centres[g] = book[group == g].mean(0)
    return group


class Assignment:
    """Assigns integer vectors to the last of a history of codebooks (round, part, entry, position)."""

    def __init__(self, history: np.ndarray, groups: np.ndarray):
        self.now, self.groups, self.book = len(history) - 1, groups, history[-1]
        self.members = [[np.flatnonzero(g == k) for k in range(GROUPS)] for g in groups]
        ways = np.sqrt(((history[-1] - history) ** 2).sum(3))
        # Largest net way of each group's entries since each round.
        self.ways = np.zeros((len(history), PARTS, GROUPS))
        for p in range(PARTS):
            for g, own in enumerate(self.members[p]):
                if len(own):
                    self.ways[:, p, g] = ways[:, p, own].max(1)

    def first(self, parts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entries, squared distances, bounds and stamps of vectors seen for the first time."""
        n = len(parts)
        own, near = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS))
        bounds, stamps = np.full((n, PARTS, GROUPS), np.inf), np.zeros((n, PARTS, GROUPS), np.uint8)
        for p in range(PARTS):
            d = squared(parts[:, p], self.book[p])
            own[:, p] = d.argmin(1)
            near[:, p] = d[np.arange(n), own[:, p]]
            d[np.arange(n), own[:, p]] = np.inf
            for g, entries in enumerate(self.members[p]):
                if len(entries):
                    bounds[:, p, g] = np.sqrt(d[:, entries].min(1))
        return own, near, bounds, stamps, np.full(n, PARTS * self.book.shape[1])

    def again(self, parts: np.ndarray, own: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the results of an earlier round; counts the distances measured."""
        own, bounds, stamps = own.copy(), bounds.copy(), stamps.copy()
        near, scanned = np.zeros(own.shape), np.full(len(parts), PARTS)
        rows = np.arange(len(parts))
        for p in range(PARTS):
            old = own[:, p].copy()
            here = ((parts[:, p] - self.book[p][old]) ** 2).sum(1)
            best, at = here.copy(), old.copy()
            low = bounds[:, p] - self.ways[stamps[:, p], p, np.arange(GROUPS)]
            # The margin covers the rounding of roots and of the stored bounds.
            open_ = low * (1 - 1e-6) - 1e-6 <= np.sqrt(here)[:, None]
            second: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for g, entries in enumerate(self.members[p]):
                some = np.flatnonzero(open_[:, g])
                if not len(entries) or not len(some):
                    continue
                d = squared(parts[some, p], self.book[p][entries])
                scanned[some] += len(entries)
                least = d.argmin(1)
                value, entry = d[np.arange(len(some)), least], entries[least]
                better = (value < best[some]) | ((value == best[some]) & (entry < at[some]))
                best[some[better]], at[some[better]] = value[better], entry[better]
                second[g] = some, d
            for g, (some, d) in second.items():
                d[self.members[p][g][None, :] == at[some][:, None]] = np.inf
                bounds[some, p, g], stamps[some, p, g] = np.sqrt(d.min(1)), self.now
            # The entry left behind counts in its group's bound from now on.
            moved = rows[at != old]
            g = self.groups[p][old[moved]]
            since = self.ways[stamps[moved, p, g], p, g]
            bounds[moved, p, g] = np.minimum(bounds[moved, p, g] - since, np.sqrt(here[moved]))
            stamps[moved, p, g] = self.now
            own[:, p], near[:, p] = at, best
        return own, near, bounds, stamps, scanned


def fixed(column: pa.Array, kind: str, *sizes: int) -> np.ndarray:
    """Binary values of one size as an array."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), *sizes)


def cells(values: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in values], pa.binary())


def assign(rows: DataFrame, width: int, history: np.ndarray, groups: np.ndarray) -> DataFrame:
    """Rows with the state after assigning them to the last codebooks."""
    fresh = "own" not in rows.columns
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int64())), ("own", pa.binary()), ("bounds", pa.binary()), ("stamps", pa.binary()), ("error", pa.int64()), ("scanned", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assignment = Assignment(history, groups)
        for batch in batches:
            if not len(batch):
                continue
            parts = batch.column("v").flatten().to_numpy().astype(float).reshape(len(batch), PARTS, width // PARTS)
            if fresh:
                own, near, bounds, stamps, scanned = assignment.first(parts)
            else:
                state = fixed(batch.column("own"), "u1", PARTS).astype(np.int64), fixed(batch.column("bounds"), "<f4", PARTS, GROUPS).astype(float), fixed(batch.column("stamps"), "u1", PARTS, GROUPS)
                own, near, bounds, stamps, scanned = assignment.again(parts, *state)
            made = [cells(own.astype("u1")), cells(bounds.astype("<f4")), cells(stamps.astype("u1")), pa.array(near.sum(1).astype(np.int64)), pa.array(scanned.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(schema.field(c).type) for c in ("vec_id", "label", "v")], *made], schema=schema)

    return rows.mapInArrow(work, STATE)


def part_sums(rows: DataFrame, width: int) -> DataFrame:
    """(part, entry, position, total, n) summed over all vectors; one set of partial sums a task."""
    size = width // PARTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((PARTS, ENTRIES, size), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            parts = batch.column("v").flatten().to_numpy().reshape(len(batch), PARTS, size)
            own = fixed(batch.column("own"), "u1", PARTS)
            for p in range(PARTS):
                np.add.at(totals[p], own[:, p], parts[:, p])
                counts[p] += np.bincount(own[:, p], minlength=ENTRIES)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e]), "totals": pa.array(list(totals[p, e]), pa.list_(pa.int64()))})

    partial = rows.select("v", "own").mapInArrow(work, "part int, entry int, n long, totals array<long>")
    spread = partial.select("part", "entry", "n", F.posexplode("totals").alias("position", "total"))
    return spread.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def compress(table: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, label, own, error, scanned) and the codebooks (part, entry, position)."""
    vectors = stage(integer_vectors(table, SCALE), "integers")
    n, width, largest = shape(vectors)
    if width % PARTS or width * (2 * largest) ** 2 >= EXACT:
        raise ValueError(f"cannot cut {width} components of up to {largest} into {PARTS} exact parts")
    # At most ENTRIES vectors.
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    book = np.array([r["v"] for r in start], float).reshape(len(start), PARTS, -1 if width else 0).transpose(1, 0, 2)
    if not n:
        return vectors.select("vec_id", "label", F.lit(b"").alias("own"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scanned")), book
    groups = np.stack([grouped(b) for b in book])
    history, rows = book[None], vectors
    for _ in range(rounds):
        rows = stage(assign(rows, width, history, groups), "codes")
        book = history[-1].copy()
        # One number for each component of the codebooks.
        for r in part_sums(rows, width).collect():
            book[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
        history = np.concatenate([history, book[None]])
    return stage(assign(rows, width, history, groups), "codes").drop("v", "bounds", "stamps"), book


def digests(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and the number of distances measured in the last pass."""
    codes, book = compress(table)
    listed = ",".join(str(int(x)) for x in book.ravel())
    by_label = stage(codes.groupBy("label").agg(F.sum("error").cast("long").alias("label_error")), "label_errors")
    out = lookup(codes, by_label, ["label"])
    sha = F.lit(hashlib.sha256(listed.encode()).hexdigest())
    return out.select("vec_id", F.lower(F.hex("own")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256"), "scanned")
