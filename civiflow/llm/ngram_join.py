"""N-gram Jaccard join by a MinHash LSH forest.

Words are runs of anything but ASCII white space, in lower case; a document is
the set of its runs of five words (of all its words, if fewer). Each of TREES
prefix tries orders the documents by DEPTHS[0] minhash values, one byte a value.

The join starts with the longest prefixes: documents that share one in some tree
are verified exactly. The similarities of the links found so far tell how many
links prefixes of that length miss, as a link of similarity s is found at depth d
with probability p = 1 - (1 - s^d)^TREES and so stands for 1 / p links. While the
links found are less than TARGET of those, the matched prefixes are shortened to the
next depth and the pairs that these add are verified; without links the similarity
asked for counts. The last depth finds a pair of similarity 0.8 with probability 0.9996.
Only documents that share a prefix of the last depth ever enter a round.

A pair is verified once, at its longest shared prefix and in the first tree with
that: as a row of its own where at most SMALL documents share the prefix, else
inside blocks of about CELL documents, each block against each. A crowd above CELL
is cut by set size first, and blocks whose sizes rule out the similarity do not
meet. Blocks first see keys alone; word sets are sent only to the blocks where a
document has pairs left to verify. They return link counts and roots, not pairs;
their work still grows with the square of a crowd.

Documents with the same words are one node. Documents without words, null texts
included, are one such node and link to nothing. Ids may be null or repeated;
classes are named by their smallest id. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from civiflow.llm.exact_dedup import keep_rows, normalised
from civiflow.plans.staging import stage

WORDS = 5
SIMILAR = 0.8
TREES = 20
# Lengths of the prefixes, longest first, and the share of links at which shortening ends.
DEPTHS = (8, 6, 5)
TARGET = 0.9999
# Prefixes of more documents are compared block by block, not by rows of pairs.
SMALL = 16
CELL = 512
BLOCK = 2048
COLUMNS = 4096

_random = np.random.default_rng(11)
FACTORS = _random.integers(0, 2**32, TREES * DEPTHS[0], dtype=np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, TREES * DEPTHS[0], dtype=np.uint32)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``n`` words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(n, len(h))
    total = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        total = total * MULTIPLIER + h[j : len(h) - width + 1 + j]
    return np.unique(mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the set."""
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(FACTORS), 2**32 - 1, np.uint32)
    for i in range(0, len(low), BLOCK):
        np.minimum(least, (low[None, i : i + BLOCK] * FACTORS[:, None] + SHIFTS[:, None]).min(1), out=least)
    return least


def trie_keys(sig: np.ndarray) -> np.ndarray:
    """Place of a signature in each tree: one byte a value, the first value highest."""
    levels = mixed(sig.reshape(TREES, DEPTHS[0]).astype(np.uint64) * MULTIPLIER) >> np.uint64(56)
    key = np.zeros(TREES, np.uint64)
    for d in range(DEPTHS[0]):
        key = (key << np.uint64(8)) | levels[:, d]
    return key.view(np.int64)


def cut(depth: int) -> int:
    """Bits of a key below a prefix of ``depth`` values."""
    return 8 * (DEPTHS[0] - depth)


def prefixes(sig: np.ndarray, depth: int = DEPTHS[-1]) -> np.ndarray:
    """One 64-bit number per tree, of the tree's prefix of ``depth`` values."""
    short = trie_keys(sig).view(np.uint64) >> np.uint64(cut(depth))
    return mixed(mixed(short + MULTIPLIER) * MULTIPLIER + np.arange(1, TREES + 1, dtype=np.uint64)).view(np.int64)


def recall(similarities: dict[int, int], depth: int, least: float) -> float:
    """Share of links found with prefixes of ``depth``, by the number of those found of each hundredth of similarity."""
    found = {max(s / 100, least): n for s, n in similarities.items()} or {least: 1}
    return sum(found.values()) / sum(n / (1 - (1 - s**depth) ** TREES) for s, n in found.items())


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of the words; set size and trie keys of documents with words."""
    for batch in batches:
        digests, sizes, keys = [], [], []
        for text in batch["whole_text"]:
            words = words_of(text)
            found = shingles(words)
            digests.append(xxhash.xxh3_128_hexdigest(b" ".join(words)) if words else "")
            sizes.append(len(found))
            keys.append(trie_keys(signature(found)) if words else None)
        yield batch.drop(columns="whole_text").assign(digest=digests, size=sizes, keys=keys)


@F.pandas_udf(ArrayType(LongType()))
def shingle_set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(words_of(t)).view(np.int64) for t in texts])


def shared_prefixes(rows: DataFrame, depth: int, deeper: int | None = None) -> DataFrame:
    """``rows`` (node, size, tree, trie) that share a prefix of ``depth`` values, with its key and their number n.

    Prefixes whose documents all share the one of ``deeper`` values too add no pair and are left out.
    """
    keyed = rows.withColumn("key", F.xxhash64("tree", F.shiftrightunsigned("trie", cut(depth))))
    longer = F.shiftrightunsigned("trie", cut(deeper)) if deeper else F.col("trie")
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(longer).alias("lo"), F.max(longer).alias("hi"))
    groups = stage(groups.where("n > 1 and lo != hi" if deeper else "n > 1").select("key", "n"), "prefixes")
    return keyed.join(groups, "key")


def listed_pairs(shared: DataFrame, depth: int, deeper: int | None) -> DataFrame:
    """Pairs (a < b) whose common prefix in some tree ends between two depths, with the first such tree; small groups only."""
    # Lists hold SMALL members at most.
    lists = shared.where(F.col("n") <= SMALL).groupBy("key", "tree").agg(F.collect_list(F.struct("node", "trie")).alias("m"))
    pairs = lists.select("tree", F.explode("m").alias("x"), "m").select("tree", "x", F.explode("m").alias("y")).where("x.node < y.node")
    differ = F.col("x.trie").bitwiseXOR(F.col("y.trie"))
    pairs = pairs.where(F.shiftrightunsigned(differ, cut(depth)) == 0)
    if deeper:
        pairs = pairs.where(F.shiftrightunsigned(differ, cut(deeper)) != 0)
    return pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.min("tree").alias("tree"))


def dealt(crowded: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """(node, keys, tree, key, c, i, d, j, side): each member once for every pair of blocks that its block is part of.

    Sets of similarity ``least`` lie in the same or in neighbouring size classes.
    """
    width = math.log(1 / least) + 1e-9
    level = F.when(F.col("n") > CELL, F.floor(F.log("size") / width).cast("int")).otherwise(0)
    rows = stage(crowded.select("node", "tree", "key", level.alias("c")), "crowded")
    cells = rows.groupBy("key", "c").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    blocks = stage(cells.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("c", "blocks"))).alias("blocks")), "blocks")

    def count(c):
        return F.coalesce(F.try_element_at("blocks", c), F.lit(0))

    def each(c, pair):
        return F.transform(F.array_repeat(F.lit(0), count(c)), lambda _, j: F.struct(*[v.cast("int").alias(k) for k, v in pair(j).items()]))

    c, i = F.col("c"), F.col("i")
    same = each(c, lambda j: {"c": c, "i": F.least(i, j), "d": c, "j": F.greatest(i, j), "side": (i > j)})
    above = each(c + 1, lambda j: {"c": c, "i": i, "d": c + 1, "j": j, "side": F.lit(0)})
    below = each(c - 1, lambda j: {"c": c - 1, "i": j, "d": c, "j": i, "side": F.lit(1)})
    # Keys meet members before these are dealt, so once for a prefix and not for each pair of blocks.
    placed = rows.join(keys, "node").join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("node", "key"), count(c)).cast("int"))
    return placed.select("node", "keys", "tree", "key", F.explode(F.concat(same, above, below)).alias("p")).select("node", "keys", "tree", "key", "p.*")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``."""
    left, right = np.concatenate(a), np.concatenate(b)
    vocabulary = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(vocabulary):
        return out
    sides = []
    for sets, values in ((a, left), (b, right)):
        at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        known = vocabulary[at] == values
        column, row = at[known], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], row[order], len(sets)))
    for start in range(0, len(vocabulary), COLUMNS):
        parts = []
        for column, row, n in sides:
            lo, hi = np.searchsorted(column, [start, start + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(vocabulary) - start)), np.float32)
            part[row[lo:hi], column[lo:hi] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row it is connected to."""
    out = np.full(len(linked), -1)
    for i in range(len(linked)):
        reached = np.array([i]) if out[i] < 0 else np.zeros(0, int)
        while len(reached):
            out[reached] = i
            reached = np.flatnonzero(linked[reached].any(0) & (out < 0))
    return out


def due(keys_a: np.ndarray, keys_b: np.ndarray, alone: bool, tree: int, depth: int, deeper: int | None) -> np.ndarray:
    """Which pairs of two blocks are to be verified here: no longer shared prefix in any tree, no equal one in an earlier tree."""
    out = np.triu(np.ones((len(keys_a),) * 2, bool), 1) if alone else np.ones((len(keys_a), len(keys_b)), bool)
    for t in range(TREES):
        differ = keys_a[:, t, None] ^ keys_b[None, :, t]
        if deeper:
            out &= differ >> np.uint64(cut(deeper)) != 0
        if t <= tree:
            out &= (differ >> np.uint64(cut(depth)) == 0) == (t == tree)
    return out


def two_sides(at: tuple, rows: pd.DataFrame) -> tuple[bool, list[pd.DataFrame], list[np.ndarray]]:
    """Whether a block meets itself, the rows of both blocks, and their keys."""
    alone = at[2:4] == at[4:6]
    sides = [rows[rows["side"] == side] for side in ((0, 0) if alone else (0, 1))]
    return alone, sides, [np.stack(list(x["keys"])).view(np.uint64) if len(x) else np.zeros((0, TREES), np.uint64) for x in sides]


def waiting(depth: int, deeper: int | None) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The rows of two blocks that have pairs to be verified there."""

    def wait(at: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alone, sides, keys = two_sides(at, rows)
        mine = due(*keys, alone, at[1], depth, deeper)
        stay = [mine.any(1) | mine.any(0)] if alone else [mine.any(1), mine.any(0)]
        return pd.concat([x[y] for x, y in zip(sides, stay)]).drop(columns="keys")

    return wait


def compared(least: float, depth: int, deeper: int | None) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Number of links and root of each member of two blocks; rows without node count links by hundredth of similarity."""

    def compare(at: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alone, sides, keys = two_sides(at, rows)
        mine = due(*keys, alone, at[1], depth, deeper)
        linked, counts = np.zeros((len(rows), len(rows)), bool), np.zeros(101, np.int64)
        x, y = np.flatnonzero(mine.any(1)), np.flatnonzero(mine.any(0))
        if len(x):
            sets_a, sets_b = ([s[k] for k in z] for s, z in zip((list(side["s"]) for side in sides), (x, y)))
            common = common_counts(sets_a, sets_b).astype(np.float64)
            either = np.array([len(s) for s in sets_a])[:, None] + np.array([len(s) for s in sets_b])[None, :] - common
            similar = (common >= least * either) & mine[np.ix_(x, y)]
            counts = np.bincount((100 * common[similar] / either[similar]).astype(int), minlength=101)
            linked[np.ix_(x, y if alone else y + len(sides[0]))] = similar
            linked |= linked.T
        node = np.concatenate([x["node"].to_numpy(np.int64) for x in (sides[:1] if alone else sides)])
        out = pd.DataFrame({"node": pd.array(node, "Int64"), "root": node[roots(linked)], "n": linked.sum(1).astype(np.int64)})
        classes = np.flatnonzero(counts)
        spread = pd.DataFrame({"node": pd.array([None] * len(classes), "Int64"), "root": classes, "n": counts[classes]})
        return pd.concat([out[out["n"] > 0], spread])

    return compare


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): least node it is connected to.

    Alternating large and small stars; each round is two staged tables. Large stars keep repeated
    edges, as there are no more of them than before; small stars drop them.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def verified(shared: DataFrame, sets: DataFrame, least: float, depth: int, deeper: int | None, seen: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs looked at, links (a, b, similarity) and counts of the blocks of one round."""
    shared = stage(shared, "shared")
    pairs = listed_pairs(shared, depth, deeper)
    if seen is not None:
        pairs = pairs.join(seen, ["a", "b"], "left_anti")
    pairs = stage(pairs, "pairs")
    first = pairs.join(sets.withColumnsRenamed({"node": "a", "s": "sa", "keys": "ka"}), "a")
    joined = first.join(sets.withColumnsRenamed({"node": "b", "s": "sb", "keys": "kb"}), "b")
    differ = F.zip_with("ka", "kb", lambda x, y: x.bitwiseXOR(y))
    # Pairs of a longer prefix, or of a crowded one in an earlier tree, are compared there.
    elsewhere = F.exists(F.slice(differ, 1, F.col("tree")), lambda x: F.shiftrightunsigned(x, cut(depth)) == 0)
    if deeper:
        elsewhere |= F.exists(differ, lambda x: F.shiftrightunsigned(x, cut(deeper)) == 0)
    common = F.size(F.array_intersect("sa", "sb"))
    joined = joined.where(~elsewhere).select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either"))
    links = stage(joined.where(F.col("common") >= least * F.col("either")).select("a", "b", (F.col("common") / F.col("either")).alias("similarity")), "links")

    at = ["key", "tree", "c", "i", "d", "j"]
    placed = dealt(shared.where(F.col("n") > SMALL), sets.select("node", "keys"), least)
    left = stage(placed.groupBy(*at).applyInPandas(waiting(depth, deeper), placed.drop("keys").schema), "waiting")
    blocks = left.join(sets, "node").groupBy(*at)
    return pairs.select("a", "b"), links, stage(blocks.applyInPandas(compared(least, depth, deeper), "node long, root long, n long"), "counted")


def similar_classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, text_sha256, chars, kept.

    n_links counts the verified links to documents of other words.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(normalised("text").cast("binary"), 256).alias("text_sha256"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        F.coalesce("text", F.lit("")).alias("whole_text"),
    )
    schema = "doc_id long, row long, text_sha256 string, chars long, digest string, size int, keys array<long>"
    signed = stage(source.mapInPandas(sign, schema), "signed")
    nodes = stage(signed.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "nodes")
    reps = signed.where("digest != ''").join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").withColumnRenamed("row", "node")
    tries = reps.select("node", "size", F.posexplode("keys").alias("tree", "trie"))
    matched = stage(shared_prefixes(tries, DEPTHS[-1]).drop("key", "n"), "matched")
    named = reps.join(matched.select("node").distinct(), "node", "left_semi").select("node", "keys", F.col("doc_id").alias("d"), F.col("text_sha256").alias("sha"), F.col("chars").alias("n"))
    texts = docs.withColumn("__sha", F.sha2(normalised("text").cast("binary"), 256)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__sha")
    texts = texts.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__sha") == F.col("sha")) & (F.length("text") == F.col("n")))
    sets = stage(texts.select("node", "keys", shingle_set("text").alias("s")).dropDuplicates(["node"]), "sets")

    rounds, seen, spread = [], None, {}
    for deeper, depth in zip((None, *DEPTHS), DEPTHS):
        found = verified(shared_prefixes(matched, depth, deeper), sets, least, depth, deeper, seen)
        rounds.append(found)
        seen = found[0] if seen is None else seen.unionByName(found[0])
        hundredths = found[1].select(F.floor(100 * F.col("similarity")).cast("int").alias("s"), F.lit(1).alias("n"))
        hundredths = hundredths.unionByName(found[2].where("node is null").select(F.col("root").cast("int").alias("s"), "n"))
        # At most 101 rows.
        for s, n in hundredths.groupBy("s").agg(F.sum("n")).collect():
            spread[s] = spread.get(s, 0) + n
        if recall(spread, depth, least) >= TARGET:
            break
    links = reduce(DataFrame.unionByName, [links for _, links, _ in rounds]).select("a", "b")
    counted = reduce(DataFrame.unionByName, [counted for _, _, counted in rounds]).where("node is not null")

    connected = components(links.unionByName(counted.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    ones = [links.select(F.col(c).alias("node"), F.lit(1).cast("long").alias("n")) for c in ("a", "b")]
    degree = ones[0].unionByName(ones[1]).unionByName(counted.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n_links"))
    placed = nodes.join(connected, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(F.min("least_id").alias("class_id"))
    placed = stage(placed.join(classes, "root").select("digest", "root", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "placed")
    # One digest may be that of a third of all rows; the join splits it.
    rows = stage(signed.drop("size", "keys").join(placed, "digest"), "classes")
    stay = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).getField("row").alias("stays"))
    return rows.join(stay, "root").select("doc_id", "class_id", "n_links", "text_sha256", "chars", (F.col("row") == F.col("stays")).alias("kept"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each class."""
    classes = similar_classes(docs)
    ids = classes.groupBy("doc_id", "text_sha256", "chars").agg(F.count("*").alias("copies"), F.max("kept").alias("kept"))
    return keep_rows(docs, stage(ids.where("kept"), "kept"))
