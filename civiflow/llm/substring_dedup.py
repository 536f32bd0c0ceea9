"""Removal of repeated word runs by prefix-partitioned suffix trees.

A window is WINDOW consecutive words of one document; words are runs of anything
but ASCII white space, unchanged. A word goes when it lies in a window whose
words also start in a document of a smaller id. All windows are judged on the
input.

Texts are kept in chunks of about CHUNK bytes, stored once. The leaves of the
trees are the suffixes that start at anchors: the run of ANCHOR words of least
hash in a window, which equal windows share at the same place. Suffixes are split
into groups by prefix: by their first ANCHOR words, and where more than CROWD
chunks hold these, by all words of the window. Anchors of one document have no
inner node and are dropped before. Each group sorts its suffixes and takes the
lengths of common prefixes of neighbours, that is the inner nodes of its subtree;
nodes deep enough, split by the words before the anchor, are the repeats, and
each gives the smallest document below it. Equal suffixes of a chunk are one leaf,
so a passage of very many documents costs one leaf a chunk.

Runs of ANCHOR words are compared by 64-bit hashes, the other words of a window by
47 bits of theirs. Null text has no words; documents with a
null id come after all others, and never repeat each other, nor do rows with
equal ids. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiflow.plans.staging import stage

WINDOW = 13
ANCHOR = 5
CHUNK = 4 * 1024 * 1024
CROWD = 100_000
NO_ID = 2**63 - 1

_random = np.random.default_rng(3)
BYTE_VALUES = _random.integers(1, 2**64, 256, dtype=np.uint64)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BYTE_VALUES[WHITE] = 0
FACTOR = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start: long, length: long>>"
PARCEL = "bucket int, chunk long, data binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parcel(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value."""
    sizes = np.array([a.nbytes for a in arrays], "<u8")
    return zstandard.ZstdCompressor(level).compress(b"".join([sizes.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def opened(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of a parcel."""
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, np.frombuffer(raw, "<u8", len(kinds)).tolist()):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit integers as arrays of four and of two bytes."""
    return (values & np.uint64(2**32 - 1)).astype("<u4"), (values >> np.uint64(32)).astype("<u2")


def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, data) of whole documents: ids, ends in bytes, bytes."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, "right")) - 1)
            value = parcel(ids[i:j], ends[i + 1 : j + 1] - ends[i], data[ends[i] : ends[j]], level=6)
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([value], pa.binary())], ["chunk", "data"])
            i, number = j, number + 1


class Words:
    """Hashes of the words of a chunk, in order, with the document of each."""

    def __init__(self, data: bytes):
        self.ids, self.ends, text = opened(data, "<i8", "<i8", "u1")
        self.text = text.tobytes()
        begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        white = WHITE[text]
        starts = ~white
        starts[1:] &= white[:-1]
        heads = begins[begins < len(text)]
        starts[heads[~white[heads]]] = True
        starts = np.flatnonzero(starts)
        if len(starts):
            lengths = np.diff(starts, append=len(text))
            powers = np.cumprod(np.full(lengths.max(), FACTOR))
            place = np.arange(starts[0], len(text)) - np.repeat(starts, lengths)
            values = BYTE_VALUES[text[starts[0] :]] * powers[place]
            self.hashes = mixed(np.add.reduceat(values, starts - starts[0])) | np.uint64(1)
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.first = np.searchsorted(starts, begins)
        self.counts = np.diff(self.first, append=len(starts))
        self.doc = np.repeat(self.ids, self.counts)
        last = np.repeat(self.first + self.counts, self.counts)
        self.windows = np.flatnonzero(np.arange(len(starts)) + WINDOW <= last)

    def runs(self, width: int) -> np.ndarray:
        """Hash of the run of ``width`` words at each place."""
        n = max(len(self.hashes) - width + 1, 0)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total = total * FACTOR + self.hashes[j : j + n]
        return mixed(total)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place and hash of each anchor, and its first and last place in its windows."""
        grams, w = self.runs(ANCHOR), self.windows
        if not len(w):
            none = np.zeros(0, np.int64)
            return none, none.astype(np.uint64), none, none
        best, offset = grams[w], np.zeros(len(w), np.int64)
        for j in range(1, WINDOW - ANCHOR + 1):
            value = grams[w + j]
            less = value < best
            best = np.where(less, value, best)
            offset[less] = j
        at = w + offset
        # The windows of one anchor follow each other.
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        final = np.append(begin[1:], len(at)) - 1
        return at[begin], best[begin], offset[final], offset[begin]


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that belong to it, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), rows


def sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, owners, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(owners, pa.int64()), pa.array(data, pa.binary())], ["bucket", "chunk", "data"])


def classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings rows of equal keys together, and where each class starts in it."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return order, np.flatnonzero(new)


def anchor_parcels(buckets: int):
    """Anchors of each chunk with their smallest and largest document, by bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = Words(data.as_py())
                at, hashes, _, _ = words.anchors()
                if not len(at):
                    continue
                keys = hashes >> np.uint64(16)
                order, begin = classes(keys)
                unique, doc = keys[order][begin], words.doc[at][order]
                low, more = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin) - np.minimum.reduceat(doc, begin)
                yield sent([(b, chunk, parcel(*halves(unique[r]), low[r], more[r])) for b, r in by_bucket((unique % np.uint64(buckets)).astype(np.int64))])

    return send


def shared_anchors(crowd: int):
    """For each chunk the anchors that occur in two documents; the last bit tells crowded ones."""

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [opened(d, "<u4", "<u2", "<i8", "<i8") for d in rows["data"]]
        lower, upper, low, more = (np.concatenate(x) for x in zip(*parts))
        hashes, high = joined(lower, upper), low + more
        order, begin = classes(hashes)
        sizes = np.diff(begin, append=len(order))
        repeated = np.minimum.reduceat(low[order], begin) < np.maximum.reduceat(high[order], begin)
        keep, crowded = np.zeros(len(order), bool), np.zeros(len(order), bool)
        keep[order], crowded[order] = np.repeat(repeated, sizes), np.repeat(sizes > crowd, sizes)
        out = []
        cuts = np.cumsum([0, *[len(p[0]) for p in parts]])
        for chunk, a, b in zip(rows["chunk"], cuts, cuts[1:]):
            if keep[a:b].any():
                out.append((chunk, parcel(*halves(hashes[a:b][keep[a:b]]), crowded[a:b][keep[a:b]])))
        return pd.DataFrame(out, columns=["chunk", "data"])

    return share


def listed(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each code once, and the places of all codes among them."""
    unique, place = np.unique(codes, return_inverse=True)
    return *halves(unique), place.astype("<u4")


def suffix_parcels(buckets: int):
    """Suffixes at shared anchors with the words before them, one of each kind in a chunk, by prefix."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, replies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = Words(data.as_py())
                lower, upper, crowded = (np.concatenate(x) for x in zip(*[opened(r, "<u4", "<u2", "?") for r in replies.as_py()]))
                shared = joined(lower, upper)
                order = np.argsort(shared)
                shared, crowded = shared[order], crowded[order]
                at, hashes, low, high = words.anchors()
                keys = hashes >> np.uint64(16)
                place = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
                found = shared[place] == keys
                at, hashes, low, high, long = at[found], hashes[found], low[found], high[found], crowded[place[found]]
                # Where the first words are crowded, each window goes by all its words.
                n = np.where(long, high - low + 1, 1)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                long, at, hashes, low, high = (np.repeat(x, n) for x in (long, at, hashes, low, high))
                low = np.where(long, low + step, low)
                high = np.where(long, low, high)
                route = np.where(long, words.runs(WINDOW)[np.minimum(at - high, max(len(words.hashes) - WINDOW, 0))], hashes)
                # The words before the anchor, then those after it.
                size = high - low + WINDOW - ANCHOR
                begin = np.cumsum(size) - size
                step = np.arange(size.sum()) - np.repeat(begin, size)
                skip = np.where(step < np.repeat(high, size), 0, ANCHOR)
                codes = words.hashes[np.repeat(at - high, size) + step + skip] >> np.uint64(16) | np.uint64(1)
                powers = np.cumprod(np.full(2 * WINDOW, FACTOR))
                key = mixed(np.add.reduceat(codes * powers[step], begin) + hashes + (low + WINDOW * high).astype(np.uint64))
                order, first = classes(key)
                doc = words.doc[at][order]
                least, most, leaf = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first), order[first]
                rows = []
                for b, r in by_bucket((route[leaf] % np.uint64(buckets)).astype(np.int64)):
                    one = leaf[r]
                    where = np.repeat(begin[one], size[one]) + np.arange(size[one].sum()) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
                    rows.append((b, chunk, parcel(at[one].astype("<u4"), low[one].astype("u1"), high[one].astype("u1"), least[r], most[r] - least[r], hashes[one], *listed(codes[where]))))
                yield sent(rows)

    return send


def subtree(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the first places of repeated windows, with the smallest document of each."""
    parts = [opened(d, "<u4", "u1", "u1", "<i8", "<i8", "<u8", "<u4", "<u2", "<u4") for d in rows["data"]]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    codes = np.concatenate([joined(p[6], p[7])[p[8]] for p in parts])
    at, low, high, least, more, first = (np.concatenate(x) for x in zip(*[p[:6] for p in parts]))
    at, low, high, most = at.astype(np.int64), low.astype(np.int64), high.astype(np.int64), least + more
    size = high - low + WINDOW - ANCHOR
    # Where the words after the anchor begin, and the anchor followed by them.
    anchor = np.cumsum(size) - size + high
    column = np.arange(WINDOW - ANCHOR)
    inside = column < (WINDOW - ANCHOR - low)[:, None]
    after = np.where(inside, codes[np.where(inside, anchor[:, None] + column, 0)], np.uint64(0))
    after = np.hstack([first[:, None], after])
    order = np.lexsort(after.T[::-1])
    after = after[order]
    # Common words of neighbours; the anchor is one column of ANCHOR words.
    common = np.cumprod(after[1:] == after[:-1], axis=1).sum(1) + ANCHOR - 1
    owner, at, low, high, least, most, anchor = (x[order] for x in (owner, at, low, high, least, most, anchor))
    before, found = np.zeros(len(at), np.uint64), []
    for offset in range(WINDOW - ANCHOR + 1):
        if offset:
            known = offset <= high
            before = before * FACTOR + np.where(known, codes[np.where(known, anchor - offset, 0)], np.uint64(0))
        node = np.append(0, np.cumsum(common < WINDOW - offset))
        here = np.flatnonzero((low <= offset) & (offset <= high))
        if len(here):
            together, begin = classes(before[here], node[here])
            here = here[together]
            smallest = np.repeat(np.minimum.reduceat(least[here], begin), np.diff(begin, append=len(here)))
            repeated = smallest < most[here]
            found.append((owner[here[repeated]], at[here[repeated]] - offset, smallest[repeated]))
    owner, start, smallest = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, owner))
    owner, start, smallest = owner[order], start[order], smallest[order]
    cuts = np.searchsorted(owner, np.arange(len(parts) + 1))
    out = [(chunk, parcel(start[a:b].astype("<u4"), smallest[a:b])) for chunk, a, b in zip(rows["chunk"], cuts, cuts[1:]) if b > a]
    return pd.DataFrame(out, columns=["chunk", "data"])


def without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each chunk without the words of repeated windows."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
    for batch in batches:
        for data, replies in zip(batch.column(1), batch.column(2)):
            words = Words(data.as_py())
            change = np.zeros(len(words.hashes) + 1, np.int64)
            if replies.is_valid:
                start, smallest = (np.concatenate(x) for x in zip(*[opened(r, "<u4", "<i8") for r in replies.as_py()]))
                every = words.runs(WINDOW)
                key, one = np.unique(every[start], return_index=True)
                smallest = smallest[one]
                place = np.minimum(np.searchsorted(key, every[words.windows]), len(key) - 1)
                marked = words.windows[(key[place] == every[words.windows]) & (smallest[place] < words.doc[words.windows])]
                np.add.at(change, marked, 1)
                np.add.at(change, marked + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            texts, spans, removed, begin = [], [], [], 0
            for first, n, end in zip(words.first.tolist(), words.counts.tolist(), words.ends.tolist()):
                listed, mine = words.text[begin:end].split(), gone[first : first + n]
                removed.append(int(mine.sum()))
                spans.append([])
                if removed[-1]:
                    listed = compress(listed, ~mine)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
                    spans[-1] = [{"start": a, "length": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
                texts.append(b" ".join(listed).decode())
                begin = end
            ids = pa.array(words.ids, mask=words.ids == NO_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(texts), pa.array(spans, kinds.field("removed").type)], schema=kinds)


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the removed runs (first word, words) of each document."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = stage(source.mapInArrow(chunks, "chunk long, data binary"), "chunks")

    def replied(parcels: DataFrame, work) -> DataFrame:
        answers = parcels.groupBy("bucket").applyInPandas(work, "chunk long, data binary")
        return answers.groupBy("chunk").agg(F.collect_list("data").alias("replies"))

    anchors = replied(stored.mapInArrow(anchor_parcels(buckets), PARCEL), shared_anchors(crowd))
    candidates = stored.join(anchors, "chunk").select("chunk", "data", "replies")
    repeats = replied(candidates.mapInArrow(suffix_parcels(buckets), PARCEL), subtree)
    return stored.join(repeats, "chunk", "left").select("chunk", "data", "replies").mapInArrow(without_repeats, OUT)
