"""Encoding whole texts by columns.

Texts are split by Arrow at places that no token crosses, the pieces of a block
are dictionary-encoded, and only words not met before go through the tokenizer;
the ids of a block are then gathered by NumPy. Ids are those of the whole text.

A Python worker keeps the tokenizer and the ids of words from task to task: words
of at most LONGEST characters, in two generations of STORE bytes together. They go
when no task has encoded for IDLE seconds, so other stages have the memory. Longer
pieces, such as texts without spaces, are encoded each time.
"""

from __future__ import annotations

import os
import re
import sys
import threading
import time
import types
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

BLOCK = 6 * 1024 * 1024
STORE = 160 * 1024 * 1024
LONGEST = 64
IDLE = 6
# Bytes of a stored word besides its characters and ids.
ENTRY = 200

# A space between two graphic characters; pre-tokenisers cut before it.
EDGE = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")
# Texts in which a space stands beside anything but letters and graphic ASCII, or at an end.
ODD = r"^ | $|[^!-~\p{L}] | [^!-~\p{L}]"
# Letters, then punctuation without apostrophes: tokens of their own in both kinds of vocabulary.
# Only letters that stay letters when composed and put in lower case.
CORE = r"^(?P<core>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class Spaced:
    """Chunks for byte-level vocabularies, whose tokens carry the space before a word."""

    lead, fold = " ", False

    def __call__(self, text: str) -> list[str]:
        return EDGE.split(text)


class Bare:
    """Chunks for lower-case vocabularies that drop white space."""

    lead, fold = "", True

    def __call__(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")


spaced, bare = Spaced(), Bare()


def kept(key, make):
    """``make()`` once for the tasks that a Python worker serves, until none has encoded for IDLE seconds."""
    store = sys.modules.setdefault("civiflow_worker_store", types.ModuleType("civiflow_worker_store"))
    things = store.__dict__.setdefault("things", {})
    store.touched = time.monotonic()
    if not things:

        def watch() -> None:
            while time.monotonic() - store.touched < IDLE:
                time.sleep(1)
            things.clear()
            release()

        threading.Thread(target=watch, daemon=True).start()
    if key not in things:
        things[key] = make()
    return things[key]


def release() -> None:
    """Give freed memory back to the system; allocators keep it for the process otherwise."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def touch() -> None:
    sys.modules["civiflow_worker_store"].touched = time.monotonic()


def load(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class Store:
    """Ids of words as bytes of unsigned 32-bit integers; the words met longest ago are forgotten."""

    def __init__(self, tokenizer: Tokenizer, limit: int):
        self.tokenizer, self.limit = tokenizer, limit // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0

    def look(self, words: list[str]) -> list[bytes]:
        found = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if not missing:
            return found
        wanted = [words[i] for i in missing]
        ids = list(map(self.old.get, wanted))
        new = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(new, self.tokenizer.encode_batch_fast([wanted[k] for k in new], add_special_tokens=False)):
            ids[k] = array("I", e.ids).tobytes()
        for i, x in zip(missing, ids):
            found[i] = x
        if max(map(len, wanted)) <= LONGEST:
            short, kept_ids = wanted, ids
        else:
            fits = [len(w) <= LONGEST for w in wanted]
            short, kept_ids = list(compress(wanted, fits)), list(compress(ids, fits))
        self.young.update(zip(short, kept_ids))
        self.used += ENTRY * len(short) + sum(map(len, short)) + sum(map(len, kept_ids))
        if self.used > self.limit:
            self.young, self.old, self.used = {}, self.young, 0
        return found


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def gathered(table: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the entries ``index`` of the table, end to end, and the number of each."""
    flat = np.frombuffer(b"".join(table), "<u4")
    # A block has far fewer than 2^31 ids.
    size = np.fromiter(map(len, table), np.int32, len(table)) // 4
    start = np.cumsum(size, dtype=np.int32) - size
    n = size[index]
    begin = np.cumsum(n, dtype=np.int32) - n
    return flat[np.repeat(start[index] - begin, n) + np.arange(n.sum(), dtype=np.int32)], n


class Encoder:
    """Ids of whole texts with the end id, by one of the two rules for chunks."""

    def __init__(self, path: str, chunks: Spaced | Bare, end: int, store: int = STORE, block_bytes: int = BLOCK):
        self.chunks, self.end, self.block_bytes = chunks, end, block_bytes
        tokenizer = kept(("tokenizer", path), lambda: load(path))
        self.store = kept(("store", path, store), lambda: Store(tokenizer, store))

    def __call__(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        texts = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + self.block_bytes, "right")))
            yield from self.block(texts.slice(i, j - i))
            i = j

    def block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        touch()
        if not self.chunks.lead:
            return self.plain(pc.replace_substring(texts, "\n", " "))
        odd = pc.match_substring_regex(texts, ODD)
        parts = {False: self.plain(texts.filter(pc.invert(odd))), True: self.listed(texts.filter(odd))}
        return (next(parts[x]) for x in odd.to_pylist())

    def plain(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Texts cut at every space."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy().copy()
        table = self.words(coded.dictionary, self.chunks.lead)
        starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - (lists.offsets[0].as_py() if len(texts) else 0)
        if self.chunks.lead and len(texts):
            # No space comes before the first word of a text.
            first, at = np.unique(index[starts], return_inverse=True)
            index[starts] = len(table) + at
            table = table + self.words(coded.dictionary.take(pa.array(first)), "")
        return self.split(table, index, starts)

    def listed(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Texts cut by the rule itself."""
        lists = [self.chunks(t) for t in texts.to_pylist()]
        coded = pa.array([c for x in lists for c in x], pa.large_string()).dictionary_encode()
        counts = np.array([len(x) for x in lists], np.int64)
        return self.split(self.store.look(strings(coded.dictionary)), coded.indices.to_numpy(), np.cumsum(counts) - counts)

    def words(self, words: pa.Array, lead: str) -> list[bytes]:
        """Ids of distinct chunks without spaces, each taken with ``lead`` before it."""
        match = pc.extract_regex(words, CORE)
        core, tail = pc.struct_field(match, [0]), pc.struct_field(match, [1])
        if self.chunks.fold:
            core = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core)
        cores = pc.coalesce(core, words).dictionary_encode()
        tails = pc.fill_null(tail, "").dictionary_encode()
        led = pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), cores.dictionary, pa.scalar("", pa.large_string()))
        core_ids, tail_ids = self.store.look(strings(led)), self.store.look(strings(tails.dictionary))
        table = list(map(core_ids.__getitem__, cores.indices.to_numpy().tolist()))
        # Most words have no tail; the others get a copy with its ids.
        with_ids = np.fromiter(map(len, tail_ids), np.int32, len(tail_ids)) > 0
        ends = tails.indices.to_numpy()
        places = np.flatnonzero(with_ids[ends])
        for i, j in zip(places.tolist(), ends[places].tolist()):
            table[i] += tail_ids[j]
        return table

    def split(self, table: list[bytes], index: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text from the table entries of its chunks."""
        flat, n = gathered(table, index)
        places = np.append(0, np.cumsum(n))
        for a, b in zip(places[starts].tolist(), places[np.append(starts[1:], len(index)).astype(np.int64)].tolist() if len(starts) else []):
            yield np.append(flat[a:b], np.uint32(self.end)).astype("<u4", copy=False)
