"""Language identification by a byte convolutional network.

Filters of several widths over embedded bytes, max pooling over a fixed-length
window and a softmax layer, trained in numpy on a bounded sample of labelled
rows and applied to every window of every whole text.

Text that is null or has no letter gives ``und`` with score 0. Where no row is
labelled, everything is ``und``. Repeated rows and other columns change nothing;
an empty table gives an empty result. Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
BLOCK = 128


def windows_of(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows covering each whole text, and the text each belongs to."""
    counts = np.array([max(1, -(-len(t) // length)) for t in texts])
    padded = b"".join(t.ljust(n * length, b"\0") for t, n in zip(texts, counts.tolist()))
    return np.frombuffer(padded, np.uint8).reshape(-1, length), np.repeat(np.arange(len(texts)), counts)


class ByteNet:
    """Embedding, convolutions of several widths, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"emb": rng.normal(0, 0.5, (256, DEPTH)).astype("f4"), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype("f4"), "bias": np.zeros(len(languages), "f4")}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * DEPTH), (w, DEPTH, FILTERS)).astype("f4")

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """Filter outputs at each position, as sums of one table row per byte."""
        tables = self.p["emb"] @ self.p[f"w{width}"]
        n = x.shape[1] - width + 1
        total = tables[0][x[:, :n]]
        for j in range(1, width):
            total += tables[j][x[:, j : j + n]]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by window, in blocks that fit the cache."""
        out = []
        for i in range(0, len(x), BLOCK):
            block = x[i : i + BLOCK]
            pooled = np.concatenate([self.responses(block, w).max(1) for w in WIDTHS], 1)
            out.append(self.softmax(np.maximum(pooled, 0) @ self.p["out"] + self.p["bias"]))
        return np.concatenate(out)

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tops = []
        for w in WIDTHS:
            r = self.responses(x, w)
            at = r.argmax(1)
            tops.append((at, np.take_along_axis(r, at[:, None], 1)[:, 0]))
        pooled = np.concatenate([t[1] for t in tops], 1)
        hidden = np.maximum(pooled, 0)
        delta = self.softmax(hidden @ self.p["out"] + self.p["bias"])
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        g = {"out": hidden.T @ delta, "bias": delta.sum(0), "emb": np.zeros_like(self.p["emb"])}
        back = (delta @ self.p["out"].T) * (pooled > 0)
        rows = np.arange(len(x))[:, None]
        for k, (w, (at, _)) in enumerate(zip(WIDTHS, tops)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"w{w}"] = np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                byte = x[rows, at + j]
                g[f"w{w}"][j] = np.einsum("nf,nfd->df", d, self.p["emb"][byte])
                np.add.at(g["emb"], byte, d[:, :, None] * self.p[f"w{w}"][j].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 6) -> ByteNet:
        """Adam; each window is cut at a random length so that short texts are known too."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(a) for k, a in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i : i + batch]
                part = x[pick].copy()
                cut = np.where(rng.random(len(pick)) < 0.4, rng.integers(12, WINDOW, len(pick)), WINDOW)
                part[np.arange(WINDOW)[None] >= cut[:, None]] = 0
                step += 1
                for k, g in self.gradients(part, y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    now = rate * (1 - epoch / epochs)
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype("f4")
        return self


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, rows_per_language: int = 500, windows_per_row: int = 3) -> ByteNet | None:
    """Fit on at most ``rows_per_language`` rows of each language, chosen by a hash of the id.

    Of a chosen row ``windows_per_row`` windows, whose places in the whole text a hash
    gives, are learned from (one of all of a shorter text).
    """
    known = docs.where(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Ids first: texts are read for the chosen rows only.
    hashed = known.select("doc_id", "lang", F.xxhash64(F.lit(3), "doc_id").alias("hash"))
    counts = hashed.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    # The lowest hashes, about twice the rows wanted of a language, hold those that are taken.
    share = F.col("hash").bitwiseAND(2**30 - 1) / F.lit(2.0**30)
    low = hashed.withColumn("share", share).join(counts, F.col("lang") == F.col("of")).where(F.col("share") * F.col("n") < 2 * rows_per_language + 50)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("share", "hash", "doc_id"))
    chosen = low.withColumn("rank", rank).where(F.col("rank") <= rows_per_language).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    free = F.greatest(F.length("text") - WINDOW, F.lit(0))
    place = lambda k: (F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(2**30)) / F.lit(2.0**30) * (free + 1)).cast("int") + 1
    drawn = F.array_distinct(F.array(*[F.substring(F.col("text"), place(k), F.lit(WINDOW)) for k in range(windows_per_row)]))
    # rows_per_language rows of windows_per_row windows for each language.
    sample = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("label"))).select("label", drawn.alias("windows"), "id").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["label"], r["id"], r["windows"]))
    languages = sorted({r["label"] for r in sample})
    parts, labels = [], []
    for r in sample:
        x, _ = windows_of([w.encode()[:WINDOW] for w in r["windows"]])
        parts.append(x)
        labels += [languages.index(r["label"])] * len(x)
    return ByteNet(languages).fit(np.concatenate(parts), np.array(labels))


def identify(docs: DataFrame, net: ByteNet | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability, from the text alone."""
    def predict(own: ByteNet | None, texts: pd.Series) -> pd.DataFrame:
        names, best = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        use = np.flatnonzero(texts.notna().to_numpy()) if own else np.zeros(0, int)
        # Some megabytes of text at a time, whatever the lengths.
        start, held, block = 0, 0, []
        for i, row in enumerate(use):
            block.append(texts.iat[row].encode())
            held += len(block[-1])
            if held > 4_000_000 or i == len(use) - 1:
                x, owner = windows_of(block)
                weight = (x != 0).sum(1).astype(float)
                p = np.zeros((len(block), len(own.languages)))
                np.add.at(p, owner, own.predict(x) * weight[:, None])
                p /= np.maximum(p.sum(1, keepdims=True), 1e-9)
                at = use[start : i + 1]
                names[at] = np.array(own.languages, dtype=object)[p.argmax(1)]
                best[at] = np.clip(p.max(1), 0, 1)
                start, held, block = i + 1, 0, []
        return pd.DataFrame({"lang": names, "score": best})

    @F.pandas_udf("lang string, score double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict(net, texts)

    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    # Marked so that the optimiser does not evaluate it once for each use.
    found = docs.withColumn("__found", apply.asNondeterministic()(lettered))
    return found.withColumns({lang: F.col("__found.lang"), score: F.col("__found.score")}).drop("__found")


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` whose language is known with a score of at least ``least``."""
    rows = identify(docs, train(docs), "__lang_pred", "__lang_score")
    return rows.where((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= least)).select(*docs.columns)
