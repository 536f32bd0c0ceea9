"""Substring removal, vector codes and hard negatives against brute force."""

import hashlib
import random
import re
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from civiflow.llm import encoding, hard_negatives, mixing, pii, substring_dedup, token_files, vector_codes, warc

from civiflow.plans.staging import stage

from .conftest import ROWS
from .test_documents import brute_classes


def brute_kept(rows, width=substring_dedup.WINDOW):
    """(id, words, removed, kept text) of every row."""
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in rows:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(least.get(key, np.inf), np.inf if d is None else d)
    out = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < (np.inf if d is None else d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows.collect()), key=str)


PASSAGE = " ".join(f"p{i}" for i in range(60))
ODD = [
    (20, f"start {PASSAGE} end of\tit"),
    (21, f"another\x0bstart {PASSAGE}"),
    (21, f"another\x0bstart {PASSAGE}"),
    (22, PASSAGE),
    (None, f"x {PASSAGE} y"),
    (None, PASSAGE),
    (23, " ".join(PASSAGE.split()[:13])),
    (24, " ".join(PASSAGE.split()[:12])),
    (25, "a " * 40),
    (26, "a " * 30 + "b"),
    (27, "é " * 14 + "  x"),
    (28, "é\n" * 13),
]


@pytest.mark.parametrize("crowd", [substring_dedup.CROWD, 0])
def test_repeated_words_of_odd_rows(spark, docs, crowd):
    rows = [r[:2] for r in ROWS] + ODD
    table = spark.createDataFrame(rows, "doc_id long, text string")
    clash = table.withColumns({c: F.lit("x") for c in ("chunk", "data", "bucket", "replies", "n_words")})
    assert found(substring_dedup.remove_repeats(clash, crowd)) == brute_kept(rows)
    assert substring_dedup.remove_repeats(table.limit(0), crowd).count() == 0
    one = substring_dedup.remove_repeats(table, crowd).where("doc_id = 20").first()
    assert one.removed == [] and one.n_removed == 0
    spans = {(r.start, r.length) for r in substring_dedup.remove_repeats(table, crowd).where("doc_id = 22").first().removed}
    assert spans == {(0, 60)}


@pytest.mark.parametrize("chunk,crowd", [(4096, 100_000), (4096, 3), (2**22, 3)])
def test_a_passage_of_many_documents(spark, monkeypatch, chunk, crowd):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    rows = []
    for d in range(400):
        own = [f"w{x}" for x in rng.integers(0, 40, rng.integers(5, 80))]
        if d % 3 == 0:
            at = rng.integers(0, len(own))
            own[at:at] = PASSAGE.split()[rng.integers(0, 20) : rng.integers(30, 60)]
        rows.append((int(rng.integers(0, 10**6)), " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(substring_dedup.remove_repeats(table, crowd)) == brute_kept(rows)


def brute_codes(vectors):
    """Codes, errors and codebooks of rows (id, values) sorted by id."""
    v = np.floor(1024 * np.array([x for _, x in vectors])).astype(np.int64)
    parts = v.reshape(len(v), 4, -1)
    book = parts[:256].transpose(1, 0, 2).copy()
    for step in range(5):
        d = ((parts[:, :, None] - book[None]) ** 2).sum(3)
        own = d.argmin(2)
        if step < 4:
            for p in range(4):
                for e in np.unique(own[:, p]):
                    book[p, e] = parts[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
    return ["".join(f"{x:02x}" for x in row) for row in own], d.min(2).sum(1), hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest()


def test_vector_codes_equal_plain_lloyd(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    values = [(i, [float(x) for x in centres[rng.integers(40)] + rng.normal(size=16) / 5], i % 3 if i % 7 else None) for i in range(1500)]
    values[700] = (700, values[10][1], 1)
    odd = [(9000, None, 1), (9001, [float("nan")] * 16, 1), (9002, [None] * 16, 1), (9003, [float("inf")] * 16, 1), (9004, [], 1)]
    table = spark.createDataFrame(values + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as own", "2 as v", "'x' as code")
    rows = {r.vec_id: r for r in vector_codes.digests(table).collect()}
    codes, errors, sha = brute_codes([(i, x) for i, x, _ in values])
    assert len(rows) == 1500
    by_label = {}
    for (_, _, label), e in zip(values, errors):
        by_label[label] = by_label.get(label, 0) + e
    for i, _, label in values:
        r = rows[i]
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == (codes[i], errors[i], by_label[label], sha)
    # The bounds spare most distances in the last pass.
    assert np.mean([r.scanned for r in rows.values()]) < 0.4 * 4 * 256
    few = vector_codes.digests(table.where("vec_id < 3")).collect()
    assert [r.error for r in few] == [0, 0, 0] and vector_codes.digests(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.digests(table.select("vec_id", "label", F.expr("slice(embedding, 1, 6) as embedding")))


def brute_negatives(rows, every=100):
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, np.floor(256 * np.array(x)).astype(np.int64)) for i, x, l in rows]
    out = []
    for a, la, x in rows:
        if a % every:
            continue
        scores = sorted((-int(x @ y), b, lb) for b, lb, y in rows if b != a)
        for s, p, _ in [t for t in scores if t[2] == la][:5]:
            fits = [t for t in scores if t[2] != la and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block,anchors,step", [(2048, 4096, 256), (100, 8, 32)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, anchors, step):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("STEP", step), ("MEMBERS", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(10, 12))
    rows = [(i, [float(x) for x in centres[i % 10] + rng.normal(size=12) / 2], int(rng.integers(10))) for i in range(900)]
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(50)] + [(3000, [0.0] * 12, 3), (3100, [-1e-3] * 12, 4)]
    odd = [(4000, None, 1), (4100, [float("nan")] * 12, 1), (4200, [None] * 12, 1), (4300, rows[0][1], None), (None, rows[0][1], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as key", "2 as b", "3 as q", "4 as rank")
    got = sorted(tuple(r) for r in hard_negatives.mine(table, 20).collect())
    assert got == brute_negatives(rows, 20)
    assert hard_negatives.mine(table.limit(0)).count() == 0


def test_walks_end_early():
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(20, 8)) * 3000
    own = np.floor(centres[rng.integers(20, size=64)] + rng.normal(size=(64, 8)) * 50)
    others = np.floor(centres[rng.integers(20, size=5000)] + rng.normal(size=(5000, 8)) * 50)
    walk = hard_negatives.Walk(np.arange(64), np.arange(64), np.zeros(64), own, None)
    walk.meet(np.arange(100, 5100), np.zeros(5000), others)
    assert walk.walked < 0.5 * 64 * 5000
    best = np.sort(own @ others.T, 1)[:, ::-1][:, :5]
    assert (walk.best[0].scores == best).all()


@pytest.mark.parametrize("name,rule", [("byte_bpe_50k.json", encoding.spaced), ("word_bpe_49k.json", encoding.bare)])
def test_random_texts_have_the_ids_of_whole_texts(name, rule):
    path = public_tokenizers.path(name)
    whole, r = Tokenizer.from_file(path), random.Random(12)
    pieces = ["a", "B", "É", "ß", "Σ", "中文", " ", "  ", "\n", "\t", ",", ".", "'s", "'", "9", "12", "<|endoftext|>", "-", "_", "\x1c", "́", "H̱", " ", "x" * 70, "word", "İ", "٣", "ﬁ", "​", "don't", "<|", "|>", "IT'S"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 14))) for _ in range(4000)] + ["中" * 3000, "QUJD" * 2000, "", " "]
    for store in (encoding.STORE, 5000):
        found = list(encoding.Encoder(path, rule, 3, store)(pa.array(texts)))
        assert len(found) == len(texts)
        for text, ids in zip(texts, found):
            assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 3], text


def test_store_of_words_is_bounded():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = encoding.Encoder(path, encoding.bare, 1, 200_000)
    for i in range(20):
        list(encoder([" ".join(f"w{i}x{j}" for j in range(500)), "文" * 5000 + str(i)]))
    held = [*encoder.store.young.items(), *encoder.store.old.items()]
    assert sum(encoding.ENTRY + len(w) + len(x) for w, x in held) < 400_000 and max(len(w) for w, _ in held) <= encoding.LONGEST


def test_chosen_documents_and_footers(spark, docs, tmp_path):
    path = f"{tmp_path}/tokens"
    token_files.write(docs, path)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    chosen = token_files.documents_of(spark, path, [7, 9])
    assert {r.doc_id: r.ids for r in chosen.collect()} == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x, *_ in ROWS if i in (7, 9)}
    assert "PushedFilters: [In(doc_id" in chosen._jdf.queryExecution().toString()
    groups = 0
    for f in tmp_path.glob("tokens/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = columns["ids.list.element"]
            assert "DELTA_BINARY_PACKED" in ids.encodings and columns["doc_id"].has_column_index and ids.has_offset_index
            groups += 1
    assert groups


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def base_spans(text):
    """Spans of the base rule as (start, kind, end)."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), list(BASE).index(kind), m.end()))
    return sorted(out)


def test_base_spans_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, "\ue001info@site.com x \ue000a@b.c\ue001"), (-2, "1\ue0002 4111\ue0001111 1111 1111 1.2\ue001.3.4"), (-3, "ip 10[.]1[.]2[.]3 card 4111.1111.1111.1111 x")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, text in texts.items():
        assert [(s.start, s.kind, s.stop) for s in found[i].spans if s.base] == base_spans(text), text[:200]
    loose = {r.doc_id: [s.kind for s in r.spans] for r in pii.candidates(docs.where("doc_id = -3")).collect()}
    assert sorted(loose[-3]) == [1, 2]


def test_archives_of_repeated_rows_have_valid_records(spark):
    html = "<html>" + "y" * 200
    pages = [(1, "u", html)] * 50 + [(2, "u", html), (3, "v", "short"), (3, "v", "short")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    rows = warc.round_trip(spark, table).collect()
    assert len(rows) == len(pages) and sum(r.record_type == "response" for r in rows) == 3
    assert {(r.page_id, r.refers_to, r.payload_bytes) for r in rows if r.record_type == "revisit"} == {(1, 1, 206), (2, 1, 206)}
    head = warc.record(2, "u", "", 206, "d", "revisit", 1, "2024-01-01T00:00:00Z").decode().split("\r\n\r\n")[0]
    names = [line.split(": ")[0] for line in head.split("\r\n")[1:]]
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Profile"} <= set(names)


def test_targets_share_the_excess_by_weight(docs, spark):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, r.source_size)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    assert sum(sizes.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in ROWS)
    left, targets, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > 2 * sizes[s]}
        targets.update({s: 2.0 * sizes[s] for s in full} or {s: weights[s] * level for s in free})
        left -= sum(2 * sizes[s] for s in full)
        free = free - full if full else set()
    for r in rows:
        assert r.target == pytest.approx(targets[r.source], abs=1e-6)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(cp.STAGES)
    known = stage(stages["language_id"](spark, docs, sf), "t1")
    assert known.columns == docs.columns
    dropped = docs.join(known, "doc_id", "left_anti").select("text").collect()
    assert known.count() >= 0.9 * docs.where(F.col("lang").isNotNull()).count() and all(r.text is None or len(r.text) < 2000 for r in dropped)
    once = stage(stages["exact_dedup"](spark, known, sf), "t2")
    best = {}
    for r in known.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for _, i in best.values())
    apart = stage(stages["ngram_join"](spark, once, sf), "t3")
    classes = brute_classes([tuple(r) for r in once.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(min(map(int, c)) for c in classes)
    mix = stage(stages["mix_sources"](spark, apart, sf), "t4")
    taken = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert mix.columns == docs.columns and set(taken) <= {r.doc_id for r in apart.collect()} and max(taken.values()) <= 2
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in mix.collect()}
    pieces = stages["packing"](spark, mix, sf).collect()
    length = {}
    for r in pieces:
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(cut.tobytes()) and len(cut) == r.length
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {i: len(ids[i]) * n for i, n in taken.items()}


def test_idle_workers_give_memory_back(monkeypatch):
    called = []
    monkeypatch.setattr(encoding, "IDLE", 0)
    monkeypatch.setattr(encoding, "release", lambda: called.append(1))
    encoding.kept("idle", list)
    deadline = time.monotonic() + 5
    while not called and time.monotonic() < deadline:
        time.sleep(0.1)
    assert called
    sys.modules["civiflow_worker_store"].things.clear()
