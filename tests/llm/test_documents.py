"""Operators on documents: odd rows, empty tables, brute force."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiflow.llm import exact_dedup, language, mixing, ngram_join, packing, pii, token_files
from civiflow.plans.staging import stage

from .conftest import LONG, ROWS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "operator",
    [
        exact_dedup.exact_groups,
        exact_dedup.drop_copies,
        mixing.mix,
        mixing.mixed_rows,
        ngram_join.similar_classes,
        ngram_join.drop_similar,
        packing.pack,
        token_files.round_trip,
        language.accepted,
        lambda d: pii.digests(pii.find(d)),
    ],
)
def test_empty_tables_and_clashing_columns(operator, docs, no_docs):
    assert operator(no_docs).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("row", "kept", "digest", "taken", "size", "score", "part", "node", "spans")})
    plain, clashing = operator(docs), operator(clash)
    names = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(str, clashing.select(*names).collect())) == sorted(map(str, plain.select(*names).collect()))


def test_exact_groups(docs):
    rows = {(r.doc_id, r.kept): r for r in exact_dedup.exact_groups(docs, counters=2).collect()}
    assert rows[(3, False)].keep_id == 1
    assert sorted(r.group_size for r in rows.values() if r.doc_id in (4, 5, 6)) == [3, 3, 3]
    assert rows[(6, True)].keep_id == 6
    assert exact_dedup.exact_groups(docs).where("kept").count() == 6
    assert exact_dedup.drop_copies(docs).count() == 6


def test_misra_gries_bounds():
    items = ["a"] * 50 + [str(i) for i in range(60)] + ["b"] * 40
    counts = exact_dedup.misra_gries({}, iter(items), 4)
    assert len(counts) <= 4 and 50 - 150 / 5 <= counts["a"] <= 50


def test_mix_targets_and_limits(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)


def shingle_sets(rows):
    out = []
    for _, text, *_ in rows:
        w = (text or "").lower().encode().split()
        out.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_classes(rows):
    sets, parent = shingle_sets(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(map(str, c)) for c in classes.values())


def test_similar_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for r in ngram_join.similar_classes(docs).collect():
        found.setdefault(r.class_id, []).append(str(r.doc_id))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(sorted(c) for c in found.values()) == brute_classes(rows)


def test_similar_odd_rows_and_crowds(spark, docs):
    rows = {r.doc_id: r for r in ngram_join.similar_classes(docs).collect()}
    assert rows[8].class_id == 7 and rows[7].n_links == 1
    assert rows[4].class_id == rows[5].class_id == rows[6].class_id == 4
    base = [f"t{i}" for i in range(120)]
    crowd = [(i, " ".join([*base[: 20 + i], "changed", *base[21 + i :]])) for i in range(60)]
    many = spark.createDataFrame(crowd, "doc_id long, text string")
    assert ngram_join.similar_classes(many).select("class_id").distinct().count() == 1
    assert ngram_join.drop_similar(many).count() == 1


def test_packing_keeps_every_id(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, *_ in ROWS)
    ids = np.array([*t.encode(LONG, add_special_tokens=False).ids, 1], "<u4")
    for r in (r for r in rows if r.doc_id == 7):
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


@pytest.mark.parametrize("name,chunks", [("byte_bpe_50k.json", packing.spaced), ("word_bpe_49k.json", packing.bare)])
def test_chunks_give_ids_of_whole_text(name, chunks):
    path = public_tokenizers.path(name)
    texts = ["a  b   c\n d \ne\t f", "", "  x ", "it's 12 34 <|endoftext|> x<|endoftext|>y", "é́ ́a \x1c d\x85 e", "ΑΣ ΒΣ", "a\r\n\r\nb  \n  c"]
    whole = Tokenizer.from_file(path)
    for text, ids in zip(texts, packing.Encoder(path, chunks, 0)(texts)):
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]


def test_token_files(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    start = 0
    for r, (_, text, *_) in zip(rows, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.train(docs)).where(language.held_out() & F.col("lang").isNotNull())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_of_odd_rows(docs):
    rows = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (4, 5, 6))
    assert 0 <= rows[7].score <= 1 and rows[7].lang_pred != "und"
    assert language.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_personal_data(spark):
    texts = {
        1: "mail é a.b@c.de_x@y.org, 1.2.3.4.5.6.7.8 and 300.1.1.1",
        2: "4111 1111-1111 1111 call +49 (30) 123-45678 now. " + "9" * 5000 + " " + "1 " * 5000,
        3: None,
        4: "x@y.. " + "a." * 4000 + "@b",
    }
    rows = {r.doc_id: r for r in pii.digests(pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()}
    base = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")]
    plain = [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in base for m in re.finditer(pattern, texts[1])]
    assert len(plain) == 5 and rows[1].spans == ",".join(plain[:4])
    assert rows[2].n_card == 1 and rows[2].n_phone == 1
    assert rows[3].spans == "" and rows[4].n_email == 0
    for m in re.finditer(r"card:(\d+):(\d+)", rows[2].spans):
        assert texts[2][int(m[1]) : int(m[2])] == "4111 1111-1111 1111"


def test_staged_rows_are_found(docs):
    assert stage(docs).count() == len(ROWS)
