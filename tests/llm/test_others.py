"""Chat formatting, WARC archives and neighbour search."""

import hashlib

import numpy as np
import pytest

from civiflow.llm import chat, neighbours, warc

HTML = "<html>é" + "x" * 100


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1\r\n", HTML), (2, None, HTML), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "a\r\n\r\nWARC/1.0\r\n\r\n" * 9), (2, None, HTML)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as shard", "2 as digest")
    rows = sorted(warc.round_trip(spark, df).collect(), key=lambda r: (r.page_id, r.record_type))
    assert len(rows) == len(pages)
    assert [(r.page_id, r.refers_to) for r in rows if r.record_type == "revisit"] == [(2, 1), (2, 1)]
    for r, (_, _, html) in zip(rows, sorted(pages, key=lambda p: p[0])):
        payload = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert warc.round_trip(spark, df.limit(0)).count() == 0


LAYOUTS = {
    "turns": ("conv_id long, turn long, role string, text string", [(1, 1, "assistant", "<a&amp;|"), (1, 0, "user", "hi <|end|>")]),
    "messages": ("conv_id long, messages array<struct<role:string,content:string>>", [(1, [("user", "hi <|end|>"), ("assistant", "<a&amp;|")])]),
    "conversations": ("conv_id long, conversations array<struct<from:string,value:string>>", [(1, [("human", "hi <|end|>"), ("gpt", "<a&amp;|")])]),
    "prompt": ("conv_id long, prompt string, response string", [(1, "hi <|end|>", "<a&amp;|")]),
    "instruction": ("conv_id long, instruction string, input string, output string", [(1, "hi <|end|>", "", "<a&amp;|")]),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_every_layout_reads_back(spark, layout):
    schema, rows = LAYOUTS[layout]
    df = spark.createDataFrame(rows, schema)
    r = chat.digests(chat.formatted(chat.canonical(df))).first()
    text = "user\nhi <|end|>\nassistant\n<a&amp;|\n"
    assert (r.n_turns, r.turns_sha256) == (2, hashlib.sha256(text.encode()).hexdigest())
    assert r.loss_sha256 == hashlib.sha256(b"<a&amp;|").hexdigest()
    assert chat.digests(chat.formatted(chat.canonical(df.limit(0)))).count() == 0


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", "a|>"), (1, 0, "assistant", "a|>"), (2, 5, "a|>b<", "\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as loss")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(df))).collect()}
    assert out[None].n_turns == 1 and out[1].n_turns == 3 and out[1].loss_chars == 6
    assert out[2].turns_sha256 == hashlib.sha256(b"a|>b<\n\n\n").hexdigest()
    with pytest.raises(ValueError):
        chat.canonical(spark.range(1))


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 24))
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    odd = [(4000, None), (4020, []), (4040, [0.0] * 24), (4060, [float("nan")] * 24), (None, rows[0][1]), (4100, [None] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as rank")
    with pytest.raises(ValueError):
        neighbours.search(df.unionByName(spark.createDataFrame([(4080, [1.0], 1, 2)], df.schema)))
    found = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, got in found.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {i for i, _ in got})
        assert np.allclose([x for _, x in got], s[[i for i, _ in got]], rtol=1e-12) and len(got) == 20
    assert len(found) == 150 and hits / 3000 >= 0.9
    assert neighbours.search(df.limit(0)).count() == 0
    few = {r.vec_id for r in neighbours.search(df.where("vec_id in (0, 1, 2)")).collect()}
    assert few == {1, 2}
