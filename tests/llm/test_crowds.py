"""Prefixes shared by many documents, against brute force."""

import random

import pytest

from civiflow.llm import ngram_join

from .test_documents import brute_classes, shingle_sets


def edited(words, places, tag):
    words = list(words)
    for k in places:
        words[k] = f"{tag}e{k}"
    return " ".join(words)


def star(n):
    """A template and variants near to it but not to each other."""
    r, base = random.Random(5), [f"t{i}" for i in range(314)]
    return [(0, " ".join(base))] + [(i, edited(base, r.sample(range(4, 310), 5), i)) for i in range(1, n + 1)]


def lengths(n):
    """Near copies of a text cut at different words, no two alike."""
    r, base = random.Random(6), [f"t{i}" for i in range(400)]
    return [(i, edited(base[: (k := r.randint(120, 400))], r.sample(range(k), r.randint(1, 4)), i)) for i in range(n)]


def brute_links(rows):
    """Links of each document among the pairs sharing a prefix in any tree."""
    sets, out = shingle_sets(rows), {r[0]: 0 for r in rows}
    keys = [set(ngram_join.prefixes(ngram_join.signature(ngram_join.shingles(ngram_join.words_of(t)))).tolist()) for _, t in rows]
    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common >= 0.8 * (len(sets[x]) + len(sets[y]) - common) and keys[x] & keys[y]:
                out[rows[x][0]] += 1
                out[rows[y][0]] += 1
    return out


def test_star_of_a_thousand_is_one_class(spark):
    rows = star(1000)
    found = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, []).append(str(r.doc_id))
    assert sorted(sorted(c) for c in classes.values()) == brute_classes(rows)
    assert len(classes) == 1
    assert next(r.n_links for r in found if r.doc_id == 0) == 1000


@pytest.mark.parametrize("make,n,cell", [(star, 300, 512), (star, 300, 40), (lengths, 500, 512), (lengths, 500, 40)])
def test_every_link_of_a_crowd_is_counted_once(spark, monkeypatch, make, n, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    rows = make(n)
    found = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in found} == brute_links(rows)
