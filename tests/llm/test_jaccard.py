import random
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import jaccard
from tidemark.llm.components import components


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set())
    root, links = list(range(len(texts))), [0] * len(texts)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {k: (top(k), links[k]) for k in range(len(texts))}


def near_texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(8):
            own = base[:]
            for _ in range(k):
                own[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(own))
    return [*texts, texts[0].upper(), texts[3].replace(" ", "\n"), None, "", " ", "one two", "ONE two", "one", "a b c d e", None]


@pytest.mark.parametrize("block_sets,block_grams", [(1024, 400_000), (3, 400_000), (1024, 500)])
def test_brute_force(docs, block_sets, block_grams):
    texts = near_texts()
    rows = jaccard.near_classes(docs(list(enumerate(texts))), block_sets=block_sets, block_grams=block_grams).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == brute(texts)


def test_bands():
    bands, rows = jaccard.choose_bands(0.8, 0.9999, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8 ** rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.9999, 8)


def test_hashes_of_long_texts_do_not_depend_on_slices(monkeypatch):
    texts = [b"some words in a row " * 40, b"x" * 300 + b" y", b"", b"  a b c d e f  "]
    whole = list(jaccard.NGrams().of(texts))
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    cut = list(jaccard.NGrams().of(texts))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, cut, strict=True))


def test_odd_rows(docs, extra):
    text = "the same seven words in every row"
    df = extra(docs([(5, text), (5, text), (None, text), (2, text + " "), (9, None), (9, "")]))
    rows = jaccard.near_classes(df).collect()
    assert len(rows) == 6
    assert {(r.doc_id, r.class_id, r.n_links) for r in rows} == {(5, 2, 3), (None, 2, 3), (2, 2, 3), (9, 9, 0)}
    assert jaccard.near_classes(docs([])).collect() == []
    kept = jaccard.first_of_class(df, jaccard.near_classes(df)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(2, text + " ")] and len(kept) == 3


def test_matrix_of_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(30)]
    got = jaccard.linked(sets, 0.5)
    for a in range(30):
        for b in range(30):
            common = len(np.intersect1d(sets[a], sets[b]))
            assert got[a, b] == (a != b and common / (len(sets[a]) + len(sets[b]) - common) >= 0.5)


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(7, 7), (None, 3)]
    root = {n: n for e in edges for n in e if n is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None:
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: top(n) for n in {x for e in edges if e[0] is not None and e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []
