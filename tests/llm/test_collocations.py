"""Collocations against every n-gram counted on its own."""

import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations as C
from tidemark.llm.hashcounts import LIVE_BITS


def plain(rows, least, top=2000, longest=5):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in cand.items():
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(lang == m and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and b >= a for (m, q), b in cand.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, x in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(x)[:top]))


def table(docs, rows):
    return docs([(i, text, lang, "s", 0) for i, (lang, text) in enumerate(rows)])


def found(df, least, **more):
    return sorted(tuple(r) for r in C.mine(df, least, **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counts(docs, seed):
    rng = np.random.default_rng(seed)
    words = ["a", "A", "b", "cc", "É", "x-y", "über"] + [f"r{i}" for i in range(40)]
    share = np.array([20.0] * 7 + [1] * 40)
    marks = [" "] * 30 + [". ", ",", "\t", "  ", "\n", "\x0b", "\r", "!? "]
    rows = [(str(rng.choice(["en", "de", ""])) or None, "".join(str(w) + str(rng.choice(marks)) for w in rng.choice(words, 300, p=share / share.sum()))) for _ in range(40)]
    want = plain(rows, 20)
    assert found(table(docs, rows), 20) == want and len(want) > 50
    assert found(table(docs, rows), 20, top=3) == plain(rows, 20, 3)
    assert found(table(docs, rows), 20, longest=3) == plain(rows, 20, longest=3)


def test_a_full_bit_set_changes_nothing(docs, monkeypatch):
    rows = [("en", "one two three four five six. " * 30), ("en", "one two five one two. " * 10)]
    want = plain(rows, 10)
    assert found(table(docs, rows), 10) == want
    monkeypatch.setattr(C, "live_bits", lambda *_, **__: np.full(1 << (LIVE_BITS - 3), 255, np.uint8))
    assert found(table(docs, rows), 10) == want


def test_overlaps_nulls_and_clashes(docs, extra):
    rows = [(None, "ha ha ha ha ha ha"), ("und", "ha ha"), ("en", None), ("en", ""), ("en", " .,\t\n"), (None, "ha ha ha ha ha ha")]
    want = plain(rows, 5)
    assert found(extra(table(docs, rows)), 5) == want and want[0][3] == 11
    assert found(table(docs, []), 5) == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    big = 6_000_000_000_000_000
    known = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1)], "lang string, phrase string, f long")
    cand = spark.createDataFrame([("en", "a b", ["a", "b"], big - 7)], "lang string, phrase string, words array<string>, a long")
    total = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    row = C.scored(cand, known, total).first()
    assert row.score == 1000 * (big - 7) * 9 * big // (big * (big - 1))
