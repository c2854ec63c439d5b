"""Spelling variants against all pairs of a plain vocabulary."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import variants as V


def plain(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[w] = (n, len(close), form, words[form] if form else None)
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return {w: (*x, root(w)) for w, x in out.items()}


def found(df):
    rows = V.group_variants(df).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def noisy(seed, n_docs=60):
    rng = np.random.default_rng(seed)
    letters = list("abcdeéßÿ÷")
    words = ["".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(12)]
    def slip(w):
        at, kind = int(rng.integers(len(w))), int(rng.integers(6))
        c = str(rng.choice(letters))
        return {0: w[:at] + w[at + 1:], 1: w[:at] + c + w[at:], 2: w[:at] + c + w[at + 1:]}.get(kind, w)
    return [(i, " ".join(slip(str(w)).title() if rng.random() < .2 else slip(str(w)) for w in rng.choice(words, 60))) for i in range(n_docs)]


@pytest.mark.parametrize("seed, carried", [(1, 64), (2, 64), (1, 6)])
def test_against_all_pairs(docs, seed, carried, monkeypatch):
    monkeypatch.setattr(V, "CARRIED", carried)  # words beyond it are met by their ids
    rows = noisy(seed)
    want = plain(rows)
    assert found(docs(rows)) == want
    assert sum(x[2] is not None for x in want.values()) > 20
    assert any(want[x[2]][2] for x in want.values() if x[2])  # chains of two steps


def test_chain_and_ties(docs):
    text = " ".join(["abcdefgh"] * 40 + ["abcdefg"] * 12 + ["abcdef"] * 5 + ["abcdeh"] * 5 + ["bcdefgh"] * 12)
    got = found(docs([(3, text)]))
    assert got["abcdef"] == (5, 2, "abcdefg", 12, "abcdefgh")
    assert got["abcdeh"][1:4] == (1, None, None)  # a near word of the same count leads nowhere
    assert got["abcdefgh"] == (40, 2, None, None, "abcdefgh")


def test_null_empty_repeated_and_clashing(docs, extra):
    rows = [(1, None), (1, ""), (None, "zzzzzz zzzzzz"), (None, "zzzzzz zzzzzz"), (4, "12345 ... --")]
    want = plain(rows)
    assert found(extra(docs(rows))) == want and set(want) == {"zzzzzz"}
    assert found(docs([])) == {} and found(docs([(1, None)])) == {}


def test_very_long_words(docs):
    long = "ab" * 60_000
    got = found(docs([(7, f"{long} {long} {long} {long}x {long}x {long}x {long}x {long}x {long}x")]))
    assert {len(w): (x[1], x[2] and len(x[2])) for w, x in got.items()} == {120_000: (1, 120_001), 120_001: (1, None)}


def test_neighbourhoods_hold_every_reduced_edit():
    words = ["aabbc", "abcdefg", "ggggg", "éßaxy"]
    batch = pa.RecordBatch.from_pydict({"word": words, "n": [1] * 4})
    keys = {}
    for out in V.neighbourhoods([batch], ["word"]):
        for key, word in zip(out.column("key").to_pylist(), out.column("word").to_pylist()):
            keys.setdefault(word, []).append(key)
    def reduced(symbols):
        total = sum(int(V.VALUES[s]) * pow(int(V.BASE), i, 1 << 64) for i, s in enumerate(symbols)) % (1 << 64)
        return total - (1 << 64) if total >= 1 << 63 else total
    for word in words:
        s = [b % V.SYMBOLS for b in word.encode("latin-1")]
        less = {tuple(s[:i] + s[i + 1:]) for i in range(len(s))}
        other = {tuple(s[:i] + [c] + s[i + 1:]) for i in range(len(s)) for c in range(s[i] + 1, V.SYMBOLS)}
        assert sorted(keys[word]) == sorted(reduced(x) for x in less | other | {tuple(s)})
