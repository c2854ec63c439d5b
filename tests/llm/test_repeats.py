import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import repeats


def brute(texts, length):
    times = Counter(t[s:s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if times[t[s:s + length]] > 1:
                gone[s:s + length] = True
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def random_texts(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcd é\n") for _ in range(rng.randrange(15, 60))) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = ["".join(rng.choice("abcd é\n") for _ in range(rng.randrange(50))) for _ in range(3)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[:rng.randrange(60)] + parts[2])
    return [*texts, texts[0], "ab" * 70, "x" * 90, "", None, "a" * 19, "a" * 20, "ab" * 40 + "\0" * 50 + "ab" * 30, texts[1] + "\0\0", texts[1] + "\0"]


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 3), (3, 0)])
def test_brute_force(docs, seed, hot):
    texts = random_texts(seed)
    rows = repeats.remove_repeats(docs(list(enumerate(texts))), length=20, gram=6, hot=hot).collect()
    want = brute([(t or "").encode() for t in texts], 20)
    assert len(rows) == len(texts)
    for r in rows:
        assert bytes(r.kept) == want[r.doc_id], (r.doc_id, texts[r.doc_id])
        assert all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_pieces_of_long_texts(docs, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    repeats.anchors.cache_clear()
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [base, "zz" + base[100:500] + "yy", base[:130] + "q" * 40]
    own = repeats.Anchors(20, 6)
    runs = list(own.runs([t.encode() for t in texts]))
    starts = sorted((int(o), s) for r in runs for o, lo, hi in zip(r.owner, r.lo, r.hi, strict=True) for s in range(lo, hi + 1))
    assert starts == [(k, s) for k, t in enumerate(texts) for s in range(len(t) - 19)]
    repeats.anchors.cache_clear()


def test_same_strings_choose_the_same_anchor():
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    own = repeats.Anchors(20, 6)
    picks = {}
    for text in (base, b"xyz" + base[50:300] + base[10:60], base[7:]):
        for r in own.runs([text]):
            for at, lo, hi in zip(r.at, r.lo, r.hi, strict=True):
                for s in range(lo, hi + 1):
                    assert picks.setdefault(text[s:s + 20], at - s) == at - s


def test_interval_tree():
    words = sorted(["banana", "bandana", "band", "can", "candy", "cat"])
    prefix = []
    for x, y in zip(words, words[1:], strict=False):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        prefix.append(n)
    found = {(words[a][:n], b - a + 1) for n, a, b in repeats.intervals(prefix) if n}
    assert found == {("ban", 3), ("band", 2), ("ca", 3), ("can", 2)}


def test_characters_stay_whole(docs):
    shared = "é" * 15
    rows = repeats.remove_repeats(docs([(1, "a" + shared + "ö"), (2, "bè" + shared), (3, "x" + shared[:9])]), length=19, gram=6, characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in rows)


def test_odd_rows(docs, extra):
    passage = "A passage that is found in more than one of the documents. " * 5
    df = extra(docs([(1, passage), (1, passage), (None, "own words:" + passage), (2, None), (3, "short"), (4, "short")]))
    got = repeats.remove_repeats(df).select("doc_id", "kept", "score").collect()
    assert len(got) == 6 and {r.score for r in got} == {"clash"}
    assert {(r.doc_id, bytes(r.kept)) for r in got} == {(1, b""), (None, b"own words:"), (2, b""), (3, b"short"), (4, b"short")}
    assert repeats.remove_repeats(docs([])).collect() == []
