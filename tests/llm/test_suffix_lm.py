"""The suffix tree against a plain one over tuples of words."""

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import suffix_lm as S
from tidemark.llm.common import crc_mod
from tidemark.llm.hashcounts import planes
from tidemark.session import checkpoint_dir

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_rows():
    return crc_mod("doc_id", 5) == 1


def words_of(text):
    return WORD.findall((text or "").encode().translate(LOWER))


class Plain:
    def __init__(self, texts, least, gain=S.MIN_GAIN, depth=S.DEPTH):
        seqs = Counter()
        for words in texts:
            s = [None, *words, None]
            for i in range(1, len(s)):
                seqs.update(tuple(s[i - k:i + 1]) for k in range(min(i, depth) + 1))
        self.n1 = Counter({s: n for s, n in seqs.items() if len(s) == 1})
        self.tokens, self.words, self.depth = sum(self.n1.values()), len(self.n1), depth
        self.p = {s: (n - S.DISCOUNT) / (self.tokens + 1) for s, n in self.n1.items()}
        self.unknown = (self.words * S.DISCOUNT + 1) / (self.tokens + 1)
        self.rest, gains = {}, {}
        for k in range(2, depth + 2):
            after = defaultdict(list)
            for s, n in seqs.items():
                if len(s) == k and n >= least:
                    after[s[:-1]].append((s, n))
            for ctx, edges in after.items():
                of, held = seqs[ctx], sum(n for _, n in edges)
                self.rest[ctx] = (len(edges) * S.DISCOUNT + of - held) / of
                told = sum(n * math.log(n / of / self.p[s[1:]]) for s, n in edges)
                gains[ctx] = told > gain * (len(edges) + 2)
            for ctx, edges in after.items():
                for s, n in edges:
                    self.p[s] = (n - S.DISCOUNT) / seqs[ctx] + self.rest[ctx] * self.p[s[1:]]
        self.nodes = {ctx[i:] for ctx, ok in gains.items() if ok for i in range(len(ctx))}

    def probability(self, ctx, word):
        if not ctx:
            return self.p.get((word,), self.unknown)
        if ctx not in self.nodes:
            return self.probability(ctx[1:], word)
        return self.p[(*ctx, word)] if (*ctx, word) in self.p else self.rest[ctx] * self.probability(ctx[1:], word)

    def score(self, words):
        s = [None, *words, None]
        return sum(math.log10(self.probability(tuple(s[max(0, i - self.depth):i]), s[i])) for i in range(1, len(s)))


def check(df, texts, **more):
    """texts: (doc_id, text) rows; the spark result row by row."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    model = Plain([words_of(t) for i, t in texts if not held(i)], more.get("min_count") or S.least_count(sum(len((t or "").encode()) for _, t in texts)))
    got = sorted((r.doc_id is not None, r.doc_id, round(r.score, 6), round(r.base_score, 6), r.n_tokens, r.n_known, r.held_out, r.train_tokens)
                 for r in S.score(df, held_rows(), **more).collect())
    base = lambda s: sum(math.log10((model.n1[(w,)] + 0.5) / (model.tokens + 0.5 * (model.words + 1))) for w in s)
    want = sorted((i is not None, i, model.score(words_of(t)), base([*words_of(t), None]), len(words_of(t)) + 1,
                   sum(model.n1[(w,)] > 0 for w in [*words_of(t), None]), held(i), model.tokens) for i, t in texts)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[4:] == w[4:]
        assert g[2:4] == pytest.approx(w[2:4], rel=1e-5, abs=1e-4)
    return model, got


def test_against_a_plain_tree(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model, got = check(df, [(r.doc_id, r.text) for r in df.collect()], block_bytes=100_000)
    assert len(model.nodes) > 100 and any(len(c) == 2 for c in model.nodes)
    new = [(s, b) for _, _, s, b, _, _, held, _ in got if held]
    assert sum(s for s, _ in new) > sum(b for _, b in new)


def test_the_tree_tells_more_than_its_root(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = lambda **more: S.score(rows, held_rows(), **more).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert held() > held(min_count=1 << 40) + 0.03


def test_nodes_grow_with_the_corpus(spark, docs):
    rng = np.random.default_rng(1)
    def nodes(n):
        rows = [(i, " ".join(f"w{rng.integers(n)} follows" for _ in range(200))) for i in range(n)]
        df = docs(rows).selectExpr("doc_id", "cast(text as binary) text", "false held_out")
        return S.train(df, 1 << 20, np.zeros(0, np.int64))[0].nodes.count()
    assert nodes(200) > 3 * nodes(40)


def test_distributions_sum_to_one():
    texts = [words_of(t) for t in ("a b c a b d a b c", "a b c", "b c d a b c", "", "a b a b c", "a b c d")]
    model = Plain(texts, 2, 0.0)
    assert any(len(c) == 2 for c in model.nodes)
    for ctx in [(), *model.nodes, (b"zz", b"b"), (b"zz",)]:
        total = sum(model.probability(ctx, w) for (w,) in model.n1) + model.probability(ctx, b"never")
        assert total == pytest.approx(1)


def test_null_empty_repeated_long_and_clashing(docs, extra):
    long = "tick tock " * 40_000
    rows = [(1, None), (1, ""), (2, "A b\x0bC é"), (2, "A b\x0bC é"), (None, "a b c"), (None, "a b c"), (7, long), (8, " \t\n"), (9, "new words"), (16, "a b c")]
    check(extra(docs(rows)), rows, min_count=2, block_bytes=100_000)
    check(docs([(5, "x")] * 6), [(5, "x")] * 6, block_bytes=1)


def test_nothing_to_learn_from(docs):
    rows = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    found = S.score(docs(rows), held_rows()).collect()
    assert {(r.train_tokens, r.n_known, r.n_tokens, r.score) for r in found} == {(0, 0, 3, 0.0)}
    assert S.score(docs([]), held_rows()).collect() == []


def test_symbol_hashes_tell_texts_apart():
    symbol, text = S.symbols([b"One two", b"", b"one  TWO\n", b"two one"])
    assert text.tolist() == [0, 0, 0, 1, 2, 2, 2, 3, 3, 3]
    a, b = symbol[1], symbol[2]
    assert symbol.tolist() == [S.END, a, b, S.END, S.END, a, b, S.END, b, a, S.END] and len({a, b, S.END}) == 3


def test_the_same_edges_in_a_corpus_of_any_size():
    assert {S.least_count(n) for n in (0, 1_000, 1 << 20, 1 << 30, 1 << 40)} == {2}


def test_sequences_cross_the_shuffle_by_their_first_symbol():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 20_000) % 5_000) for _ in range(4)]
    batch = pa.RecordBatch.from_pydict({"text": [t.encode() for t in texts]})
    live = [SimpleNamespace(value=np.full(1 << 24, 255, np.uint8))] * 2
    chunks = pa.Table.from_batches(list(S.sequence_chunks([batch], live, 6)))
    symbol, _ = S.symbols([t.encode() for t in texts])
    found = S.Sequences.of(symbol)
    want = Counter(found.hashes[2][found.valid[2]].tolist())
    parts = [S.counted_sequences(chunks.filter(pc.equal(chunks.column("range"), r)), 2) for r in range(64)]
    assert {int(s): int(n) for seq, n, *_ in parts for s, n in zip(seq, n)} == want
    pressed = sum(len(zstandard.ZstdCompressor(1).compress(b)) for c in ("gaps", "kinds", "first", "n") for b in chunks.column(c).to_pylist())
    assert pressed < 17 * len(want)  # a row of three hashes and a count has 24 bytes that don't compress


def test_told_by_the_first_bits_of_a_hash():
    near, far = (5 << 40) + 1, (9 << 40) + 7
    tree = pa.table({"seq": np.array([near, near + 1, near, far], np.int64), "kind": np.array([0, 1, 2, 0], np.int8), "value": [3.0, -1.5, -0.5, 8.0]})
    gap = lambda hashes: planes(np.diff([h >> 24 for h in hashes], prepend=0))
    asked = pa.table({"range": pa.array([0, 0, 0], pa.int32()), "block": pa.array([1, 1, 2], pa.int32()), "gaps": [gap([near]), gap([near]), gap([1 << 30])]})
    told = S.told_sequences(asked, tree, 8)
    assert told.column("block").to_pylist() == [1]
    lookup = S.Lookup(told)
    at = lookup.at(np.array([near + 1, far, near, 0, (1 << 64) - 1], np.uint64))
    assert at.tolist() == [1, 2, 0, 2, 2]
    assert lookup.n[:2].tolist() == [3, 0] and lookup.log_p[1] == -1.5 and lookup.log_rest[0] == -0.5 and np.isnan(lookup.log_p[0])


def test_tables_of_the_tree_go_when_texts_are_told(spark, docs):
    before = set(Path(checkpoint_dir(spark)).glob("*"))
    S.score(docs([(i, "a b c a b d") for i in range(20)]), held_rows()).collect()
    left = {p.name.rsplit("-", 1)[0] for p in set(Path(checkpoint_dir(spark)).glob("*")) - before}
    assert left <= {"nodes", "told"} and "told" in left
