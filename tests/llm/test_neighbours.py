"""Nearest vectors against every product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>"


def every_fifth():
    return F.pmod("id", F.lit(5)) == 0


def plain(vectors, k, every=5):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            score = np.zeros(len(ids))
            for d in range(x.shape[1]):
                score += x[:, d] * q[d]
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df, k):
    out = {}
    for r in sorted(N.nearest(df, every_fifth(), k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def table(spark, vectors):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in vectors.items()], SCHEMA)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(7) * rng.uniform(0.1, 3) for i in range(-20, 40)}
    assert found(table(spark, vectors), 6) == plain(vectors, 6)
    assert found(table(spark, vectors), 100) == plain(vectors, 100)


def test_recall_of_many_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_BLOCK", 300)
    monkeypatch.setattr(N, "SAMPLE", 1500)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    vectors = {i: centres[rng.integers(30)] + rng.standard_normal(24) for i in range(4000)}
    want, got = plain(vectors, 10), found(table(spark, vectors), 10)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    near = lambda a: {i for i, _ in a}
    assert np.mean([len(near(got[q]) & near(want[q])) / 10 for q in want]) >= 0.95
    exact = {q: dict(plain({**{q: vectors[q]}, **{i: vectors[i] for i, _ in got[q]}}, 10)[q]) for q in list(got)[:50]}
    assert all(dict(got[q]) == exact[q] for q in exact)


def test_copies_of_a_third(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_BLOCK", 20)
    rng = np.random.default_rng(3)
    one = rng.standard_normal(5)
    vectors = {i: one if i % 3 == 0 else rng.standard_normal(5) for i in range(120)}
    assert found(table(spark, vectors), 8) == plain(vectors, 8)


def test_unusable_vectors_repeated_ids_and_clashes(spark, extra):
    x = [1.0, 0.5]
    rows = [(0, x), (5, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []),
            (None, x), (8, [2.0, 2.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [-1.0, 0.0])]
    got = found(extra(spark.createDataFrame(rows, SCHEMA)), 3)
    assert got == {0: [(8, 1.5), (5, 0.75), (9, -1.0)], 5: [(8, 1.0), (0, 0.75), (9, -0.5)]}
    assert found(spark.createDataFrame([], SCHEMA), 3) == {} and found(spark.createDataFrame(rows[:1], SCHEMA), 3) == {}
    with pytest.raises(ValueError):
        N.nearest(spark.createDataFrame([(1, [1.0]), (2, x)], SCHEMA), every_fifth())


def test_mass_bounds_hold():
    ends, shares = N.mass_bounds(64)
    x = np.random.default_rng(0).standard_normal((100_000, 64)) ** 2
    for end, share in zip(ends[:-1], shares):
        assert (x[:, :end].sum(1) > share * x.sum(1)).mean() < 1e-4
