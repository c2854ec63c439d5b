from collections import Counter

from tidemark.llm import sharding


def rows(docs, n=403):
    return docs([(i, "t", "en", None if i % 10 == 9 else "hot" if i % 3 else f"s{i % 4}", 1) for i in range(n)])


def test_every_shard_matches_the_mixture(docs):
    got = sharding.interleave(rows(docs), 7, rows_per_bucket=20).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source, n in Counter(r.source for r in got).items():
        share = Counter(r.shard for r in got if r.source == source)
        assert all(abs(share[s] - n / 7) < 2 for s in range(7)), (source, share)


def test_buckets_do_not_change_the_places(docs):
    a, b = ({r.doc_id: (r.shard, r.slot) for r in sharding.interleave(rows(docs), 5, rows_per_bucket=n).collect()} for n in (7, 100_000))
    assert a == b
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(rows(docs), 5, seed="1").collect()}
    assert other != a


def test_odd_rows(docs, extra):
    assert sharding.interleave(docs([]), 4).collect() == []
    df = extra(docs([(None, None, None, None, None), (1, "a"), (1, "a"), (1, "a"), (2, None)]))
    got = sharding.interleave(df, 8).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5 and all(r.score == "clash" for r in got)
    assert max(Counter(r.shard for r in got).values()) == 1
