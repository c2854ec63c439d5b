import random
import re
from collections import Counter

import pytest

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(3)
    for _ in range(120):
        yield "".join(rng.choice(["a", "b", "cé", " ", " ", "\n", "\t", "#", "日", "\x0b", " "]) for _ in range(rng.randrange(60)))
    yield from (None, "", " \n ", "a b c", "a a a a", "x y z x y z", "one line\n" * 3, "w " * 30_000, " ".join(map(str, range(20_000))))


def test_counts(docs):
    given = dict(enumerate(texts()))
    for r in quality.measured(docs(list(given.items()))).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(given[r.doc_id]), given[r.doc_id]


def test_estimation_finds_the_rules_accuracies():
    rng = random.Random(5)
    right = [0.95, 0.9, 0.8, 0.6]
    votes = Counter()
    truth = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        v = tuple((1 if good == (rng.random() < p) else -1) if rng.random() < 0.8 else 0 for p in right)
        votes[v] += 1
        truth[v] += good
    odds, ratio = quality.estimate(sorted(votes.items()), rounds=60)
    assert abs(1 / (1 + 2.718281828 ** -odds) - 0.7) < 0.05
    strength = [r[1] - r[-1] for r in ratio]
    assert strength == sorted(strength, reverse=True)
    wrong = sum(min(truth[v], n - truth[v]) if (odds + sum(ratio[j][x] for j, x in enumerate(v)) > 0) == (2 * truth[v] > n) else max(truth[v], n - truth[v])
                for v, n in votes.items())
    assert wrong / 20_000 < 0.06


def test_no_rows_estimate():
    odds, ratio = quality.estimate([])
    assert (odds, ratio) == (0.0, [])


def test_junk_goes_and_prose_stays(spark, sf):
    rows = quality.judge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).drop("text")
    marks = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    got = rows.join(marks, "doc_id").groupBy("label", "base_failed", "kept").count().collect()
    assert sum(r["count"] for r in got if r.label == 0 and r.kept) == 0
    assert sum(r["count"] for r in got if r.label == 1 and not r.kept and not r.base_failed) <= 2


def test_odd_rows(docs, extra):
    prose = " ".join(f"word{i} the text{i} of thing{i}" for i in range(100))
    df = extra(docs([(1, None), (2, ""), (3, prose), (3, prose), (None, "short")]))
    rows = quality.judge(df.drop("kept", "n_words")).collect()
    assert len(rows) == 5 and [r.kept for r in rows if r.doc_id == 3] == [True, True]
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, None))
    assert quality.judge(docs([])).collect() == []


@pytest.mark.parametrize("share,want", [(None, 0), (0.02, -1), (0.07, 0), (0.2, 1)])
def test_votes(spark, share, want):
    df = spark.createDataFrame([(share,)], "stop_share double")
    assert df.select(quality.vote("stop_share", 0.1, 0.04).alias("v")).first().v == want


def test_plan_stays_native(docs):
    plan = quality.judge(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
