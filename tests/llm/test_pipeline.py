import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tidemark.llm import catalog


def test_registered():
    names = [n.partition("_")[0] for n in catalog.QUERIES]
    assert names == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(catalog.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_copies", "repeats", "packing"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows after each stage, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stages_keep_columns_and_shrink(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == stages[0].columns and 0 < after.count() <= before.count()


def test_near_copies_leave_one_of_each_class(stages):
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    before, after = ({r.doc_id: shingles(r.text) for r in df.collect()} for df in stages[2:4])
    kept = list(after.items())
    for k, (a, x) in enumerate(kept):
        assert all(len(x & y) < 0.8 * len(x | y) for _, y in kept[:k])
    for a, x in before.items():
        assert a in after or any(len(x & y) >= 0.8 * len(x | y) for b, y in before.items() if b != a)


def test_repeated_passages_are_gone(stages):
    before, after = ({r.doc_id: r.text.encode() for r in df.collect()} for df in stages[3:5])
    from collections import Counter
    times = Counter(t[s:s + 200] for t in before.values() for s in range(len(t) - 199))
    for i, text in before.items():
        gone = bytearray(len(text))
        for s in range(len(text) - 199):
            if times[text[s:s + 200]] > 1:
                gone[s:s + 200] = b"\1" * 200
        want = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        got = after.get(i, b"")
        assert got == want or abs(len(got) - len(want)) <= 6  # characters at the ends of a run stay whole
        assert got.decode() is not None


def test_every_document_is_packed(stages):
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in stages[4].collect()}
    assert all(0 < r.length <= 4096 and r.offset + r.length <= 4096 for r in packed)


def test_odd_documents(spark, docs, sf):
    prose = " ".join(f"word{i} the text{i} of thing{i}" for i in range(60))
    df = docs([(1, None, None, None, None), (None, "", "en", "s", 0), (2, prose, "en", "s", 5), (2, prose, "en", "s", 5), (3, "12 !", None, "s", 1)])
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
    assert {r.doc_id for r in df.collect()} <= {2} and df.count() == 1


def test_empty_table(spark, docs, sf):
    df = docs([])
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
    assert df.collect() == []


def test_unlearned_languages_and_noise_go(spark, docs, sf):
    import random
    draw = random.Random(0)
    words = {
        "en": "the house stands on a green hill and every morning people walk down to the river with their children because water is good there in summer".split(),
        "de": "das haus steht auf einem hohen berg und jeden morgen gehen die leute mit ihren kindern zum fluss weil das wasser dort im sommer gut ist".split(),
    }
    rows = [(k, " ".join(draw.choices(words[lang], k=draw.randint(20, 200))), lang, "s", 1) for k, lang in enumerate(["en", "de"] * 150)]
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 3
    noise = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz   ", k=900))
    code = "for (int i = 0; i < n; i++) { if (a[i] > max) { max = a[i]; } } return max; " * 5
    odd = [(1001, finnish, None, "s", 1), (1002, noise, None, "s", 1), (1003, code, None, "s", 1), (1004, "Все люди рождаются свободными и равными", None, "s", 1)]
    short = [(2001, "The house stands on a hill.", None, "s", 1), (2002, "Das Wasser ist gut.", None, "s", 1)]
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs(rows + odd + short), sf).collect()}
    assert got == {r[0] for r in rows + short}


def test_clashing_columns_and_order(spark, docs, sf):
    """Columns named like those that operators add are carried along, in their places."""
    from pyspark.sql import functions as F

    names = ["key", "kept", "removed", "copies", "spans", "_row", "_language", "_language_score", "_text", "_turn", "_kept", "measured", "quality", "n_words", "fit_n", "a.b"]
    df = spark.read.parquet(f"{sf}/documents.parquet").select(*[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names], "doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == [*names, "doc_id", "text", "lang", "source", "n_chars"]
    rows = df.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names) and all(r.n_chars == len(r.text) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).select("doc_id").distinct().count() == len(rows)
