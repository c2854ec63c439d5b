import numpy as np

from tidemark.llm import langid


def test_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", langid.held_out())
    model = langid.train(df.where("NOT held"))
    rows = langid.predict(df.where("held"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_unknown_and_odd_texts(docs, extra):
    train = docs([(1, "the cat and the dog", "en", "s", 1), (2, "der hund und die katze", "de", "s", 1), (3, None, "en", "s", 1), (4, "x", None, "s", 1)])
    model = langid.train(train)
    assert model[0] == ["de", "en"]
    rows = langid.predict(extra(docs([(1, None), (2, ""), (3, "12 34 ?!"), (4, "und die katze"), (5, "the dog"), (5, "the dog"), (6, "the and " * 400_000)])), model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert [got[k][0] for k in (4, 5, 6)] == ["de", "en", "en"] and len(rows) == 7


def test_slices_of_a_long_text_add_up(monkeypatch):
    grams = langid.Grams(orders=(1, 3))
    text = "some words of a text " * 30

    def bag(parts):
        return [np.sort(np.concatenate([b[k] for _, _, b in parts])) for k in range(2)]
    whole = bag(list(grams.slices([text])))
    monkeypatch.setattr(langid, "SLICE", 50)
    cut = bag(list(grams.slices([text])))
    assert (whole[1] == cut[1]).all() and len(cut[0]) >= len(whole[0])


def test_grams_stay_within_texts():
    grams = langid.Grams(orders=(2,))
    alone = np.concatenate([b[0] for t in ("ab", "cd", "e") for _, _, b in grams.slices([t])])
    together = np.concatenate([b[0] for _, _, b in grams.slices(["ab", "cd", "e"])])
    assert (alone == together).all()


def test_nothing_to_learn(docs):
    model = langid.train(docs([]))
    row = langid.predict(docs([(1, "text")]), model).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert langid.predict(docs([]), model).collect() == []


def plain_buckets(text):
    """Hashed n-grams of the whole text, one character after the other."""
    mix = [2654435761, 2246822519, 3266489917]
    codes = [32, *(ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text), 32] if text else []
    for n in langid.ORDERS:
        for i in range(len(codes) - n + 1):
            value = 0
            for c, m in zip(codes[i:i + n], mix):
                value = (value ^ c) * m % (1 << 32)
                value ^= value >> 15
            yield (value + n) % (1 << 32) % langid.BUCKETS


def test_against_a_plain_model(docs):
    rows = [(1, "The cat sat on the mat, twice.", "en"), (2, "A dog!", "en"), (3, "Der Hund läuft über die Straße", "de"), (4, "Ein ÄÖÜ 12", "de"), (5, None, "fr"),
            (6, "Le chien est là", "fr"), (7, "", "en"), (8, "x", None)]
    languages, prior, logs = langid.train(docs([(i, t, lang, "s", 1) for i, t, lang in rows]))
    assert languages == ["de", "en", "fr"]
    counts = {lang: np.bincount([b for _, t, x in rows if x == lang for b in plain_buckets(t or "")], minlength=langid.BUCKETS) for lang in languages}
    of = [sum(x == lang for *_, x in rows) for lang in languages]
    assert np.allclose(prior, np.log(np.array(of) / sum(of)))
    want = {lang: np.log((n + langid.SMOOTHING) / (n.sum() + langid.SMOOTHING * langid.BUCKETS)) for lang, n in counts.items()}
    for k, lang in enumerate(languages):
        assert np.allclose(logs[:, k], want[lang])
    texts = {1: "the mat", 2: "die Straße und ein Hund", 3: "chien", 4: "Ω zz", 5: "On the dog là"}
    got = {r.doc_id: r for r in langid.predict(docs(list(texts.items())), (languages, prior, logs), fit="fit").collect()}
    for i, text in texts.items():
        grams = list(plain_buckets(text))
        total = np.array([prior[k] + sum(want[lang][b] for b in grams) for k, lang in enumerate(languages)])
        share = np.exp(total - total.max())
        r, best = got[i], int(total.argmax())
        assert (r.lang_pred, r.fit_n) == (languages[best], len(grams))
        assert np.isclose(r.score, share[best] / share.sum()) and np.isclose(r.fit, (total[best] - prior[best]) / len(grams))
