import hashlib

from tidemark.llm import licenses

MIT = licenses.KNOWN[0][1]


def found(df):
    return {(r.doc_id, r.unit): r.license_id for r in df.collect()}


def test_entire_texts_and_lines(docs):
    got = found(licenses.scan(docs([
        (1, MIT),
        (2, "Copyright (c) 2019 A. Person\n\n" + MIT.upper().replace("SUBLICENSE", "sub-license")),
        (3, MIT + "\nand more"),
        (4, "Licensed under the Apache Licence, version 2.0\nprose follows here"),
        (5, "We mention the MIT License here."),
        (6, None), (7, ""), (8, "..."),
    ])))
    assert got[1, 0] == got[2, 0] == "MIT"
    assert got[3, 0] is None and got[4, 0] is None and got[4, 1] == "Apache-2.0"
    assert {k: v for k, v in got.items() if k[0] >= 5} == {(5, 0): None, (6, 0): None, (7, 0): None, (8, 0): None}


def test_digest_of_nothing_repeats_and_long_text(docs, extra):
    rows = licenses.scan(extra(docs([(1, None), (1, None), (2, "x y\n" * 50_000), (None, "Licensed under CC BY 4.0.")]))).collect()
    assert sum(r.doc_id == 1 for r in rows) == 2 and rows[0].digest != ""
    assert {r.digest for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert [r.license_id for r in rows if r.doc_id is None] == ["CC-BY-4.0", "CC-BY-4.0"]
    assert len([r for r in rows if r.doc_id == 2]) == 1


def test_own_table_and_ties(spark, docs):
    known = spark.createDataFrame([("B", "house rules"), ("A", "House  Rules!"), (None, "x"), ("C", None), ("D", "?!")], "license_id string, text string")
    got = found(licenses.scan(docs([(1, "HOUSE RULES"), (2, "x"), (3, "!")]), known))
    assert got[1, 0] == "A" and got[2, 0] is None and got[3, 0] is None
    assert licenses.scan(docs([]), known).collect() == []


def test_plan_stays_native(docs):
    plan = licenses.scan(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_licences_with_title_and_holder(docs):
    bsd = licenses.BSD.format("1. ", "2. ", "3. " + licenses.BSD_THIRD.format("the copyright holder"), *licenses.BSD_PARTIES[0])
    apache = licenses.TEXTS["Apache-2.0"].strip()
    bare = apache[apache.index("TERMS AND CONDITIONS FOR USE"):apache.index("APPENDIX: How to apply")]
    lesser = licenses.TEXTS["LGPL-2.1-only"].replace("51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")
    files = {
        1: ("MIT", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + MIT),
        2: ("MIT", "The MIT License (MIT)\n\nCopyright The Authors\nCopyright Jane Doe\n\n" + MIT),
        3: ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, Jane Doe\nAll rights reserved.\n\n" + bsd),
        4: ("Apache-2.0", apache), 5: ("Apache-2.0", bare), 6: ("LGPL-2.1-only", lesser),
        7: ("ISC", "ISC License\r\n\r\nCopyright Jane Doe <jane@example.org>\r\n\r\n" + licenses.KNOWN[1][1].replace("\n", "\r\n")),
        8: ("Unlicense", next(t for n, t in licenses.KNOWN if n == "Unlicense")),
        **{20 + k: (n, t) for k, (n, t) in enumerate(licenses.TEXTS.items())},
    }
    got = found(licenses.scan(docs([(k, t) for k, (_, t) in files.items()])))
    assert {k: got[k, 0] for k in files} == {k: n for k, (n, _) in files.items()}


def test_running_text_about_copyright_stays(spark):
    lines = ["copyright notice and this permission notice shall be included in all copies", "copyright holder.", "copyright law:", "Copyright is a right of authors to works of theirs"]
    df = spark.createDataFrame([(x,) for x in lines], "text string").select(licenses.canonical("text").alias("t"))
    assert all(r.t for r in df.collect())
