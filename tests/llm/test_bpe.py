import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
WANT = tiktoken.Encoding("want", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}).encode_ordinary
SMALL = bpe.Codec(RANKS, leaf=5, window=2)
TEXT = st.text(st.sampled_from("ab'sté 1\n\t  \x1c!日"), max_size=80)


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_tree_is_the_library(text):
    assert SMALL.encode(text) == WANT(text)
    assert SMALL.decode(SMALL.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXT, st.data())
def test_join_is_associative(text, data):
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    n = len(text)
    x, y, z = (SMALL.leaf_ids(t) for t in (text[:a], text[a:b], text[b:]))
    left = SMALL.join(text, 0, b, n, SMALL.join(text, 0, a, b, x, y) if 0 < a < b else x + y, z) if b < n else WANT(text)
    assert left == WANT(text) or not 0 < b


def test_long_runs():
    codec = bpe.Codec(RANKS)
    for text in ("a" * 60_000, "word " * 20_000, " " * 50_000 + "x", "\n\n x" * 12_000, "日本語" * 9_000):
        assert codec.encode(text) == WANT(text)


def test_columns(docs, extra):
    texts = {1: "It's a text.", 2: None, 3: "", 4: "many words " * 9_000}
    coded = bpe.encode_texts(extra(docs([*texts.items(), (1, texts[1])])), PATH)
    rows = bpe.decode_ids(coded, PATH).collect()
    assert len(rows) == 5 and all(r.score == "clash" for r in rows)
    for r in rows:
        want = texts[r.doc_id] or ""
        assert list(r.ids) == WANT(want) and bytes(r.decoded) == want.encode()
    assert bpe.encode_texts(docs([]), PATH).collect() == []
    assert bytes(bpe.decode_ids(coded.selectExpr("CAST(NULL AS array<int>) AS ids").limit(1), PATH).first().decoded) == b""
