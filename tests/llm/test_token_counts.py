import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def small():
    return tc.Counter(PATH, huge=40, chunk=32, overlap=6)


WORDS = st.sampled_from(["the", "Straße", "don't", "ΟΔΟΣ", "İstanbul", "<|endoftext|>", "<|endof", "text|>", "12345", "é", "é", "́x", "日本語", "!!!", "a" * 30, " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85"])


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=40).map("".join))
def test_any_text(small, text):
    assert small.count([text]) == small.whole([text])
    if len(text) > 1:
        assert small.spliced(text) == small.whole([text])[0]


def test_widening(small):
    text = "ab" * 400 + " " + "cd ef " * 30 + "x" * 90 + " end"
    before = small.widened
    assert small.count([text]) == small.whole([text])
    assert small.widened > before


def test_long_texts():
    own = tc.Counter(PATH)
    text = " ".join(f"word{i % 977} Other{i % 31}, it's" for i in range(9000))
    assert len(text) > own.huge
    assert own.count([text]) == own.whole([text]) and own.widened == 0


def test_unknown_kinds_are_whole():
    own = tc.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert not own.stable
    assert own.count(["a  b " * 9000]) == own.whole(["a  b " * 9000])


def test_rows(spark):
    texts = [None, "", "a b", "a b", "<|endoftext|> x", "word " * 3000]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in tc.token_counts(df, PATH).collect()}
    own = tc.Counter(PATH)
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), own.whole([t or ""])[0])
        assert got[i].over_limit == (got[i].n_tokens > 2048)
    assert tc.token_counts(df.limit(0), PATH).count() == 0


def test_contract_with_overlaps_everywhere(spark):
    """The query's rows for every document, with nearly all texts counted by overlap splicing, against the library on whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = tc.Counter(PATH)
    rows = docs.collect()
    want = {r.doc_id: n for r, n in zip(rows, own.whole([r.text or "" for r in rows]), strict=True)}
    for options in ({}, {"huge": 100, "chunk": 200, "overlap": 16}):
        got = tc.token_counts(docs, PATH, **options).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want
    assert sum(len(r.text or "") > 100 for r in rows) > 0.9 * len(rows)


def test_long_words_are_not_remembered():
    own = tc.Counter(PATH)
    assert own.count(["x" * 900 + " a b", "y" * 65]) == own.whole(["x" * 900 + " a b", "y" * 65]) and set(own.known) == {"a", "b"}
