import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a ", "a  b   c", "\n", "\n\n x", "▁▁ a▁b", "日本語 テスト\t\x00x", "<s> <0x41> </s>", "▁", "x" * 3000, " " * 60, "é́ 🤷‍♀️" + "🤷" * 9, "a\n  b \n"]


@pytest.fixture(scope="module")
def codec():
    return pieces.MergeCodec(MODEL)


def test_agenda_equals_library(codec):
    assert codec.encode(ODD) == (codec.library.encode(ODD), [0] * len(ODD))


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n▁aetn")), max_size=60))
def test_any_text(codec, text):
    ids, repaired = codec.encode([text])
    assert repaired == [0] and ids == codec.library.encode([text])
    assert [i for s in codec.segments(codec.normalise(text)) for i in codec.agenda(s)] == ids[0]
    assert codec.segments(codec.normalise(text)) == pieces.splits_at(codec.normalise(text))


def test_other_types_are_refused(tmp_path):
    with pytest.raises(RuntimeError):
        pieces.MergeCodec(str(tmp_path / "none.model"))


def test_rows(spark, codec):
    texts = [*ODD, None, "same", "same"]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in pieces.digests(pieces.encode_decode(df, MODEL, keep=["doc_id", "ids"])).collect()}
    for i, t in enumerate(texts):
        ids = codec.library.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(df.limit(0), MODEL).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aetn▁qxzéß日本🤷 "), min_size=65, max_size=400))
def test_long_segments_are_cut_where_no_merge_joins(codec, text):
    assert codec.encode([text]) == ([codec.library.encode(text)], [0])
    assert "".join(codec.segments(codec.normalise(text))) == codec.normalise(text)


def test_long_segments_are_not_remembered():
    codec = pieces.MergeCodec(MODEL)
    long = "e" * 5000 + "日" * 300 + "qxzj" * 50
    assert codec.encode([long, "short text"])[0] == codec.library.encode([long, "short text"])
    assert codec.known and max(map(len, codec.known)) <= pieces.LONG


def test_a_difference_from_the_library_shows(monkeypatch):
    codec = pieces.MergeCodec(MODEL)
    true = codec.agenda
    monkeypatch.setattr(codec, "agenda", lambda s: [7] if "wrong" in s else true(s))
    texts = ["all right", "wrong and wrong", "not wrongly"]
    assert codec.encode(texts) == (codec.library.encode(texts), [0, 2, 1])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aetnior▁s ëß日"), min_size=1, max_size=pieces.SHORT))
def test_both_agendas_agree(codec, text):
    assert codec.merged_short(text) == codec.merged(text)
