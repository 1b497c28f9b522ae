import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwise.llm import encode
from cellwise.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def replay():
    return encode.MergeReplay(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_the_usual_loop(text):
    t = tokenizers.Tokenizer.from_file(tokenizer_path()) if not hasattr(test_same_ids_as_the_usual_loop, "t") else test_same_ids_as_the_usual_loop.t
    t.encode_special_tokens = True
    test_same_ids_as_the_usual_loop.t = t
    m = getattr(test_same_ids_as_the_usual_loop, "m", None) or encode.MergeReplay(tokenizer_path())
    test_same_ids_as_the_usual_loop.m = m
    got = [i for w in m.words(encode.splitter(text)) for i in w]
    assert got == t.encode(text, add_special_tokens=False).ids


def test_words_join_to_the_text():
    for text in ("a  b\n\n c", "naïve €5, it's", "\t\tx", "日本 の 表"):
        assert "".join(encode.splitter(text)) == text


def test_edge_cases(spark, reference):
    long = "many words of a very long text, " * 20_000
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, "   ", "x"),
        (4, "<|endoftext|>", "x"),
        (5, long, "x"),
        (6, "twice", "x"),
        (7, "twice", "x"),
        (8, "a" * 20_000, "x")
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode(docs, tokenizer_path()).collect()}
    assert got[1] == [] and got[2] == [] and got[6] == got[7]
    for i, text, _ in rows[2:]:
        assert got[i] == reference.encode(text, add_special_tokens=False).ids, i
    assert encode.encode(docs.limit(0), tokenizer_path()).count() == 0
