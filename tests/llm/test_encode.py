import pytest
import tokenizers
from hypothesis import HealthCheck, given, settings, strategies as st

from docmeter.llm import encode as E

LIBRARY = tokenizers.Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
LIBRARY.encode_special_tokens = True
TEXTS = ["Hello world", "", "   ", "aaaaaaaaaaa", "naïve façade — 的的的 🎉🎉", "<|endoftext|> is text", "tabs\t\tand\n\n\nlines  ", "x" * 4000, "don't we'll", "​�", "1234567 8,910"]


@pytest.fixture(scope="module")
def con():
    return E.connect(merges=E.merge_table()[0])


def test_same_as_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (0, TEXTS[0], "repeat")]
    got = E.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        text = None if r["doc_id"] == 99 else TEXTS[r["doc_id"]]
        assert r["ids"] == (LIBRARY.encode(text, add_special_tokens=False).ids if text else [])


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.sampled_from("abAB  \n.,é的🎉0123'-"), min_size=1, max_size=40))
def test_words(con, word):
    assert E.encode_words(con, E.merge_table()[1], [word])[word] == [i for i in by_bytes(word)]


def test_long_words(con):
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (999, 1001, 3000)] + ["的" * 800, "a" * 5001]
    got = E.encode_words(con, E.merge_table()[1], words)
    assert all(got[w] == LIBRARY.encode(w, add_special_tokens=False).ids for w in words)


def by_bytes(word):
    """The merges one by one: leftmost pair of the least rank until none is left."""
    merges, single = MERGES
    tokens = [single[b] for b in word.encode()]
    while True:
        ranked = [(merges[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in merges]
        if not ranked:
            return tokens
        _, i = min(ranked)
        tokens[i : i + 2] = [merges[tokens[i], tokens[i + 1]][1]]


TABLE, SINGLE = E.merge_table()
MERGES = ({(a, b): (r, m) for a, b, m, r in zip(*(TABLE[c].to_pylist() for c in ("lhs", "rhs", "merged", "rank")))}, SINGLE)


def test_round_trip(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in E.decode(E.encode(texts, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == dict(enumerate(TEXTS)) | {99: ""}


def test_empty_table(spark):
    assert E.encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
