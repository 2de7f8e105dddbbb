import base64

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import tokenizer as T

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = T.BytePairEncoder()


def ids(texts):
    flat, edges = ENCODER.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(edges, edges[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80) | st.text(alphabet="ab 's\n\tth1,", max_size=80) | st.none(), max_size=6))
def test_ids_are_the_public_tokenizers(texts):
    want = [REFERENCE.encode_ordinary(t) if t else [] for t in texts]
    assert ids(texts) == want
    assert ENCODER.counts(texts).tolist() == [len(w) for w in want]


def test_long_words_and_round_trip():
    for t in ("a" * 5000, "가나다" * 700, "x1" * 400, "<|endoftext|>", "the " * 2000):
        assert ids([t])[0] == REFERENCE.encode_ordinary(t) and REFERENCE.decode(ids([t])[0]) == t


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello world", 1), (2, None, 1), (3, "", 1), (4, "Hello world", 1)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in T.token_ids(df).collect()}
    assert got == {1: REFERENCE.encode_ordinary("Hello world"), 2: [], 3: [], 4: REFERENCE.encode_ordinary("Hello world")}
    assert {r["doc_id"]: r["tokens"] for r in T.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    assert T.token_ids(df.limit(0)).count() == 0
