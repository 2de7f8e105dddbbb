from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import splitting as S


def brute(text, size, overlap):
    """The same cuts by looking at every position of the window."""
    strength = S.strengths(text, S.code_points(text))
    out, start, n = [], 0, len(text)
    while n - start > size:
        high, low = start + size, max(start + overlap + 1, start + size // 2 + 1)
        best = max(range(low, high + 1), key=lambda p: (strength[p], p))
        if strength[best] <= S.INSIDE and start + overlap + 1 < low:
            other = max(range(start + overlap + 1, low), key=lambda p: (strength[p], p))
            best = other if strength[other] > strength[best] else best
        cut = high if strength[best] == S.FORBIDDEN else best
        out.append((start, cut))
        start = cut - overlap
    return [*out, (start, n)]


TEXT = st.text(alphabet=st.sampled_from(list("ab c. ,\n\n!가나é́😀[]1")), max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 70))
def test_pieces_hold_what_they_promise(text, size, overlap):
    pieces = S.pieces_of(text, size, overlap)
    o = min(overlap, size - 1)
    assert pieces == (brute(text, size, o) if len(text) > size else [(0, len(text))])
    assert all(b - a <= size for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(q[0] == p[1] - o for p, q in zip(pieces, pieces[1:]))
    assert "".join(text[a + (o if i else 0) : b] for i, (a, b) in enumerate(pieces)) == text


def test_natural_boundaries_win():
    text = "One two three. Four five six seven.\n\nEight nine ten eleven twelve thirteen"
    assert [text[a:b] for a, b in S.pieces_of(text, 45, 0)][0] == "One two three. Four five six seven.\n\n"
    tag = "x" * 30 + "[Image:images/abc.png]" + "y" * 30
    assert all("[Image:images/abc.png]" in tag[a:b] or "[Image" not in tag[a:b] for a, b in S.pieces_of(tag, 40, 0))


def test_batches_and_blocks_agree(monkeypatch):
    texts = ["word " * 500, "", "가" * 900, "a b. c\n\n" * 300]
    whole = S.pieces_of_batch(texts, [100] * 4, [10] * 4)
    assert whole == [S.pieces_of(t, 100, 10) for t in texts]
    monkeypatch.setattr(S, "BLOCK", 512)
    assert S.pieces_of_batch(texts, [100] * 4, [10] * 4) == whole


def frames(spark, rows, chunks):
    converted = spark.createDataFrame(rows, "convert_id bigint, content string, profile string, extra int, item_id bigint, text string, __p string")
    parts = spark.createDataFrame(chunks, "chunk_id bigint, convert_id bigint, text string, extra int, profile string")
    profiles = spark.createDataFrame([("standard", 10, 2), ("tiny", 4, 9)], "profile string, chunk_size int, chunk_overlap int")
    return converted, parts, profiles


def test_found_and_pieces(spark):
    rows = [(1, "x" * 11, None, 1, 7, "t", "p"), (1, "x" * 11, None, 1, 7, "t", "p"), (2, "x" * 10, "standard", 1, 7, "t", "p"), (3, None, None, 1, None, None, None), (4, "abcde", "tiny", 1, 1, "", ""), (5, "y" * 12, "unheard of", 1, 1, "", ""), (6, "", "tiny", 1, 1, "", "")]
    chunks = [(1, 4, "12345", 0, "zz"), (2, 4, "1234", 0, "zz"), (3, 99, "z" * 11, 0, "zz"), (4, 1, None, 0, "zz"), (5, None, "z" * 11, 0, "zz")]
    f = frames(spark, rows, chunks)
    assert sorted(map(tuple, S.oversized(*f).collect())) == [("chunks", 1), ("chunks", 3), ("chunks", 5), ("rtf_converted_data", 1), ("rtf_converted_data", 4), ("rtf_converted_data", 5)]
    pieces = S.split_items(*f).filter("item_table = 'rtf_converted_data' AND item_id = 1").orderBy("piece_no").collect()
    assert [(p["piece_no"], p["start"], p["text"]) for p in pieces] == [(0, 0, "x" * 10), (1, 8, "xxx")]
    empty = frames(spark, [], [])
    assert S.oversized(*empty).count() == 0 and S.split_items(*empty).count() == 0


def test_sizes_above_any_block():
    """Pieces of millions of code points: positions are exact beyond 24 bits, and the bucketed table says what plain search says."""
    from textloom.llm import splitting as S

    text = ("word " * 199 + "end.\n\n") * 23_000
    spans = S.pieces_of(text, 5_000_000, 1000)
    assert all(0 < b - a <= 5_000_000 for a, b in spans) and spans[-1][1] == len(text)
    assert all(n == e - 1000 for (_, e), (n, _) in zip(spans, spans[1:])) and all(text[e - 2 : e] == "\n\n" for _, e in spans[:-1])


def test_bucketed_range_maximum():
    import numpy as np

    from textloom.llm import splitting as S

    rng = np.random.default_rng(1)
    strength = rng.integers(0, 9, 60_000).astype(np.uint8)
    plain, bucketed = S.RangeMaximum(strength, 40_000), S.RangeMaximum(strength, S.BLOCK)
    assert plain.step == 1 and bucketed.step == S.STEP
    for low, high in sorted(rng.integers(0, 60_000, (500, 2)).tolist()):
        low, high = min(low, high), min(max(low, high), min(low, high) + 39_999)
        assert plain.strongest(low, high) == bucketed.strongest(low, high)


def test_long_tags_are_not_cut():
    from textloom.llm import splitting as S

    tag = "[Image:" + "a/b " * 200 + ".png]"
    text = "some words here " * 40 + tag + " more words" * 60
    spans = S.pieces_of(text, 1200, 20)
    at = text.index(tag)
    assert not any(at < e < at + len(tag) for _, e in spans[:-1])
