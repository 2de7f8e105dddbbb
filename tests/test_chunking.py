"""Chunking: worked examples, invariants on random documents, and the folds in the JVM against the lists in Python."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import chunking as C
from textloom.operators import pages as P
from textloom.operators import tables as T
from textloom.operators.regions import Region, find_regions, merge_regions, split_around_regions
from textloom.operators.sheets import chunk_sheet_text, segments_of, sheets_of
from textloom.operators.splitter import split_code, split_recursive

TABLE = "| a |\n| --- |\n" + "\n".join(["| 1 |"] * 10)


def html(rows):
    return "<table border='1'><tr><th>H</th></tr>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>"


def test_page_packing():
    a, b, c = "a" * 8, "b" * 8, "c" * 12
    assert P.pack_pages([a, b, c], 20, 4) == [f"{a}\n\n{b}", c]
    assert P.pack_pages([a, "b" * 10, c], 20, 4) == [f"{a}\n\n{'b' * 10}", f"bbbb\n\n{c}"]
    assert P.split_into_pages("lead [Page Number: 1]\nx\n[Page Number: 2] [Page Number: 3]y", r"\[Page Number: ([0-9]+)\]") == [(0, "lead"), (1, "[Page Number: 1]\nx"), (3, "[Page Number: 3]y")]
    assert P.clean_chunks(["[Page Number: 3]", " ", "x", "[Slide Number: 4 (OCR)]"]) == ["x"]


def test_folds_agree(spark):
    lists = [["a" * n for n in sizes] for sizes in ([8, 8, 12], [8, 10, 12], [], [40], [5, 5, 5, 5, 5, 5, 30, 2], [21, 1, 1])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, pages array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", P.pack_pages_column(F.col("pages"), 20, 4).alias("c")).collect()}
    assert got == {i: P.pack_pages(x, 20, 4) for i, x in enumerate(lists)}
    sizes = df.select("i", T.pack_column(F.transform("pages", lambda p: F.length(p).cast("bigint")), F.lit(15)).alias("c")).collect()
    for r in sizes:
        spans = T.pack([len(p) for p in lists[r["i"]]], 15)
        assert r["c"] == [k for k, (a, b) in enumerate(spans) for _ in range(a, b)]


def test_markdown_packing():
    chunks = T.chunk_markdown(TABLE, 60)
    assert [c.count("| 1 |") for c in chunks] == [7, 3] and [c.split("\n")[0] for c in chunks] == ["[Table Chunk 1/2]", "[Table Chunk 2/2]"]
    assert all("| a |\n| --- |" in c for c in chunks) and T.chunk_markdown(TABLE, 200) == [TABLE]
    assert T.chunk_markdown(TABLE, 60, "ctx")[0].startswith("ctx\n[Table Chunk 1/")


def test_html_packing_keeps_rows_and_spans():
    source = "<table border='1'><tr><th>A</th></tr>" + "".join(f"<tr><td rowspan='2'>{i}</td><td>x</td></tr><tr><td>y</td></tr>" for i in range(40)) + "</table>"
    chunks = T.chunk_html(source, 300)
    assert len(chunks) > 1 and sum(c.count("<td>x</td>") for c in chunks) == 40 and all(c.count("<td>x</td>") == c.count("<td>y</td>") for c in chunks)
    assert T.clip_rowspans(["<tr><td rowspan='3'>a</td></tr>", "<tr><td rowspan=\"5\">b</td></tr>"]) == ["<tr><td rowspan='2'>a</td></tr>", "<tr><td>b</td></tr>"]
    assert T.span_columns("<tr><td colspan='2'>a</td><td rowspan='3'>b</td></tr>") == {2: 3}
    t = T.parse_html(html(range(3)))
    assert (len(t.header), len(t.rows), t.columns, t.header_size) == (1, 3, 1, len("<tr><th>H</th></tr>") + 1)


def test_regions():
    text = "x [Image:a.png] [chart]q[/chart] <table><tr><td>[Image:b.png]</td></tr></table>"
    assert [(r.kind, text[r.start : r.end]) for r in find_regions(text)] == [("image_tag", "[Image:a.png]"), ("chart", "[chart]q[/chart]"), ("html_table+image_tag", "<table><tr><td>[Image:b.png]</td></tr></table>")]
    assert merge_regions([Region(5, 9, "b"), Region(0, 6, "a"), Region(9, 10, "c")]) == [Region(0, 9, "a+b"), Region(9, 10, "c")]
    big = html(range(60))
    assert any(big in c for c in split_around_regions("short lead " + big + " tail", 100, 50)) and "short lead" in split_around_regions("short lead " + big, 100, 50)[0]


PART = st.one_of(
    st.lists(st.sampled_from(["alpha", "beta", "gamma.", "δέλτα"]), min_size=1, max_size=40).map(" ".join),
    st.integers(1, 99).map(lambda i: f"[Image:images/{i}.png]"),
    st.integers(1, 60).map(lambda n: "[chart]\n" + "y " * n + "[/chart]"),
    st.integers(1, 30).map(lambda n: html(range(n))),
    st.integers(1, 20).map(lambda n: "| a | b |\n|---|---|\n" + "".join(f"| {i} | x |\n" for i in range(n))),
)


@settings(max_examples=200, deadline=None)
@given(st.lists(PART, min_size=1, max_size=10), st.sampled_from(["\n\n", "\n", " "]), st.integers(30, 300), st.integers(0, 300))
def test_documents_lose_nothing(parts, joint, size, overlap):
    text, overlap = joint.join(parts), min(overlap, size)
    chunks = C.chunk_document(text, "pdf", size, overlap)
    assert all(c.strip() for c in chunks)
    regions = find_regions(text)
    for r in regions:
        assert any(text[r.start : r.end].strip() in c for c in chunks)
    if regions:
        seen = iter("".join("".join(chunks).split()))
        assert all(ch in seen for ch in "".join(text.split()))
    placed = C.with_positions(chunks, "pdf", overlap)
    assert all(p["global_end"] - p["global_start"] + 1 == len(p["text"]) for p in placed)
    assert C.chunk_document(text, "pdf", size, overlap, preserve_tables=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(1, 60), st.integers(0, 60))
def test_recursive_split(text, size, overlap):
    if overlap > size:
        return
    chunks = split_recursive(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    seen = iter("".join("".join(chunks).split()))
    assert all(ch in seen for ch in "".join(text.split()))


def test_code_and_blank_text():
    code = "import x\n\ndef a():\n    return 1\n\ndef b():\n    return 2\n"
    assert split_code(code, "py", 30, 0)[0] == "import x" and C.chunk_document("  \n") == [""]
    assert split_recursive("", 10, 0) == []


def test_sheets():
    text = "<Document-Metadata>\n  A: b\n</Document-Metadata>\n\nlost [Sheet: One]\n[Table 1]\n| a |\n| --- |\n| 1 |\n\n[chart]c[/chart] note\n[Sheet: Two]\n \n[Sheet: Three]\nplain"
    assert [n for n, _ in sheets_of(text)] == ["One", "Three"]
    assert [k for k, _ in segments_of(sheets_of(text)[0][1])] == ["table", "chart", "text"]
    chunks = chunk_sheet_text(text, 1000)
    assert len(chunks) == 4 and all(c.startswith("<Document-Metadata>") for c in chunks) and chunks[3].endswith("[Sheet: Three]\nplain")


def test_frames(spark):
    long = "word " * 500
    df = spark.createDataFrame([(1, "short"), (2, long), (3, None), (4, ""), (5, "[Page Number: 1]\nx"), (6, "| a |\n| --- |\n| 1 |")], "doc_id bigint, text string")
    rows = C.chunk_documents(df).collect()
    want = {i: C.chunk_document(t or "") for i, t in df.collect()}
    assert {i: [r["text"] for r in sorted(rows, key=lambda r: r["chunk_index"]) if r["doc_id"] == i] for i in want} == want
    placed = C.chunk_documents(df, positions=True).filter("doc_id = 2").count()
    assert placed == len(want[2])


def test_segments_by_one_scan():
    text = "[Sheet: A]\nintro words\n[Table 1]\n| a | b |\n| 1 | 2 |\n\nbetween\n| x | y |\n| --- | --- |\n| 1 | 2 |\n[textbox]| not | a table |[/textbox]\n[Image:p.png] tail\n[Sheet: B]\n\n[Sheet: C]\n<TABLE border=\"1\"><tr><td>[Image:q.png]</td></tr></TABLE>"
    (a, first), (c, second) = sheets_of(text)
    assert (a, c) == ("A", "C")
    assert [k for k, _ in segments_of(first)] == ["text", "table", "text", "table", "textbox", "image", "text"]
    assert [k for k, _ in segments_of(second)] == ["table"] and segments_of("") == [] and segments_of("[Table 3]") == []
    joined = "".join(x for _, x in segments_of(first))
    assert sorted(joined.split()) == sorted(first.split()) or "".join(joined.split()) == "".join(first.split())
