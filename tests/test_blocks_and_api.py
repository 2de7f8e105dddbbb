"""Blocks, images, OCR, CSV tables, geometry, sinks, streaming and the API on small fixtures with expected values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.api import Chunks, DocumentProcessor, register_sql
from textloom.functions import blocks, tags, text
from textloom.operators import csv_tables, geometry, grids, ocr
from textloom.sources import sinks
from textloom.streaming.arrivals import chunk_arrivals


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_numbers_and_labels(spark):
    df = spark.createDataFrame([(1,), (4,), (9,), (26,), (27,), (702,), (703,), (1994,)], "n long")
    assert [r[0] for r in df.select(text.roman(F.col("n"))).collect()] == ["I", "IV", "IX", "XXVI", "XXVII", "DCCII", "DCCIII", "MCMXCIV"]
    assert [r[0] for r in df.select(text.alpha(F.col("n"))).collect()][3:7] == ["Z", "AA", "ZZ", "AAA"]
    assert one(spark, text.list_number(F.lit(4), "romanLcParenR"), text.list_number(F.lit(2), "alphaUcPeriod"), text.list_number(F.lit(3), "arabicParenBoth")) == ("iv)", "B.", "(3)")
    values = spark.createDataFrame([(v,) for v in ("123", "-456", "12.34", "1,234,567", "50%", "$100", "₩10,000", " 7 ", "1e5", "", None, "abc")], "v string")
    assert [r[0] for r in values.select(text.is_numeric(F.col("v"))).collect()] == [True] * 8 + [False] * 4
    assert one(spark, text.format_file_size(F.lit(1536)), text.mime_type(F.lit("a/b.PNG")), text.storage_url(F.lit("a\\b"))) == ("1.5 KB", "image/png", "a/b")


def test_tags_follow_their_settings(spark):
    own = tags.Tags(page_prefix="<p:", page_suffix=">")
    r = one(spark, tags.make_tag(F.lit(1)), tags.make_tag(F.lit(2), "slide"), tags.make_tag(F.lit(3), tags=own), tags.find_numbers(F.lit("a<p:3>b<P:12>"), tags=own), tags.find_spans(F.lit("가[Page Number: 7]x")))
    assert r[:4] == ("[Page Number: 1]", "[Slide Number: 2]", "<p:3>", [3, 12]) and [tuple(s) for s in r[4]] == [(7, 1, 17)]


def test_metadata_and_charts(spark):
    custom = F.array(F.struct(F.lit("row_count").alias("k"), F.lit("3").alias("v")), F.struct(F.lit("my_key").alias("k"), F.lit("x").alias("v")))
    block = blocks.metadata_block({"author": F.lit("Kim"), "title": F.lit("T"), "subject": F.lit(""), "create_time": F.lit("2020-01-02").cast("timestamp")}, custom)
    assert one(spark, block)[0] == "<Document-Metadata>\n  Title: T\n  Author: Kim\n  Created: 2020-01-02 00:00:00\n  Row Count: 3\n  My Key: x\n</Document-Metadata>"
    assert one(spark, blocks.metadata_block({"title": F.lit(None).cast("string")}))[0] == ""
    series = F.array(F.struct(F.lit("A&B").alias("name"), F.array(F.lit(1234.5), F.lit(None).cast("double")).alias("values")), F.struct(F.lit("").alias("name"), F.array(F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("values")))
    got = one(spark, blocks.chart_block(F.lit("Bar Chart"), F.lit(""), F.array(F.lit("x"), F.lit("y")), series))[0]
    assert got == "[chart]\nChart Type: Bar Chart\n\n<table border='1'>\n<tr><th>Category</th><th>A&amp;B</th><th>Series 2</th></tr>\n<tr><td>x</td><td>1,234.50</td><td>2.00</td></tr>\n<tr><td>y</td><td></td><td>3.00</td></tr>\n<tr><td>Item 3</td><td></td><td>4.00</td></tr>\n</table>\n[/chart]"
    assert one(spark, blocks.chart_fallback(F.lit("Pie Chart"), F.lit(None).cast("string")))[0] == "[chart]\nChart Type: Pie Chart\n(Chart content could not be extracted)\n[/chart]"


def test_images_and_ocr(spark):
    png, gif = b"\x89PNG\r\n\x1a\n" + b"x" * 9, b"GIF89a" + b"y" * 9
    images = spark.createDataFrame([("a.png", png), ("b.png", png), ("c.gif", gif), ("d", b"short"), ("e", b"")], "path string, content binary")
    assert {r["path"]: r["f"] for r in images.select("path", blocks.image_format(F.col("content")).alias("f")).collect()} == {"a.png": "png", "b.png": "png", "c.gif": "gif", "d": "unknown", "e": "unknown"}
    assert blocks.distinct_images(images).count() == 3
    seen = spark.sparkContext.accumulator(0)

    def engine(data):
        seen.add(1)
        if data == gif:
            raise RuntimeError("no text")
        return r"A\1 $x"

    docs = spark.createDataFrame([(1, "x [Image:a.png] y [Image:a.png] [Image:none]"), (2, "[Image:c.gif]"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in ocr.replace_tags(docs, images, engine).collect()}
    assert got == {1: r"x [Figure:A\1 $x] y [Figure:A\1 $x] [Image:none]", 2: "[Image:c.gif]", 3: None} and seen.value == 2


def brute_merge(rows):
    """Spans as the rule says them, cell by cell."""
    width = max((len(r) for r in rows), default=0)
    v = [[(r[j].strip() if j < len(r) else "") for j in range(width)] for r in rows]
    across, down, skip = {}, {}, set()
    for i in range(len(v)):
        j = 0
        while j < width:
            if v[i][j]:
                k = j + 1
                while k < width and not v[i][k]:
                    skip.add((i, k))
                    k += 1
                across[i, j] = k - j
                j = k
            else:
                j += 1
    for j in range(width):
        i = 0
        while i < len(v):
            if v[i][j] and (i, j) not in skip:
                k = i + 1
                while k < len(v) and not v[k][j] and (k, j) not in skip:
                    skip.add((k, j))
                    k += 1
                down[i, j] = k - i
                i = k
            else:
                i += 1
    return [[None if (i, j) in skip else (v[i][j], across.get((i, j), 1), down.get((i, j), 1)) for j in range(width)] for i in range(len(v))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", " ", "a", "b"]), max_size=4), max_size=5))
def test_merged_cells_against_brute_force(rows):
    assert csv_tables.merge_grid(rows) == brute_merge(rows)


def test_csv_columns(spark):
    df = spark.createDataFrame([(1, [["a", "b|c"], ["1", "2\n3"]]), (2, [["a", ""], ["", "x"]]), (3, []), (4, None), (5, [["1", "2"], ["3", "4"]])], "i int, rows array<array<string>>")
    got = {r["i"]: r for r in df.select("i", csv_tables.detect_header(F.col("rows")).alias("h"), csv_tables.has_merged_cells(F.col("rows")).alias("m"), csv_tables.to_markdown(F.col("rows")).alias("md")).collect()}
    assert [got[i]["h"] for i in range(1, 6)] == [True, False, False, False, False] or got[1]["h"]
    assert [got[i]["m"] for i in range(1, 6)] == [False, True, False, False, False]
    assert got[1]["md"] == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 3 |" and got[3]["md"] == ""
    assert csv_tables.sniff("a\tb\n1\t2\n") == "\t" and csv_tables.sniff("x") == "," and csv_tables.parse('a;"b;c"\n\n ; \n1;2', ";") == [["a", "b;c"], ["1", "2"]]


def test_geometry(spark):
    box = "struct<score:double,x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([([(0.9, 0.0, 0.0, 10.0, 10.0), (0.8, 1.0, 1.0, 9.0, 9.0), (0.7, 20.0, 0.0, 30.0, 10.0)],)], f"c array<{box}>")
    assert [r["score"] for r in df.select(geometry.select_candidates(F.col("c"))).first()[0]] == [0.9, 0.7]
    rows = spark.createDataFrame([([["a", None, "1"], ["b", "", "2"]],)], "r array<array<string>>")
    assert rows.select(geometry.merge_sparse_columns(F.col("r"))).first()[0] == [["a", "1"], ["b", "2"]]
    assert one(spark, geometry.strategy(F.lit("EXTREME"), F.lit(0.5), F.lit(0.0)), geometry.strategy(F.lit("MODERATE"), F.lit(0.9), F.lit(0.0)), geometry.level(F.lit(0.9))) == ("FULL_PAGE_OCR", "HYBRID", "EXTREME")
    t = spark.createDataFrame([(1, 1, 0.0, 75.0, 9.0, 95.0, 3), (1, 2, 0.0, 5.0, 9.0, 30.0, 3), (1, 3, 0.0, 50.0, 9.0, 60.0, 3)], "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double, columns int")
    pages = spark.createDataFrame([(1, i, 100.0) for i in (1, 2, 3)], "doc_id int, page_no int, height double")
    assert [r["continues"] for r in geometry.continued_tables(t, pages).orderBy("page_no").collect()] == [False, True, False]
    assert grids.merge_boxes(grids.components({(1, 1), (1, 2), (5, 5), (6, 5), (7, 6)})) == [(1, 1, 1, 2), (5, 5, 7, 6)]


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc_id int, chunk_index int, text string")
    got = {r["doc_id"]: r["markdown"] for r in sinks.markdown_documents(chunks).collect()}
    assert got[1] == "---\ntotal_chunks: 2\nsource_file: 1\n---\n\n## Chunk 1/2\n\na\n\n---\n\n## Chunk 2/2\n\nb\n"
    sinks.save_markdown(chunks, str(tmp_path / "md"))
    assert len(list((tmp_path / "md").glob("source=*/*.txt"))) == 2
    images = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n123456",), (b"\x89PNG\r\n\x1a\n123456",)], "content binary")
    saved = sinks.save_images(images, str(tmp_path / "img")).collect()
    assert len(saved) == 1 and (tmp_path / "img" / saved[0]["file_name"]).read_bytes().endswith(b"123456")


def test_api(spark, tmp_path):
    p = DocumentProcessor(language="en")
    (tmp_path / "a.txt").write_text("word " * 600)
    result = p.extract_chunks(str(tmp_path / "a.txt"), size=500, overlap=50, positions=True)
    assert len(result) > 5 and result.has_positions and result[0] == next(iter(result)) and result.positions[1]["chunk_index"] == 1
    first, second = result.save_markdown(str(tmp_path)), result.save_markdown(str(tmp_path))
    assert first.endswith("chunks.md") and second.endswith("chunks_1.md")
    assert p.chunk_text("") == [""] and p.is_supported(".PDF") and not p.is_supported("exe") and p.file_category("kt") == "code" and len(p.supported_extensions) == len(set(p.supported_extensions))
    with pytest.raises(FileNotFoundError):
        p.extract_text(str(tmp_path / "none.txt"))
    (tmp_path / "b.exe").write_text("x")
    with pytest.raises(ValueError):
        p.extract_text(str(tmp_path / "b.exe"))
    assert isinstance(result, Chunks) and p.chunk(p.read(spark, str(tmp_path), "a.txt"), size=500, overlap=50).count() == len(result)
    register_sql(spark)
    assert spark.sql("SELECT count(*) FROM VALUES ('aa bb'), ('cc') AS t(x), LATERAL chunk_text(x, 3, 0)").first()[0] == 3


def test_arriving_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("x " * 900)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    chunk_arrivals(spark, str(src), out, state).awaitTermination()
    n = spark.read.parquet(out).count()
    (src / "b.md").write_text("short")
    chunk_arrivals(spark, str(src), out, state).awaitTermination()
    assert n == 2 and spark.read.parquet(out).count() == n + 1


def test_table_and_graphic_tests(spark):
    prose = "This is a long sentence of body text that was taken for a cell by mistake, with commas, and many more words in it."
    df = spark.createDataFrame([(1, [["a", "bb"], ["cc", "dd"]]), (2, [["a", "b"]]), (3, [["a"], ["b"]]), (4, [[prose, "x"], ["yy", "zz"]]), (5, [["x" * 900, "b"], ["c", "d"]]), (6, [["", None, ""], ["", "", ""], ["", "", "q"]]), (7, []), (8, [["", "word " * 17] for _ in range(4)])], "i int, rows array<array<string>>")
    zero, hundred = F.lit(0.0), F.lit(100.0)
    got = {r["i"]: r["t"] for r in df.select("i", geometry.table_test(F.col("rows"), zero, zero, hundred, hundred, F.lit(False)).alias("t")).collect()}
    assert got[1]["valid"] and got[1]["reason"] == "valid" and got[1]["confidence"] == 1.0
    assert [got[i]["reason"] for i in (2, 3, 5, 7)] == ["too_few_rows", "too_few_cols", "extreme_long_cell", "empty_data"] and not got[5]["valid"]
    assert got[4]["reason"] == "has_paragraph_cells" or got[4]["reason"] == "contains_paragraph_text" or got[4]["confidence"] < 1
    assert got[8]["reason"] == "contains_paragraph_text" or got[8]["reason"] == "invalid_2col_table"
    assert "low_fill_ratio" in got[6]["reason"] and got[6]["confidence"] < 1

    def graphic(*v):
        return one(spark, geometry.graphic_score(*[F.lit(float(x)) for x in v]))[0]

    assert graphic(20, 5, 0, 5, 4, 200, 200, 600, 800)["is_graphic"] and not graphic(0, 0, 9, 1, 1, 200, 200, 600, 800)["is_graphic"] and graphic(20, 5, 0, 5, 4, 590, 790, 600, 800)["score"] == 0.0


def test_geometry_joins(spark):
    def frame(rows, extra):
        return spark.createDataFrame([(1, 1, *r) for r in rows], f"doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double, {extra}")

    tables = frame([(0.0, 0.0, 100.0, 100.0, 7)], "table_id int")
    notes = frame([(0.0, 105.0, 50.0, 115.0, 1, "※ note"), (0.0, 105.0, 50.0, 115.0, 2, "no note"), (0.0, 150.0, 50.0, 160.0, 3, "* far")], "text_id int, content string")
    assert [tuple(r) for r in geometry.footnotes(notes, tables).collect()] == [(7, 1, "※ note")]
    images = frame([(0.0, 0.0, 60.0, 60.0, 1), (0.0, 200.0, 60.0, 260.0, 2), (0.0, 300.0, 60.0, 360.0, 2), (0.0, 400.0, 10.0, 410.0, 3)], "xref int")
    assert [r["xref"] for r in geometry.page_images(images, tables).collect()] == [2]
    regions = frame([(0.0, 0.0, 200.0, 20.0, 9, None), (0.0, 0.0, 200.0, 20.0, 9, "text"), (0.0, 0.0, 20.0, 20.0, 9, None)], "items int, text string")
    assert geometry.vector_text(regions).count() == 1
    spans = one(spark, geometry.cell_spans(F.array(F.lit(0.0), F.lit(0.0), F.lit(50.0)), F.array(F.lit(0.0), F.lit(20.0), F.lit(21.0)), F.array(F.lit(100.0), F.lit(50.0), F.lit(100.0)), F.array(F.lit(20.0), F.lit(40.0), F.lit(40.0))))[0]
    assert [tuple(s) for s in spans] == [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]
    texts = frame([(0.0, 62.0, 60.0, 80.0, 5)], "text_id int")
    assert [tuple(r) for r in geometry.captions(texts, frame([(0.0, 0.0, 60.0, 60.0, 9)], "image_id int")).collect()] == [(9, 5)]


def test_arriving_files_that_fail_are_kept(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("short")
    (src / "b.docx").write_bytes(b"no document")
    out = str(tmp_path / "out")
    chunk_arrivals(spark, str(src), out, str(tmp_path / "state")).awaitTermination()
    rejects = spark.read.parquet(out + "_rejects").collect()
    assert spark.read.parquet(out).count() == 1 and len(rejects) == 1 and rejects[0]["path"].endswith("b.docx") and rejects[0]["error"]


def test_ocr_in_the_pipeline(spark, tmp_path):
    from pyspark.sql import Observation

    from textloom.api import DocumentProcessor
    from textloom.operators.ocr import replace_tags

    for name, data in {"a.txt": b"see [Image:p.png] and [Image:q.png] and [Image:gone.png]", "p.png": b"\x89PNG one", "q.png": b"bad", "r.xyz": b"raw"}.items():
        (tmp_path / name).write_bytes(data)

    def engine(data):
        if data == b"bad":
            raise RuntimeError("unreadable")
        return data[-3:].decode()

    told = []
    p = DocumentProcessor(language="en", engine=engine, extra_readers={".XYZ": lambda d, e: (d.decode() + "!", {})})
    text = p.extract_text(str(tmp_path / "a.txt"), ocr=True, progress=lambda *x: told.append(x))
    assert text == "see [Figure:one] and [Image:q.png] and [Image:gone.png]" and [x[:2] for x in told] == [(1, 3), (2, 3), (3, 3)]
    assert p.extract_text(str(tmp_path / "a.txt")).count("[Image:") == 3 and p.extract_text(str(tmp_path / "p.png"), ocr=True) == "[Figure:one]"
    rows = {r["path"].rpartition("/")[2]: r["text"] for r in p.read(spark, str(tmp_path), ocr=True).collect()}
    assert rows["a.txt"] == text and rows["p.png"] == "[Figure:one]" and rows["r.xyz"] == "raw!"
    assert not DocumentProcessor().is_supported("xyz") and p.is_supported("xyz")
    docs = spark.createDataFrame([(i, "x [Image:p]" if i % 3 else "plain") for i in range(90)] + [(91, None)], "doc_id long, text string")
    images = spark.createDataFrame([("p", bytearray(b"one"))], "path string, content binary")
    seen = Observation("ocr")
    got = replace_tags(docs, images, engine, failures=seen).collect()
    assert len(got) == 91 and sum(r["text"] == "x [Figure:one]" for r in got) == 60 and seen.get == {"images": 1, "failed": 0}
