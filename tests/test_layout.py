from pyspark.sql import functions as F

from textloom.operators import layout as L


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double" + extra)


def test_columns_and_blocks(spark):
    words = "a text of more than twenty characters"
    texts = frame(spark, [(x, 20.0 * i, x + 90, 20.0 * i + 15, words) for i in range(6) for x in (10.0, 300.0)] + [(500.0, 0.0, 520.0, 10.0, words)], ", content string")
    assert [(r["column"], r["left"], r["boundary"]) for r in L.text_columns(texts).orderBy("column").collect()] == [(1, 10.0, 155.0), (2, 300.0, None)]
    found = L.blocks(texts).orderBy("x0").collect()
    assert [(b["x0"], b["y1"], b["elements"]) for b in found] == [(10.0, 115.0, 6), (300.0, 115.0, 6)]
    zones = frame(spark, [(0.0, 90.0, 1.0, 95.0, "footer", 1), (200.0, 10.0, 300.0, 60.0, "body", 2), (0.0, 10.0, 100.0, 60.0, "body", 1), (0.0, 0.0, 9.0, 5.0, "header", 2)], ", zone string, column int")
    assert [r["zone"] + str(r["column"]) for r in L.block_order(zones).orderBy("place").collect()] == ["header2", "body1", "body2", "footer1"]


def test_grids(spark):
    rows = [["a", "b", "", "c"], ["1", None, "2", "3"]]
    df = spark.createDataFrame([(rows, [5.0, 12.0, 20.0, 4.0])], "r array<array<string>>, w array<double>")
    assert df.select(L.merge_narrow_columns(F.col("r"), F.col("w"))).first()[0] == [["ab", "c"], ["1", "23"]]
    assert L.spans_from_blanks([["a", "", "b"], ["", "", "c"], ["", "", ""], ["d", "e", "f"]]) == [(0, 0, 2, 2), (0, 2, 1, 1), (1, 2, 1, 1), (3, 0, 1, 1), (3, 1, 1, 1), (3, 2, 1, 1)]
    two = spark.createDataFrame([([["h"]], [["x", "y"], [" ", "z"]])], "a array<array<string>>, b array<array<string>>")
    assert two.select(L.join_rows(F.col("a"), F.col("b")), L.last_category(F.col("b"))).first() == ([["h", ""], ["x", "y"], [" ", "z"]], "x")


def test_headers(spark):
    tables = frame(spark, [(0.0, 0.0, 100.0, 20.0, 1, 1, 2), (0.0, 30.0, 100.0, 90.0, 2, 5, 3), (0.0, 200.0, 100.0, 220.0, 3, 1, 2)], ", table_id int, rows int, columns int")
    got = L.header_over_data(tables)
    assert {r["table_id"]: r["header_id"] for r in got.collect()} == {1: None, 2: 1, 3: None}
    texts = frame(spark, [(0.0, 20.0, 50.0, 28.0, "(A) part", 7), (0.0, 20.0, 50.0, 28.0, "part", 8)], ", content string, text_id int")
    assert [tuple(r) for r in L.subheaders(texts, got).collect()] == [(2, 7)]
