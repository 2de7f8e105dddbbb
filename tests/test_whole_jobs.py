"""Queries over all of the rows that they are meant for."""

import os

import pytest

import __spark_entry__ as entry
from textloom.functions import text
from textloom.plans import documents

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_chunk_overlaps_reads_whole_chunks(spark, tmp_path):
    words = " ".join(str(i) for i in range(1000))
    rows = [(1, 1, 0, words[:1500]), (2, 1, 1, words[800:2000]), (3, 1, 2, words[2000:]), (4, 2, 0, "öä😀"), (5, 2, 1, "😀ö"), (5, 2, 1, "😀ö"), (6, 2, 2, None)]
    spark.createDataFrame(rows, "chunk_id long, convert_id long, chunk_index int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r["chunk_id"]: (r["length_b"], r["shared"]) for r in QUERIES["chunk_overlaps"](spark, str(tmp_path)).collect()}
    assert got == {2: (1200, 700), 3: (len(words) - 2000, 0), 5: (2, 1), 6: (0, 0)}


def test_reconstruct_finds_the_overlaps(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["the cat sat", "sat on", "on the mat", "."],), (["ab"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(text.reconstruct(F.col("c"), 5)).collect()] == ["the cat sat on the mat.", "ab", ""]


def test_reconstruct_chunks_rests_on_the_operator(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "".join(str(i) for i in range(700)))], "convert_id long, content string").write.parquet(str(tmp_path / "rtf_converted_data.parquet"))
    assert [tuple(r) for r in documents.reconstruct_chunks(spark, str(tmp_path)).collect()] == [(1, 1990, True)]
    monkeypatch.setattr(text, "reconstruct", lambda chunks, overlap: F.lit("other"))
    assert [tuple(r) for r in documents.reconstruct_chunks(spark, str(tmp_path)).collect()] == [(1, 1990, False)]


@tables
def test_every_table_of_the_documents_is_parsed(spark):
    e = spark.read.parquet(f"{SF}/docx_elements.parquet").filter("element_type = 'table' AND content IS NOT NULL").dropDuplicates(["element_id"])
    want = {r["element_id"]: r["content"].count("<tr") for r in e.collect()}
    assert want and {r["element_id"]: r["rows"] + r["header_rows"] for r in QUERIES["parse_docx_tables"](spark, SF).collect()} == want


@tables
def test_oversized_sheets_are_parted_by_rows(spark):
    chunks = {}
    for r in QUERIES["csv_sheet_chunks"](spark, SF).orderBy("book", "chunk_index").collect():
        chunks.setdefault(int(r["text"][len("[Sheet: ") :].split("]")[0]), []).append(r["text"])
    sources = {r["csv_id"]: r["markdown"].split("\n") for r in QUERIES["markdown_table"](spark, SF).collect() if r["markdown"]}
    assert chunks.keys() == sources.keys() and max(map(len, chunks.values())) > 1
    for i, (head, rule, *rows) in sources.items():
        held = [line for c in chunks[i] for line in c.split("\n") if line.startswith("|") and line not in (head, rule)]
        assert held == [row for row in rows if row not in (head, rule)], i
