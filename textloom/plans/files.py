"""Queries of the file readers. Each writes the parts of every brand as files of a format, a thousand keys each, inside the query, and reads it through
`read_documents`; the same text is put together in SQL from the rows. What the formats can hold of it differs: tables, lines, or
a sheet."""

from __future__ import annotations

import csv
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from textloom.plans.general import table
from textloom.sources import ole, xls
from textloom.sources.readers import read_documents

HEAD = ["part", "name", "type"]
Rows = list[list[str]]


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def write_docx(title: str, rows: Rows) -> bytes:
    def paragraph(t: str) -> str:
        return f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"

    grid = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = f'<w:document xmlns:w="http://w"><w:body>{paragraph(title)}<w:tbl>{grid}</w:tbl></w:body></w:document>'
    return _archive({"[Content_Types].xml": "<x/>", "word/document.xml": body})


def write_xlsx(title: str, rows: Rows) -> bytes:
    cells = "".join("<row>" + "".join(f'<c r="{"ABC"[j]}{i + 1}" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for j, c in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    return _archive({
        "xl/workbook.xml": f'<workbook xmlns="http://m" xmlns:r="http://r"><sheets><sheet name="{escape(title)}" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://m"><sheetData>{cells}</sheetData></worksheet>',
    })


def write_xls(title: str, rows: Rows) -> bytes:
    def record(kind: int, body: bytes = b"") -> bytes:
        return struct.pack("<HH", kind, len(body)) + body

    def label(i: int, j: int, text: str) -> bytes:
        return record(xls.LABEL, struct.pack("<HHHHB", i, j, 0, len(text), 1) + text.encode("utf-16-le"))

    sheet = record(xls.BOF) + b"".join(label(i, j, c) for i, r in enumerate(rows) for j, c in enumerate(r)) + record(xls.EOF)
    named = struct.pack("<BB", len(title), 0) + title.encode("latin-1")
    start = len(record(xls.BOF) + record(xls.BOUNDSHEET, bytes(6) + named) + record(xls.EOF))
    return ole.write_compound({"Workbook": record(xls.BOF) + record(xls.BOUNDSHEET, struct.pack("<IH", start, 0) + named) + record(xls.EOF) + sheet})


def write_pptx(title: str, rows: Rows) -> bytes:
    def shape(y: int, lines: list[str]) -> str:
        paragraphs = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in lines)
        return f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>{paragraphs}</p:txBody></p:sp>'

    tree = shape(500, [" ".join(r) for r in rows[1:]]) + shape(10, [title])
    return _archive({"ppt/slides/slide1.xml": f'<p:sld xmlns:a="http://a" xmlns:p="http://p"><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>'})


def write_hwpx(title: str, rows: Rows) -> bytes:
    def paragraph(t: str) -> str:
        return f"<hp:p><hp:run><hp:t>{escape(t)}</hp:t></hp:run></hp:p>"

    def cell(i: int, j: int, t: str) -> str:
        return f'<hp:tc><hp:subList>{paragraph(t)}</hp:subList><hp:cellAddr colAddr="{j}" rowAddr="{i}"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc>'

    grid = "".join("<hp:tr>" + "".join(cell(i, j, c) for j, c in enumerate(r)) + "</hp:tr>" for i, r in enumerate(rows))
    return _archive({"Contents/section0.xml": f'<s xmlns:hp="http://h">{paragraph(title)}<hp:p><hp:run><hp:tbl>{grid}</hp:tbl></hp:run></hp:p></s>', "Contents/content.hpf": "<x/>"})


def write_hwp(title: str, rows: Rows) -> bytes:
    def record(tag: int, level: int, payload: bytes) -> bytes:
        return struct.pack("<I", tag | level << 10 | len(payload) << 20) + payload

    cells = b"".join(record(ole.LIST_HEADER, 2, bytes(8) + struct.pack("<HHHH", j, i, 1, 1)) + record(ole.PARA_TEXT, 3, c.encode("utf-16-le")) for i, r in enumerate(rows) for j, c in enumerate(r))
    body = record(ole.PARA_TEXT, 1, (title + "\r").encode("utf-16-le")) + record(ole.CTRL_HEADER, 1, b" lbt") + cells
    packed = zlib.compressobj(wbits=-15)
    return ole.write_compound({"FileHeader": bytes(36) + b"\x01" + bytes(219), "BodyText/Section0": packed.compress(body) + packed.flush()})


def write_rtf(title: str, rows: Rows) -> bytes:
    def grid(r: list[str]) -> str:
        return r"\trowd" + "".join(rf"\cellx{j + 1}" for j in range(len(r))) + " " + "".join(rf"{c}\cell " for c in r) + r"\row"

    return (r"{\rtf1\ansi\ansicpg1252\pard " + title + r"\par" + "".join(map(grid, rows)) + "}").encode("cp1252")


def write_pdf(title: str, rows: Rows) -> bytes:
    shown = b" 0 -14 Td ".join(b"(" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") Tj" for t in [title, *(" ".join(r) for r in rows[1:])])
    stream = zlib.compress(b"BT /F1 12 Tf 72 700 Td " + shown + b" ET")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>"


def _delimited(delimiter: str, encoding: str) -> Callable[[str, Rows], bytes]:
    def write(title: str, rows: Rows) -> bytes:
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows(rows)
        return out.getvalue().encode(encoding)

    return write


def write_doc(title: str, rows: Rows) -> bytes:
    """A .doc that is HTML inside."""
    grid = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in r) + "</tr>" for r in rows)
    return f"<html><body><p>{escape(title)}</p><table>{grid}</table></body></html>".encode()


WRITERS: dict[str, Callable[[str, Rows], bytes]] = {
    "docx": write_docx, "xlsx": write_xlsx, "xls": write_xls, "pptx": write_pptx, "hwpx": write_hwpx, "hwp": write_hwp, "rtf": write_rtf, "pdf": write_pdf, "doc": write_doc,
    "csv": _delimited(",", "cp949"), "tsv": _delimited("\t", "utf-16"), "txt": lambda title, rows: "\n".join([title, *("\t".join(r) for r in rows)]).encode("utf-8"),
}
CATEGORY = {"xlsx": "data", "xls": "data", "csv": "data", "tsv": "data", "txt": "text"}


def files_of(spark: SparkSession, sf: str, ext: str) -> DataFrame:
    """(path, ext, category, content): one file for each brand and thousand of keys, so that no file grows with the table."""
    row = F.array(F.col("p_partkey").cast("string"), "p_name", "p_type")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"])
    brands = table(spark, sf, "part").withColumn("p_brand", F.concat("p_brand", F.lit("_"), F.floor(F.col("p_partkey") / 1000).cast("string"))).groupBy("p_brand").agg(rows.alias("rows"))
    write = WRITERS[ext]

    @F.pandas_udf(BinaryType())
    def written(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for titles, tables in batches:
            yield pd.Series([write(t, [HEAD, *(list(r) for r in rs)]) for t, rs in zip(titles, tables)], dtype=object)

    return brands.select(F.concat(F.col("p_brand"), F.lit("." + ext)).alias("path"), F.lit(ext).alias("ext"), F.lit(CATEGORY.get(ext, "document")).alias("category"), written("p_brand", "rows").alias("content"))


def _reader(ext: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, sf: str) -> DataFrame:
        return read_documents(files_of(spark, sf, ext), with_metadata=False).select("path", "text", "error")

    read.__name__, read.__doc__ = f"read_{ext}", f"The parts of each brand, written as a {ext} file and read again."
    return read


_ROWS = "SELECT p_brand || '_' || (p_partkey // 1000) AS p_brand, list([p_partkey::VARCHAR, p_name, p_type] ORDER BY p_partkey) AS rows FROM part GROUP BY ALL"
_E = "replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_NL = "chr(10)"


def _html_sql(head: str, before: str) -> str:
    body = f"array_to_string(list_transform(rows, lambda r: '<tr>' || array_to_string(list_transform(r, lambda c: '<td>' || {_E} || '</td>'), '') || '</tr>'), {_NL})"
    first = "<tr>" + "".join(f"<{head}>{h}</{head}>" for h in HEAD) + "</tr>"
    return f"{before} || '<table border=''1''>' || {_NL} || '{first}' || {_NL} || {body} || {_NL} || '</table>'"


_PIPES = f"'| {' | '.join(HEAD)} |' || {_NL} || '| --- | --- | --- |' || {_NL} || array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', '\\|')), ' | ') || ' |'), {_NL})"
_LINES = f"array_to_string(list_transform(rows, lambda r: array_to_string(r, ' ')), {_NL})"
TEXTS = {
    "docx": _html_sql("th", f"'[Page Number: 1]' || {_NL} || p_brand || {_NL}"),
    "xlsx": f"'[Sheet: ' || p_brand || ']' || {_NL} || {_NL} || {_PIPES}",
    "xls": f"'[Sheet: ' || p_brand || ']' || {_NL} || {_NL} || {_PIPES}",
    "pptx": f"'[Slide Number: 1]' || {_NL} || p_brand || {_NL} || {_LINES}",
    "hwpx": _html_sql("td", f"p_brand || {_NL}"),
    "hwp": _html_sql("td", f"p_brand || {_NL}"),
    "rtf": _html_sql("td", f"'[Page Number: 1]' || {_NL} || {_NL} || p_brand || {_NL} || {_NL}"),
    "pdf": f"'[Page Number: 1]' || {_NL} || p_brand || {_NL} || {_LINES}",
    "doc": _html_sql("td", f"p_brand || {_NL} || array_to_string(flatten([['part', 'name', 'type'], flatten(rows)]), {_NL}) || {_NL} || {_NL}"),
    "csv": _PIPES,
    "tsv": _PIPES,
    "txt": f"p_brand || {_NL} || array_to_string(list_transform([['part', 'name', 'type']] || rows, lambda r: array_to_string(r, chr(9))), {_NL})",
}
QUERIES = {f"read_{ext}": _reader(ext) for ext in WRITERS}
SQL = {f"read_{ext}": f"WITH p AS ({_ROWS}) SELECT p_brand || '.{ext}' AS path, {text} AS text, NULL::VARCHAR AS error FROM p" for ext, text in TEXTS.items()}
