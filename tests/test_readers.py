"""Readers against files that are written here with the standard library."""

import io
import struct
import zipfile
import zlib

from textloom.sources import html, ole, ooxml, pdf, rtf, text_files, xls
from textloom.sources.readers import read_documents, read_file, scan

W = 'xmlns:w="http://w" xmlns:a="http://a" xmlns:r="http://r" xmlns:c="http://c" xmlns:p="http://p"'
CHART = f'<c:chartSpace {W}><c:chart><c:title><a:t>Sales</a:t></c:title><c:plotArea><c:barChart><c:ser><c:tx><c:pt><c:v>A</c:v></c:pt></c:tx><c:cat><c:pt><c:v>Q1</c:v></c:pt><c:pt><c:v>Q2</c:v></c:pt></c:cat><c:val><c:pt><c:v>1234.5</c:v></c:pt></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>'
CORE = '<cp xmlns:dc="http://dc"><dc:title>Report</dc:title><dc:creator>Kim</dc:creator></cp>'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    cell = lambda t, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = "<w:tbl><w:tr>" + cell("A", '<w:gridSpan w:val="2"/>') + "</w:tr><w:tr>" + cell("x", '<w:vMerge w:val="restart"/>') + cell("1 &amp; 2") + "</w:tr><w:tr>" + cell("", "<w:vMerge/>") + cell("3") + "</w:tr></w:tbl>"
    body = f'<w:p><w:r><w:t>Hello</w:t></w:r></w:p>{table}<w:p><w:r><w:br w:type="page"/><w:t>Next</w:t></w:r></w:p><w:p><a:graphicData uri="http://x/chart"/></w:p>'
    return archive(**{"[Content_Types].xml": "<x/>", "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/charts/chart1.xml": CHART, "docProps/core.xml": CORE})


def test_docx():
    text, meta = ooxml.read_docx(docx())
    assert text.startswith("[Page Number: 1]\nHello\n<table border='1'>\n<tr><th colspan='2'>A</th></tr>\n<tr><td rowspan='2'>x</td><td>1 &amp; 2</td></tr>\n<tr><td>3</td></tr>\n</table>\n[Page Number: 2]\nNext")
    assert "[chart]\nChart Type: Bar Chart\nTitle: Sales\n\n<table border='1'>" in text and "<td>1,234.50</td>" in text and "<tr><td>Q2</td><td></td></tr>" in text
    assert meta == {"title": "Report", "author": "Kim"}


def test_xlsx():
    sheet = '<worksheet xmlns="http://m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2"><v>7</v></c><c r="B2" s="1"><v>44197</v></c></row><row><c r="E9"><v>5</v></c></row></sheetData></worksheet>'
    data = archive(**{
        "xl/workbook.xml": '<workbook xmlns="http://m" xmlns:r="http://r"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/sharedStrings.xml": '<sst xmlns="http://m"><si><t>key</t></si></sst>',
        "xl/styles.xml": '<styleSheet xmlns="http://m"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })
    text, _ = ooxml.read_xlsx(data)
    assert text == "[Sheet: One]\n\n[Table 1]\n\n| key | n |\n| --- | --- |\n| 7 | 2021-01-01 00:00:00 |\n\n[Table 2]\n\n| 5 |\n| --- |"


def test_pptx():
    def shape(x, y, paragraphs):
        return f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody>{paragraphs}</p:txBody></p:sp>'

    listed = "".join(f'<a:p><a:pPr><a:buAutoNum type="romanLcPeriod"/></a:pPr><a:r><a:t>{t}</a:t></a:r></a:p>' for t in ("one", "two"))
    slide = f"<p:sld {W}><p:cSld><p:spTree>{shape(0, 500, listed)}{shape(0, 10, '<a:p><a:r><a:t>Title</a:t></a:r></a:p>')}</p:spTree></p:cSld></p:sld>"
    empty = f"<p:sld {W}><p:cSld><p:spTree/></p:cSld></p:sld>"
    text, _ = ooxml.read_pptx(archive(**{"ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": empty}))
    assert text == "[Slide Number: 1]\nTitle\ni. one\nii. two\n\n[Slide Number: 2]\n[Empty Slide]"


def test_hwpx():
    section = '<s xmlns:hp="http://h"><hp:p><hp:run><hp:t>가나</hp:t></hp:run></hp:p><hp:p><hp:run><hp:tbl><hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>a</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="0" rowAddr="0"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc><hp:tc><hp:subList><hp:p><hp:run><hp:t>b</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="1" rowAddr="0"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc></hp:tr></hp:tbl></hp:run></hp:p></s>'
    text, _ = ooxml.read_hwpx(archive(**{"Contents/section0.xml": section, "Contents/content.hpf": "<x/>"}))
    assert text == "가나\n<table border='1'>\n<tr><td>a</td><td>b</td></tr>\n</table>"


def test_rtf():
    data = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\info{\title Caf\'e9}{\creatim\yr2020\mo2\dy3\hr4\min5}}\pard Gr\'fc\'dfe \u8364?5\par\trowd\clmgf\cellx1\clmrg\cellx2\cellx3 A\cell\cell B\cell\row\trowd\cellx1\cellx2\cellx3 1\cell 2\cell 3\cell\row\pard end -7 x\par}"
    text, meta = rtf.read_rtf(data)
    assert text == "[Page Number: 1]\n\nGrüße €5\n\n<table border='1'>\n<tr><td colspan='2'>A</td><td>B</td></tr>\n<tr><td>1</td><td>2</td><td>3</td></tr>\n</table>\n\nend x"
    assert meta == {"title": "Café", "create_time": "2020-02-03 04:05:00"}


def record(tag, level, payload):
    return struct.pack("<I", tag | level << 10 | len(payload) << 20) + payload


def test_hwp_and_compound_file():
    cells = b"".join(record(ole.LIST_HEADER, 2, bytes(8) + struct.pack("<HHHH", c, 0, 1, 1)) + record(ole.PARA_TEXT, 3, t.encode("utf-16-le")) for c, t in ((0, "가"), (1, "나")))
    body = record(ole.PARA_TEXT, 1, "본문\r".encode("utf-16-le")) + record(ole.CTRL_HEADER, 1, b" lbt") + cells + record(ole.PARA_TEXT, 1, "끝".encode("utf-16-le"))
    packed = zlib.compressobj(wbits=-15)
    raw = packed.compress(body) + packed.flush()
    head = bytes(36) + b"\x01" + bytes(219)
    data = ole.write_compound({"FileHeader": head, "BodyText/Section0": raw})
    assert ole.CompoundFile(data).read("FileHeader")[:256] == head
    text, _ = ole.read_hwp(data)
    assert text == "본문\n<table border='1'>\n<tr><td>가</td><td>나</td></tr>\n</table>\n끝"


def test_hwp_pictures_and_recovery():
    png = b"\x89PNG\r\n\x1a\n" + bytes(20)
    info = b"".join(record(ole.BIN_DATA, 1, struct.pack("<HHH", 1, n, 3) + "png".encode("utf-16-le")) for n in (1, 2))
    body = record(ole.PARA_TEXT, 1, "앞".encode("utf-16-le")) + record(ole.PICTURE, 2, bytes(79) + struct.pack("<H", 2) + bytes(9))
    packed = zlib.compressobj(wbits=-15)
    data = ole.write_compound({"FileHeader": bytes(256), "DocInfo": info, "BodyText/Section0": body, "BinData/BIN0002.png": packed.compress(png) + packed.flush()})
    assert ole.read_hwp(data)[0] == "앞\n[Image:BIN0002.png]\n=== Extracted Images (Not Inline) ===\n[Image:BIN0001.png]"
    assert ole.picture_bytes(ole.CompoundFile(data), "bin0002.PNG")[: len(png)] == png
    broken = b"xx" + zlib.compress(("복구할 수 있는 본문 " * 10).encode("utf-16-le"))
    assert "복구할 수 있는 본문" in ole.read_hwp(broken)[0]


def test_xls():
    def rec(kind, body=b""):
        return struct.pack("<HH", kind, len(body)) + body

    first = struct.pack("<II", 2, 2) + struct.pack("<HB", 3, 0) + b"key" + struct.pack("<HB", 4, 0) + b"na"  # the second string goes on, as wide text
    sheet = rec(xls.BOF) + rec(xls.LABELSST, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(xls.LABELSST, struct.pack("<HHHI", 0, 1, 0, 1)) + rec(xls.NUMBER, struct.pack("<HHHd", 1, 0, 0, 7.0)) + rec(xls.RK, struct.pack("<HHHI", 1, 1, 1, 44197 << 2 | 2)) + rec(xls.MULRK, struct.pack("<HHHIHIH", 2, 0, 0, 150 << 2 | 3, 0, (5 << 2) | 2, 1)) + rec(xls.EOF)
    head = rec(xls.XF, struct.pack("<HH", 0, 0)) + rec(xls.XF, struct.pack("<HH", 0, 14)) + rec(xls.SST, first) + rec(xls.CONTINUE, b"\x01" + "가나".encode("utf-16-le"))
    bound = lambda at: rec(xls.BOUNDSHEET, struct.pack("<IHBB", at, 0, 1, 0) + b"S")
    size = len(rec(xls.BOF) + head + bound(0) + rec(xls.EOF))
    data = ole.write_compound({"Workbook": rec(xls.BOF) + head + bound(size) + rec(xls.EOF) + sheet})
    assert xls.read_xls(data)[0] == "[Sheet: S]\n\n| key | na가나 |\n| --- | --- |\n| 7 | 2021-01-01 |\n| 1.5 | 5 |"


def test_doc_sniffing():
    word = b"\xec\xa5" + bytes(510) + "Hello world 안녕".encode("utf-16-le")
    assert "Hello world 안녕" in read_file(ole.write_compound({"WordDocument": word}), "doc")[0]
    assert read_file(b"<html><body><p>Hi</p><table><tr><td>1</td><td>2</td></tr></table></body></html>", "doc")[0] == "Hi\n1\n2\n\n<table border='1'>\n<tr><td>1</td><td>2</td></tr>\n</table>"
    assert read_file(docx(), "doc")[0].startswith("[Page Number: 1]\nHello")


def test_pdf():
    stream = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello) Tj 0 -20 Td [(Wor) -50 (ld) -300 (again)] TJ ET")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream", b"<< /Title (Test) /CreationDate (D:20200102030405Z) >>"]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R /Info 5 0 R >>"
    assert pdf.read_pdf(data) == ("[Page Number: 1]\nHello\nWorld again", {"title": "Test", "create_time": "2020-01-02 03:04:05"})


def test_pdf_ruled_table():
    lines = b"".join(b"%d %d m %d %d l S " % v for v in [(100, 600, 300, 600), (100, 620, 300, 620), (100, 640, 300, 640), (100, 600, 100, 640), (200, 600, 200, 640), (300, 600, 300, 640)])
    cells = b"".join(b"BT 1 0 0 1 %d %d Tm (%s) Tj ET " % v for v in [(105, 625, b"A"), (205, 625, b"B <"), (105, 605, b"1"), (205, 605, b"2"), (230, 605, b"3")])
    stream = b"q 1 0 0 1 0 10 cm " + lines + cells + b"Q BT 100 700 Td (Above) Tj ET BT 100 500 Td (Below) Tj ET"
    texts, tables = pdf.page_items(stream)
    assert len(tables) == 6 and len(texts) == 7
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream"]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>"
    assert pdf.read_pdf(data)[0] == "[Page Number: 1]\nAbove\n<table border='1'>\n<tr><th>A</th><th>B &lt;</th></tr>\n<tr><td>1</td><td>2 3</td></tr>\n</table>\nBelow"


def test_text_and_csv():
    assert text_files.decode("한글".encode("cp949")) == ("한글", "cp949")
    assert text_files.decode_marked("a,b".encode("utf-16"))[0] == "a,b"
    assert text_files.read_csv("이름;값\n가;1\n나;2\n".encode("cp949"))[0] == "| 이름 | 값 |\n| --- | --- |\n| 가 | 1 |\n| 나 | 2 |"
    assert text_files.read_csv(b"a,b\n1,\n,2\n")[0] == "<table border='1'>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n<tr>\n<td colspan='2' rowspan='2'>1</td>\n</tr>\n<tr>\n<td>2</td>\n</tr>\n</table>"


def test_html_cleaner():
    assert html.clean_html("<div class='x'><script>var a='</p>'</script><p><b>Hi</b>  there</p><p></p></div>") == "<div><p>Hi there</p></div>"
    grid = html.unrolled(html.parse("<table><tr><td rowspan='2'>a</td><td>-</td></tr><tr><td>b</td></tr></table>").tables[0].rows)
    assert grid == [["a", "None"], ["a", "b"]]


def test_read_documents(spark, tmp_path):
    for name, data in {"a.txt": b"one\n\n\n\ntwo ", "b.py": b"x\t= 1\n\n", "c.docx": docx(), "d.csv": b"a,b\n1,2\n", "e.docx": b"broken", "f.xyz": b"?", "g.txt": "한글".encode("cp949"), "h.png": b"\x89PNG"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rpartition("/")[2]: r for r in read_documents(scan(spark, str(tmp_path)), language="en").collect()}
    assert rows["a.txt"]["text"] == "one\n\ntwo" and rows["b.py"]["text"] == "x    = 1" and rows["g.txt"]["text"] == "한글"
    assert rows["c.docx"]["text"].startswith("<Document-Metadata>\n  Title: Report\n  Author: Kim\n</Document-Metadata>\n\n[Page Number: 1]")
    assert rows["d.csv"]["text"].endswith("| a | b |\n| --- | --- |\n| 1 | 2 |") and rows["h.png"]["text"] == "[Image:h.png]"
    assert rows["e.docx"]["text"] is None and rows["e.docx"]["error"] and rows["f.xyz"]["error"].startswith("Unsupported")
