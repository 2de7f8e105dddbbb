"""DOCX, XLSX, PPTX and HWPX: ZIP archives of XML, read with the standard library."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree as ET

from textloom.functions.blocks import CHART_TYPES
from textloom.operators.grids import components, merge_boxes


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def find_all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if local(x.tag) == name)


def first(e: ET.Element, name: str) -> ET.Element | None:
    return next(find_all(e, name), None)


def children(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e if local(x.tag) == name]


def part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(z.read(name))
    except (KeyError, ET.ParseError):
        return None


def numbered_parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def core_metadata(z: zipfile.ZipFile) -> dict[str, str]:
    root = part(z, "docProps/core.xml")
    names = {"title": "title", "subject": "subject", "creator": "author", "keywords": "keywords", "description": "comments", "lastModifiedBy": "last_saved_by", "created": "create_time", "modified": "last_saved_time"}
    found = {} if root is None else {names[local(x.tag)]: x.text.strip() for x in root if local(x.tag) in names and x.text and x.text.strip()}
    return {k: found[k] for k in names.values() if k in found}


def chart_text(root: ET.Element) -> str | None:
    """A chart part as a chart block, None if it holds no data."""
    area = first(root, "plotArea")
    kind = next((local(x.tag) for x in area if local(x.tag).endswith("Chart")), "") if area is not None else ""
    title_element = first(root, "title")
    title = "".join(t.text or "" for t in find_all(title_element, "t")) if title_element is not None else ""
    categories: list[str] = []
    series: list[tuple[str, list[str]]] = []

    def points(e: ET.Element | None) -> list[str]:
        return [] if e is None else [(first(p, "v").text or "") if first(p, "v") is not None else "" for p in find_all(e, "pt")]

    for i, s in enumerate(find_all(root, "ser")):
        name = points(next(iter(children(s, "tx")), None))
        labels = points(next(iter([*children(s, "cat"), *children(s, "xVal")]), None))
        values = points(next(iter([*children(s, "val"), *children(s, "yVal")]), None))
        categories = categories or labels
        if values:
            series.append((name[0] if name else f"Series {i + 1}", values))
    if not series:
        return None

    def shown(v: str) -> str:
        try:
            return f"{float(v):,.2f}"
        except ValueError:
            return escape(v, quote=True)

    rows = ["<table border='1'>", "<tr><th>Category</th>" + "".join(f"<th>{escape(n, quote=True)}</th>" for n, _ in series) + "</tr>"]
    for i in range(max(len(categories), *(len(v) for _, v in series))):
        label = escape(categories[i], quote=True) if i < len(categories) else f"Item {i + 1}"
        rows.append(f"<tr><td>{label}</td>" + "".join(f"<td>{shown(v[i]) if i < len(v) and v[i] else ''}</td>" for _, v in series) + "</tr>")
    head = ["[chart]", *([f"Chart Type: {CHART_TYPES.get(kind, kind)}"] if kind else []), *([f"Title: {title}"] if title else []), ""]
    return "\n".join([*head, *rows, "</table>", "[/chart]"])


def render_table(rows: list[list[tuple[str, int, int]]], header: bool = True, escaped: bool = True) -> str:
    """One cell: its text; one column: its texts by blank lines; else an HTML table. Cells: (text, rowspan, colspan)."""
    width = max((sum(c[2] for c in r) for r in rows), default=0)
    if len(rows) == 1 and width == 1:
        return rows[0][0][0]
    if width == 1:
        return "\n\n".join(c[0] for r in rows for c in r if c[0])
    out = ["<table border='1'>"]
    for i, row in enumerate(rows):
        tag = "th" if header and i == 0 else "td"
        cells = []
        for text, down, across in row:
            a = (f" rowspan='{down}'" if down > 1 else "") + (f" colspan='{across}'" if across > 1 else "")
            body = escape(text, quote=False) if escaped else text
            cells.append(f"<{tag}{a}>" + body.replace("\n", "<br>") + f"</{tag}>")
        out.append("<tr>" + "".join(cells) + "</tr>")
    return "\n".join([*out, "</table>"])


# DOCX


def _docx_paragraph(p: ET.Element, charts: Iterator[str], images: dict[str, str]) -> tuple[str, bool]:
    """(text, whether a page ends here)"""
    out, breaks = [], False
    for e in p.iter():
        name = local(e.tag)
        if name == "t":
            out.append(e.text or "")
        elif name == "tab":
            out.append("\t")
        elif name == "br":
            breaks |= attribute(e, "type") == "page"
            if attribute(e, "type") is None:
                out.append("\n")
        elif name == "lastRenderedPageBreak":
            breaks = True
        elif name == "graphicData":
            uri = e.attrib.get("uri", "")
            if uri.endswith("/chart"):
                out.append(next(charts, ""))
            elif uri.endswith("/diagram"):
                texts = [t.text for t in find_all(e, "t") if t.text]
                out.append(f"[Diagram: {' / '.join(texts)}]" if texts else "[Diagram]")
            elif (blip := first(e, "blip")) is not None:
                out.append(images.get(attribute(blip, "embed") or "", "[Unknown Image]"))
    return "".join(out).strip(), breaks


def _docx_table(table: ET.Element) -> list[list[tuple[str, int, int]]]:
    grid: list[list[dict]] = []
    for tr in children(table, "tr"):
        row, at = [], 0
        for tc in children(tr, "tc"):
            properties = next(iter(children(tc, "tcPr")), None)
            across, merge = 1, None
            if properties is not None:
                span = next(iter(children(properties, "gridSpan")), None)
                across = int(attribute(span, "val") or 1) if span is not None else 1
                v = next(iter(children(properties, "vMerge")), None)
                merge = None if v is None else attribute(v, "val") or "continue"
            text = "\n".join(x for p in children(tc, "p") if (x := "".join(t.text or "" for t in find_all(p, "t")).strip()))
            nested = ["\n".join(" | ".join(c[0] for c in r) for r in _docx_table(t)) for t in children(tc, "tbl")]
            row.append({"text": "\n".join([text, *nested]).strip(), "at": at, "across": across, "merge": merge, "down": 1})
            at += across
        grid.append(row)
    for i, row in enumerate(grid):
        for cell in row:
            if cell["merge"] == "restart":
                for below in grid[i + 1 :]:
                    under = next((c for c in below if c["at"] == cell["at"]), None)
                    if under is None or under["merge"] != "continue":
                        break
                    cell["down"] += 1
    return [[(c["text"], c["down"], c["across"]) for c in row if c["merge"] != "continue"] for row in grid]


def _relations(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    folder, _, base = name.rpartition("/")
    root = part(z, f"{folder}/_rels/{base}.rels")
    return {} if root is None else {r.attrib.get("Id", ""): r.attrib.get("Target", "") for r in root}


def read_docx(data: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata) in the order of the body; pages are counted by page breaks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = part(z, "word/document.xml")
        charts = iter([c for n in numbered_parts(z, r"word/charts/chart(\d+)\.xml") if (c := chart_text(part(z, n)) or "[chart]\n(Chart content could not be extracted)\n[/chart]")])
        images = {k: f"[Image:{v.rpartition('/')[2]}]" for k, v in _relations(z, "word/document.xml").items() if "media/" in v}
        out, page = ["[Page Number: 1]"], 1
        body = first(root, "body") if root is not None else None
        for e in body if body is not None else ():
            if local(e.tag) == "p":
                text, breaks = _docx_paragraph(e, charts, images)
                if breaks:
                    page += 1
                    out.append(f"[Page Number: {page}]")
                if text:
                    out.append(text)
            elif local(e.tag) == "tbl":
                rows = _docx_table(e)
                if rows and (rendered := render_table(rows)):
                    out.append(rendered)
        return "\n".join(out), core_metadata(z)


# XLSX


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


_DATE_FORMATS = {14, 15, 16, 17, 22}


def _sheet_cells(root: ET.Element, shared: list[str], date_styles: set[int]) -> dict[tuple[int, int], str]:
    out: dict[tuple[int, int], str] = {}
    for row in find_all(root, "row"):
        for c in children(row, "c"):
            ref, kind = c.attrib.get("r", ""), c.attrib.get("t", "n")
            v = next(iter(children(c, "v")), None)
            value = ""
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in find_all(c, "t"))
            elif v is not None and v.text is not None:
                value = shared[int(v.text)] if kind == "s" else v.text
                if kind == "n" and int(c.attrib.get("s", 0)) in date_styles:
                    value = str(datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value)))
                elif kind == "b":
                    value = "True" if value == "1" else "False"
            if ref and value.strip():
                out[int(re.search(r"\d+", ref)[0]), _column(ref)] = value.strip()
    return out


def _sheet_tables(cells: dict[tuple[int, int], str], merges: list[tuple[int, int, int, int]]) -> list[str]:
    filled = set(cells)
    boxes = merge_boxes(components(filled) + [m for m in merges if any((r, c) in filled for r in range(m[0], m[2] + 1) for c in range(m[1], m[3] + 1))])
    out = []
    for r0, c0, r1, c1 in boxes:
        inside = [m for m in merges if r0 <= m[0] and m[2] <= r1 and c0 <= m[1] and m[3] <= c1]
        if inside:
            start = {(m[0], m[1]): m for m in inside}
            covered = {(r, c) for m in inside for r in range(m[0], m[2] + 1) for c in range(m[1], m[3] + 1)} - set(start)
            rows = []
            for r in range(r0, r1 + 1):
                row = []
                for c in range(c0, c1 + 1):
                    if (r, c) not in covered:
                        m = start.get((r, c), (r, c, r, c))
                        row.append((cells.get((r, c), ""), m[2] - m[0] + 1, m[3] - m[1] + 1))
                rows.append(row)
            html = ["<table border='1'>"]
            for i, row in enumerate(rows):
                tag = "th" if i == 0 else "td"
                html.append("<tr>" + "".join(f"<{tag}" + (f" rowspan='{d}'" if d > 1 else "") + (f" colspan='{a}'" if a > 1 else "") + f">{escape(t, quote=False)}</{tag}>" for t, d, a in row) + "</tr>")
            out.append("\n".join([*html, "</table>"]))
        else:
            lines = []
            for r in range(r0, r1 + 1):
                row = [cells.get((r, c), "").replace("|", "\\|").replace("\n", " ") for c in range(c0, c1 + 1)]
                if any(row):
                    lines.append("| " + " | ".join(row) + " |")
                    if len(lines) == 1:
                        lines.append("| " + " | ".join(["---"] * len(row)) + " |")
            out.append("\n".join(lines))
    return out


def read_xlsx(data: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata): each sheet with its tag, tables (numbered if there are several), charts, images and text boxes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = part(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in find_all(si, "t")) for si in children(strings, "si")] if strings is not None else []
        styles = part(z, "xl/styles.xml")
        dates: set[int] = set()
        if styles is not None:
            custom = {int(f.attrib["numFmtId"]) for f in find_all(styles, "numFmt") if re.search(r"[dy]", re.sub(r"\[[^\]]*\]|\"[^\"]*\"", "", f.attrib.get("formatCode", "").lower()))}
            xfs = first(styles, "cellXfs")
            dates = {i for i, x in enumerate(xfs if xfs is not None else ()) if int(x.attrib.get("numFmtId", 0)) in _DATE_FORMATS | custom}
        book, links = part(z, "xl/workbook.xml"), _relations(z, "xl/workbook.xml")
        out: list[str] = []
        charts = {n: chart_text(root) for n in numbered_parts(z, r"xl/charts/chart(\d+)\.xml") if (root := part(z, n)) is not None}
        used: set[str] = set()
        for sheet in find_all(book, "sheet") if book is not None else ():
            target = links.get(attribute(sheet, "id") or "", "")
            path = target.lstrip("/") if target.startswith("/") else "xl/" + target
            root = part(z, path)
            if root is None:
                continue
            merges = []
            for m in find_all(root, "mergeCell"):
                a, _, b = m.attrib.get("ref", "A1:A1").partition(":")
                merges.append((int(re.search(r"\d+", a)[0]), _column(a), int(re.search(r"\d+", b)[0]), _column(b)))
            tables = _sheet_tables(_sheet_cells(root, shared, dates), merges)
            parts = [f"[Sheet: {sheet.attrib.get('name', '')}]"]
            for i, t in enumerate(tables):
                parts += [f"[Table {i + 1}]", t] if len(tables) > 1 else [t]
            for rel in _relations(z, path).values():
                if "drawing" in rel and rel.endswith(".xml"):
                    name = "xl/drawings/" + rel.rpartition("/")[2]
                    drawing = part(z, name)
                    for target2 in _relations(z, name).values():
                        chart = "xl/charts/" + target2.rpartition("/")[2]
                        if chart in charts:
                            used.add(chart)
                            parts += [charts[chart]] if charts[chart] else []
                        elif "media/" in target2:
                            parts.append(f"[Image:{target2.rpartition('/')[2]}]")
                    for box in find_all(drawing, "txBody") if drawing is not None else ():
                        if text := "".join(t.text or "" for t in find_all(box, "t")).strip():
                            parts.append(f"[Textbox] {text}")
            out.append("\n\n".join(parts))
        out += [c for n, c in charts.items() if n not in used and c]
        return "\n\n".join(out), core_metadata(z)


# PPTX


def _pptx_paragraphs(shape: ET.Element) -> str:
    lines, counters = [], {}
    for p in find_all(shape, "p"):
        text = "".join((x.text or "") if local(x.tag) == "t" else "\n" for x in p.iter() if local(x.tag) in ("t", "br")).strip()
        properties = next(iter(children(p, "pPr")), None)
        depth = int(properties.attrib.get("lvl", 0)) if properties is not None else 0
        bullet = first(properties, "buChar") if properties is not None else None
        auto = first(properties, "buAutoNum") if properties is not None else None
        if not text:
            continue
        if auto is not None:
            counters[depth] = counters.get(depth, int(auto.attrib.get("startAt", 1)) - 1) + 1
            lines.append("  " * depth + f"{numbered(counters[depth], auto.attrib.get('type', 'arabicPeriod'))} {text}")
        elif bullet is not None:
            lines.append("  " * depth + f"{SYMBOLS.get(bullet.attrib.get('char', '•'), bullet.attrib.get('char', '•'))} {text}")
        else:
            counters.clear()
            lines.append(text)
    return "\n".join(lines)


# fixed values: characters of symbol fonts and what they look like
SYMBOLS = {"§": "▪", "Ø": "➢", "ü": "✓", "q": "❑", "v": "❖", "l": "●", "n": "■", "Ÿ": "•", "": "•", "": "▪", "": "➢", "": "✓"}


def numbered(n: int, form: str) -> str:
    def roman(x: int) -> str:
        out = ""
        for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out, x = out + s * (x // v), x % v
        return out

    def alpha(x: int) -> str:
        out = ""
        while x > 0:
            x, r = divmod(x - 1, 26)
            out = chr(65 + r) + out
        return out

    body = roman(n) if "roman" in form.lower() else alpha(n) if "alpha" in form.lower() else str(n)
    body = body.lower() if "Lc" in form else body
    return f"({body})" if "ParenBoth" in form else f"{body})" if "ParenR" in form else body if "Plain" in form else f"{body}."


def _pptx_shapes(tree: ET.Element, links: dict[str, str], charts: dict[str, str | None]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for shape in tree:
        kind = local(shape.tag)
        if kind not in ("sp", "pic", "graphicFrame", "grpSp"):
            continue
        off = first(shape, "off")
        x, y = (int(off.attrib.get("x", 0)), int(off.attrib.get("y", 0))) if off is not None else (0, 0)
        text = ""
        if kind == "grpSp":
            text = "\n".join(t for _, _, t in sorted(_pptx_shapes(shape, links, charts)))
        elif kind == "pic":
            blip = first(shape, "blip")
            target = links.get(attribute(blip, "embed") or "", "") if blip is not None else ""
            text = f"[Image:{target.rpartition('/')[2]}]" if target else ""
        elif kind == "graphicFrame" and (table := first(shape, "tbl")) is not None:
            rows = []
            for tr in children(table, "tr"):
                rows.append([("\n".join(x for p in find_all(tc, "p") if (x := "".join(t.text or "" for t in find_all(p, "t")))), int(tc.attrib.get("rowSpan", 1)), int(tc.attrib.get("gridSpan", 1))) for tc in children(tr, "tc") if tc.attrib.get("hMerge") != "1" and tc.attrib.get("vMerge") != "1"])
            text = "\n".join(" ".join(c[0] for c in r) for r in rows) if len(rows) == 1 or max(map(len, rows), default=0) == 1 else render_table(rows)
        elif kind == "graphicFrame" and (chart := first(shape, "chart")) is not None:
            text = charts.get("ppt/charts/" + links.get(attribute(chart, "id") or "", "").rpartition("/")[2]) or ""
        elif kind == "sp":
            text = _pptx_paragraphs(shape)
        if text.strip():
            out.append((y, x, text))
    return out


def read_pptx(data: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata): slides with their tag, shapes by (top, left), notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        charts = {n: chart_text(root) for n in numbered_parts(z, r"ppt/charts/chart(\d+)\.xml") if (root := part(z, n)) is not None}
        out = []
        for i, name in enumerate(numbered_parts(z, r"ppt/slides/slide(\d+)\.xml")):
            root, links = part(z, name), _relations(z, name)
            tree = first(root, "spTree") if root is not None else None
            texts = [t for _, _, t in sorted(_pptx_shapes(tree, links, charts), key=lambda s: s[:2])] if tree is not None else []
            out.append("\n".join([f"[Slide Number: {i + 1}]", *(texts or ["[Empty Slide]"])]))
            for target in links.values():
                if "notesSlide" in target and (notes := part(z, "ppt/notesSlides/" + target.rpartition("/")[2])) is not None:
                    bodies = [sp for sp in find_all(notes, "sp") if (ph := first(sp, "ph")) is not None and ph.attrib.get("type") == "body"]
                    if said := "\n".join(t for b in bodies if (t := _pptx_paragraphs(b).strip())):
                        out[-1] += f"\n\n[Slide Notes]\n{said}"
        return "\n\n".join(out), core_metadata(z)


# HWPX


def _hwpx_table(table: ET.Element) -> list[list[tuple[str, int, int]]]:
    cells: dict[int, list[tuple[int, str, int, int]]] = {}
    for tr in children(table, "tr"):
        for tc in children(tr, "tc"):
            at, span = first(tc, "cellAddr"), first(tc, "cellSpan")
            row, col = (int(at.attrib.get("rowAddr", 0)), int(at.attrib.get("colAddr", 0))) if at is not None else (len(cells), 0)
            down, across = (int(span.attrib.get("rowSpan", 1)), int(span.attrib.get("colSpan", 1))) if span is not None else (1, 1)
            text = "\n".join(x for p in find_all(tc, "p") if (x := "".join(t.text or "" for t in find_all(p, "t")).strip()))
            cells.setdefault(row, []).append((col, text, down, across))
    return [[(t, d, a) for _, t, d, a in sorted(cells[r])] for r in sorted(cells)]


def read_hwpx(data: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata): the top paragraphs of the sections, tables in place, pictures as tags."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        manifest = part(z, "Contents/content.hpf")
        items = {i.attrib.get("id", ""): i.attrib.get("href", "") for i in find_all(manifest, "item")} if manifest is not None else {}
        metadata: dict[str, str] = {}
        if manifest is not None:
            names = {"title": "title", "subject": "subject", "creator": "author", "keyword": "keywords", "description": "comments", "lastsaveby": "last_saved_by", "CreatedDate": "create_time", "ModifiedDate": "last_saved_time"}
            for m in find_all(manifest, "meta"):
                if m.attrib.get("name") in names and m.text:
                    metadata[names[m.attrib["name"]]] = m.text
            if (title := first(manifest, "title")) is not None and title.text:
                metadata["title"] = title.text
        out = []
        for name in numbered_parts(z, r"Contents/section(\d+)\.xml"):
            root = part(z, name)
            for p in children(root, "p") if root is not None else ():
                line = []
                for run in children(p, "run"):
                    texts = children(run, "t")
                    if texts:
                        line.append("".join(texts[0].itertext()))
                    for e in run:
                        kind = local(e.tag)
                        if kind == "tbl":
                            line.append("\n" + render_table(_hwpx_table(e), header=False) + "\n")
                        elif kind == "pic" and (img := first(e, "img")) is not None:
                            href = items.get(attribute(img, "binaryItemIDRef") or "", "")
                            line.append(f"[Image:{href.rpartition('/')[2]}]" if href else "")
                        elif kind == "chart":
                            ref = attribute(e, "chartIDRef") or ""
                            chart = part(z, ref) if ref in z.namelist() else None
                            line.append("\n" + (chart_text(chart) or "") + "\n" if chart is not None else "")
                if text := "".join(line).strip():
                    out.append(text)
        return "\n".join(out), metadata
