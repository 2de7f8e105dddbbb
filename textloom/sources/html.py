"""HTML files: text, and a cleaner that keeps structure but no decoration."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

HIDDEN = {"script", "style", "meta", "link", "head", "title", "noscript"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "blockquote", "pre", "hr"}
VOID = {"br", "hr", "img", "input", "meta", "link"}
UNWRAPPED = {"font", "u", "b", "span", "strong", "em", "i"}


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int, bool]]] = []


class TextParser(HTMLParser):
    """Visible text by lines, and the grids of the tables."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.tables: list[_Table] = []
        self.open: list[_Table] = []
        self.hidden = 0
        self.cell: list[str] | None = None
        self.shape = (1, 1, False)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN and tag not in VOID:
            self.hidden += 1
        if tag in BLOCKS:
            self.out.append("\n")
        if tag == "table":
            self.open.append(_Table())
        elif tag == "tr" and self.open:
            self.open[-1].rows.append([])
        elif tag in ("td", "th") and self.open:
            a = dict(attrs)
            span = [int(v) if (v := a.get(k) or "1").isdigit() else 1 for k in ("rowspan", "colspan")]
            self.cell, self.shape = [], (span[0], span[1], tag == "th")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and tag not in VOID and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.out.append("\n")
        if tag in ("td", "th") and self.cell is not None and self.open:
            if not self.open[-1].rows:
                self.open[-1].rows.append([])
            self.open[-1].rows[-1].append((" ".join("".join(self.cell).split()), *self.shape))
            self.cell = None
            self.out.append("\n")
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)
            if self.cell is not None:
                self.cell.append(data)

    @property
    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def parse(source: str) -> TextParser:
    p = TextParser()
    p.feed(source)
    p.close()
    while p.open:
        p.tables.append(p.open.pop())
    return p


def unrolled(rows: list[list[tuple[str, int, int, bool]]]) -> list[list[str]]:
    """The grid of a table with merged cells repeated; empty cells and a lone dash become `None`, as text."""
    grid: dict[tuple[int, int], str] = {}
    for i, row in enumerate(rows):
        j = 0
        for text, down, across, _ in row:
            while (i, j) in grid:
                j += 1
            for a in range(down):
                for b in range(across):
                    grid[i + a, j + b] = text if text not in ("", "-") else "None"
            j += across
    height, width = len(rows), max((j for _, j in grid), default=-1) + 1
    return [[grid.get((i, j), "None") for j in range(width)] for i in range(height)]


def table_html(rows: list[list[tuple[str, int, int, bool]]]) -> str:
    out = ["<table border='1'>"]
    for row in rows:
        cells = []
        for text, down, across, head in row:
            tag = "th" if head else "td"
            a = (f" rowspan='{down}'" if down > 1 else "") + (f" colspan='{across}'" if across > 1 else "")
            cells.append(f"<{tag}{a}>{escape(text, quote=False)}</{tag}>")
        out.append("<tr>" + "".join(cells) + "</tr>")
    return "\n".join([*out, "</table>"])


def read_html_document(source: str) -> str:
    """Text, then every table again as HTML: what a word processor's HTML file gives."""
    p = parse(source)
    return "\n\n".join([x for x in [p.text, *(table_html(t.rows) for t in p.tables)] if x])


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN and tag not in VOID:
            self.hidden += 1
        elif not self.hidden and tag not in UNWRAPPED and tag not in HIDDEN:
            keep = "".join(f' {k}="{v}"' for k, v in attrs if k in ("rowspan", "colspan") and v)
            self.out.append(f"<{tag}{keep}>")

    def handle_endtag(self, tag):
        if tag in HIDDEN and tag not in VOID:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden and tag not in UNWRAPPED and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def handle_entityref(self, name):
        if not self.hidden:
            self.out.append(f"&{name};")

    def handle_charref(self, name):
        if not self.hidden:
            self.out.append(f"&#{name};")


def clean_html(source: str) -> str:
    """HTML without hidden elements, attributes, decoration and empty elements, its white space collapsed."""
    c = _Cleaner()
    c.feed(source)
    c.close()
    text = re.sub(r"\s+", " ", "".join(c.out))
    before = None
    while before != text:
        before, text = text, re.sub(r"<(\w+)[^>]*>\s*</\1>", "", text)
    return re.sub(r">\s+<", "><", text).strip()
