"""Tables in text, HTML and Markdown: parsing, and packing of their rows into chunks that repeat the header.

Both packers are one rule over row sizes: a chunk is closed when it is not empty and its size with the next row exceeds
`limit`, which is the larger of the space a chunk has and one and a half times of it. A row longer than any limit is a
chunk of its own. `pack` runs on plain lists; `pack_column` is the same fold as a Catalyst expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a table's wrapper and its chunk label are reckoned at, and the least space for rows
WRAPPER, LABEL, LEAST = 30, 30, 100
HTML_TABLE = re.compile(r"<table[^>]*>.*?</table>", re.DOTALL | re.IGNORECASE)
MARKDOWN_TABLE = re.compile(r"(?:^|\n)(\|[^\n]+\|\n\|[-:|\s]+\|\n(?:\|[^\n]+\|(?:\n|$))+)", re.MULTILINE)

_ROW = re.compile(r"<tr[^>]*>(.*?)</tr>", re.DOTALL | re.IGNORECASE)
_CELL = re.compile(r"<(td|th)([^>]*)>(.*?)</\1>", re.DOTALL | re.IGNORECASE)
_ROWSPAN = re.compile(r"""(\s*)rowspan=["']?(\d+)["']?""", re.IGNORECASE)
_COLSPAN = re.compile(r"""colspan=["']?(\d+)["']?""", re.IGNORECASE)
_RULE = re.compile(r"^\|[-:|\s]+\|$")


@dataclass(frozen=True)
class HtmlTable:
    header: tuple[str, ...]
    rows: tuple[str, ...]
    columns: int
    source: str

    @property
    def header_text(self) -> str:
        return "\n".join(self.header)

    @property
    def header_size(self) -> int:
        return sum(len(r) + 1 for r in self.header)


@dataclass(frozen=True)
class MarkdownTable:
    header: str
    rule: str
    rows: tuple[str, ...]

    @property
    def columns(self) -> int:
        return self.rule.count("|") - 1

    @property
    def header_text(self) -> str:
        return f"{self.header}\n{self.rule}"

    @property
    def header_size(self) -> int:
        return len(self.header_text) + 1


def parse_html(source: str) -> HtmlTable | None:
    """Rows of a table, rewritten without attributes of <tr>; leading rows of <th> alone are its header."""
    header, rows, columns = [], [], 0
    for inner in _ROW.findall(source):
        heads, cells = len(re.findall(r"<th[^>]*>.*?</th>", inner, re.DOTALL | re.IGNORECASE)), len(re.findall(r"<td[^>]*>.*?</td>", inner, re.DOTALL | re.IGNORECASE))
        is_header = heads > 0 and cells == 0
        columns = max(columns, heads if is_header else cells)
        (header if is_header and not rows else rows).append(f"<tr>{inner}</tr>")
    return HtmlTable(tuple(header), tuple(rows), columns, source) if header or rows else None


def spans(row: str) -> list[tuple[int, int]]:
    """(rowspan, colspan) of the cells of a row."""
    out = []
    for _, attributes, _ in _CELL.findall(row):
        down, across = _ROWSPAN.search(attributes), _COLSPAN.search(attributes)
        out.append((int(down[2]) if down else 1, int(across[1]) if across else 1))
    return out


def span_columns(row: str) -> dict[int, int]:
    """rowspan by column of the cells that reach further down."""
    out, at = {}, 0
    for down, across in spans(row):
        if down > 1:
            out[at] = down
        at += across
    return out


def has_rowspans(source: str) -> bool:
    return any(int(n) > 1 for _, n in _ROWSPAN.findall(source))


def clip_rowspans(rows: list[str]) -> list[str]:
    """No cell reaches below the last of these rows."""

    def clipped(left: int):
        def cell(m: re.Match) -> str:
            def span(s: re.Match) -> str:
                n = min(int(s[2]), left)
                return "" if n <= 1 else f"{s[1]}rowspan='{n}'"

            return f"<{m[1]}{_ROWSPAN.sub(span, m[2])}>{m[3]}</{m[1]}>"

        return cell

    return [_CELL.sub(clipped(len(rows) - i), r) for i, r in enumerate(rows)]


def row_blocks(rows: tuple[str, ...]) -> list[list[str]]:
    """Rows that cells bind together stay in one block."""
    blocks: list[list[str]] = []
    open_until: dict[int, int] = {}
    for i, row in enumerate(rows):
        open_until = {c: end for c, end in open_until.items() if end > i}
        bound = bool(open_until)
        for c, n in span_columns(row).items():
            open_until[c] = max(open_until.get(c, 0), i + n)
        if bound and blocks:
            blocks[-1].append(row)
        else:
            blocks.append([row])
    return blocks


def space_for_rows(size: int, header: int, total: int = 1) -> int:
    return max(LEAST, size - WRAPPER - header - (LABEL if total > 1 else 0))


def pack(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """(first, end) of the items of each chunk."""
    out, first, filled = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and filled + n > limit:
            out.append((first, i))
            first, filled = i, 0
        filled += n
    return [*out, (first, len(sizes))] if sizes else out


def pack_column(sizes: Column, limit: Column) -> Column:
    """array<int>: the chunk number of each item, by the same rule."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("filled"))

    def step(acc: Column, n: Column) -> Column:
        close = (F.size(acc["out"]) > 0) & (acc["filled"] + n > limit) & (acc["filled"] > 0)
        chunk = acc["chunk"] + F.when(close, 1).otherwise(0)
        return F.struct(F.concat(acc["out"], F.array(chunk)).alias("out"), chunk.alias("chunk"), (F.when(close, F.lit(0).cast("bigint")).otherwise(acc["filled"]) + n).alias("filled"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _labelled(prefix: str, label: str, body: str) -> str:
    return "\n".join([*([prefix] if prefix else []), *([label] if label else []), body])


def _label(i: int, total: int) -> str:
    return f"[Table Chunk {i + 1}/{total}]" if total > 1 else ""


def _assemble(bodies: list[str], prefix: str, estimate: int) -> list[str]:
    """Labels count the real chunks. A lone chunk keeps the label of the estimate, and chunks of a table that was
    estimated to be one carry theirs in front of the context."""
    n = len(bodies)
    if n == 1:
        return [_labelled(prefix, _label(0, estimate), bodies[0])]
    if estimate > 1:
        return [_labelled(prefix, _label(i, n), b) for i, b in enumerate(bodies)]
    return [_labelled("", _label(i, n), _labelled(prefix, "", b)) for i, b in enumerate(bodies)]


def chunk_html(source: str, size: int, prefix: str = "") -> list[str]:
    """Chunks of an HTML table: the whole if it fits or has no rows to part, else packed rows under the header."""
    table = parse_html(source)
    if table is None or not table.rows or len(source) + len(prefix) <= size:
        return [f"{prefix}\n{source}" if prefix else source]
    context = len(prefix) + 2 if prefix else 0
    overhead = table.header_size + context
    cap = int(size * 1.5) - overhead - LABEL
    if has_rowspans(source):
        blocks = row_blocks(table.rows)
        limit, estimate = max(space_for_rows(size, overhead), cap), 2
    else:
        blocks = [[r] for r in table.rows]
        estimate = max(1, math.ceil(sum(map(len, table.rows)) / space_for_rows(size, overhead)))
        limit = max(space_for_rows(size, overhead, estimate), cap)
    bodies = []
    for a, b in pack([sum(len(r) + 1 for r in block) for block in blocks], limit):
        rows = clip_rowspans([r for block in blocks[a:b] for r in block])
        bodies.append("\n".join(["<table border='1'>", *([table.header_text] if table.header else []), *rows, "</table>"]))
    return _assemble(bodies, prefix, 1 if has_rowspans(source) and len(bodies) == 1 else estimate)


def parse_markdown(text: str) -> MarkdownTable | None:
    lines = [x.strip() for x in text.strip().split("\n") if x.strip()]
    at = next((i for i, x in enumerate(lines) if _RULE.match(x)), -1)
    if at < 1:
        if len(lines) < 2 or not lines[0].startswith("|") or "---" not in lines[1]:
            return None
        at = 1
    return MarkdownTable(lines[at - 1], lines[at], tuple(lines[at + 1 :]))


def is_markdown_table(text: str) -> bool:
    lines = [x.strip() for x in text.strip().split("\n")]
    return len(lines) >= 2 and any(x.startswith("|") for x in lines) and any("---" in x and "|" in x for x in lines)


def chunk_markdown(text: str, size: int, prefix: str = "") -> list[str]:
    table = parse_markdown(text)
    if table is None or not table.rows or len(text) + len(prefix) <= size:
        return [f"{prefix}\n{text}" if prefix else text]
    context = len(prefix) + 2 if prefix else 0
    room = size - table.header_size - context
    total = sum(len(r) + 1 for r in table.rows)
    space = room - LABEL
    estimate = max(1, math.ceil(total / space)) if space > 0 else len(table.rows)
    limit = max(room if estimate == 1 else space, int(size * 1.5) - table.header_size - context - LABEL)
    bodies = ["\n".join([table.header_text, *table.rows[a:b]]) for a, b in pack([len(r) + 1 for r in table.rows], limit)]
    return _assemble(bodies, prefix, estimate)


def chunk_table(text: str, size: int, prefix: str = "") -> list[str]:
    return chunk_markdown(text, size, prefix) if is_markdown_table(text) else chunk_html(text, size, prefix)


def find_tables(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, content) of the tables of a text; of overlapping ones the first."""
    found = [(m.start(), m.end(), "html", m[0]) for m in HTML_TABLE.finditer(text)] if "<" in text else []
    if "|" in text:
        found += [(m.start(1), m.end(1), "markdown", m[1].strip()) for m in MARKDOWN_TABLE.finditer(text)]
    out: list[tuple[int, int, str, str]] = []
    for t in sorted(found, key=lambda t: t[0]):
        if not out or t[0] >= out[-1][1]:
            out.append(t)
    return out
