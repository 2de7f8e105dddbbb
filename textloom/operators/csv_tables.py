"""Delimited text to tables: delimiter, rows, header, merged cells, and rendering. Everything behind the parser works on
array<array<string>> columns as Catalyst expressions; only sniffing and parsing of whole files need Python."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textloom.functions.text import escape_html, is_numeric, strip
from textloom.operators.record_grammar import RecordGrammar

# fixed values: delimiters tried, in order
CANDIDATES = (",", "\t", ";", "|")


def sniff(content: str) -> str:
    """The delimiter of the first twenty lines: as the standard sniffer says, else the one that each line holds equally
    often (counted tenfold), else the most frequent."""
    lines = content.split("\n")[:20]
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=",\t;|").delimiter
    except csv.Error:
        pass
    counts = {d: [x.count(d) for x in lines if x.strip()] for d in CANDIDATES}
    scores = {d: (c[0] * 10 if len(set(c)) == 1 and c[0] else sum(c) / len(c)) if c else 0 for d, c in counts.items()}
    best = max(CANDIDATES, key=lambda d: scores[d])
    return best if scores[best] > 0 else ","


def parse(content: str, delimiter: str, max_rows: int | None = None, max_columns: int | None = None) -> list[list[str]]:
    """Rows that are not blank. A file with a quote that is never closed is read by the recovering grammar, which takes up again at
    the next line that starts a whole record as wide as the first; where the reader gives up, by plain splitting. Nothing
    is cut unless a limit is given."""
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    out = []
    if text.count('"') % 2:
        width = len(RecordGrammar(delimiter).record(text).fields)
        rows = [r.fields for r in RecordGrammar(delimiter, width).file(text)[:max_rows]]
        return [r[:max_columns] for r in rows if any(c.strip() for c in r)]
    try:
        for i, row in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter, skipinitialspace=True)):
            if max_rows is not None and i >= max_rows:
                break
            if any(c.strip() for c in row):
                out.append(row[:max_columns])
        return out
    except csv.Error:
        return [x.strip().split(delimiter)[:max_columns] for x in content.split("\n")[:max_rows] if x.strip()]


@F.pandas_udf(StringType())
def sniff_delimiter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else sniff(t) for t in texts], dtype=object)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def parse_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, delimiters in batches:
        yield pd.Series([None if t is None else parse(t, d or sniff(t)) for t, d in zip(texts, delimiters)], dtype=object)


def detect_header(rows: Column) -> Column:
    """Whether row 0 is a header: it has no number, and row 1 has one or the cells of row 0 differ from each other."""
    first, second = F.get(rows, 0), F.get(rows, 1)

    def number(c: Column) -> Column:
        return (strip(c) != "") & is_numeric(c)

    return F.coalesce((F.size(rows) >= 2) & ~F.exists(first, number) & (F.exists(second, number) | (F.size(F.array_distinct(first)) == F.size(first))), F.lit(False))


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def has_merged_cells(rows: Column) -> Column:
    """Whether blanks hint at merged cells: a blank first cell below row 0, or a blank behind a filled cell."""
    below = F.exists(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: (F.size(r) > 0) & _blank(F.get(r, 0)))
    beside = F.exists(rows, lambda r: F.exists(F.transform(r, lambda c, i: _blank(c) & (i > 0) & ~_blank(F.get(r, i - 1))), lambda x: F.coalesce(x, F.lit(False))))
    return F.coalesce((F.size(rows) >= 2) & (below | beside), F.lit(False))


def to_markdown(rows: Column) -> Column:
    """Stripped cells, pipes escaped, line breaks as spaces, a rule behind row 0."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def cell(c: Column) -> Column:
        return F.replace(F.replace(F.coalesce(strip(c), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))

    lines = F.transform(rows, lambda r: line(F.transform(r, cell)))
    rule = line(F.transform(F.get(rows, 0), lambda _: F.lit("---")))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")).otherwise(F.lit(""))


def merge_grid(rows: list[list[str]]) -> list[list[tuple[str, int, int] | None]]:
    """(text, colspan, rowspan) of each cell, null for those that a span covers: first a filled cell takes the blanks to
    its right, then the free blanks below it."""
    width = max((len(r) for r in rows), default=0)
    grid = [[(c or "").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    out: list[list[tuple[str, int, int] | None]] = []
    taken = [[False] * width for _ in grid]
    across = [[1] * width for _ in grid]
    for i, row in enumerate(grid):
        last = None
        for j, c in enumerate(row):
            if c:
                last = j
            elif last is not None:
                across[i][last] += 1
                taken[i][j] = True
    down = [[1] * width for _ in grid]
    for j in range(width):
        last = None
        for i, row in enumerate(grid):
            if row[j] and not taken[i][j]:
                last = i
            elif taken[i][j]:
                last = None
            elif last is not None:
                down[last][j] += 1
                taken[i][j] = True
    for i, row in enumerate(grid):
        out.append([None if taken[i][j] else (c, across[i][j], down[i][j]) for j, c in enumerate(row)])
    return out


def rows_to_html(rows: list[list[str]], has_header: bool) -> str:
    if not rows:
        return ""
    lines = ["<table border='1'>"]
    for i, row in enumerate(merge_grid(rows)):
        tag = "th" if has_header and i == 0 else "td"
        lines.append("<tr>")
        for cell in row:
            if cell is not None:
                text, across, down = cell
                attributes = "".join([f" colspan='{across}'" if across > 1 else "", f" rowspan='{down}'" if down > 1 else ""])
                text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\n", "<br>")
                lines.append(f"<{tag}{attributes}>{text}</{tag}>")
        lines.append("</tr>")
    return "\n".join([*lines, "</table>"])


@F.pandas_udf(StringType())
def merged_html(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for tables, headers in batches:
        yield pd.Series([None if t is None else rows_to_html([list(r) for r in t], bool(h)) for t, h in zip(tables, headers)], dtype=object)


def plain_html(rows: Column, has_header: Column) -> Column:
    """A table without merged cells."""

    def row(r: Column, i: Column) -> Column:
        tag = F.when(has_header & (i == 0), F.lit("th")).otherwise(F.lit("td"))
        cells = F.transform(r, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.coalesce(strip(c), F.lit("")), quotes=False, breaks=True), F.lit("</"), tag, F.lit(">")))
        return F.array_join(F.concat(F.array(F.lit("<tr>")), cells, F.array(F.lit("</tr>"))), "\n")

    return F.array_join(F.concat(F.array(F.lit("<table border='1'>")), F.transform(rows, row), F.array(F.lit("</table>"))), "\n")


def table_text(rows: Column) -> Column:
    """Cells by tabs, rows by line breaks."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t", "")), "\n")


def single_column_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.get(r, 0)), "\n")
