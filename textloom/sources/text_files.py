"""Decoding of text files and of delimited ones: ordered cascades of encodings."""

from __future__ import annotations

import codecs

from textloom.operators.csv_tables import merge_grid, parse, rows_to_html, sniff

# fixed values: encodings tried for text, and byte order marks, longest first
TEXT_ENCODINGS = ("utf-8", "utf-8-sig", "cp949", "euc-kr", "latin-1", "ascii")
MARKS = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
CODE = set("py js ts java cpp c h cs go rs php rb swift kt scala dart r sql html css jsx tsx vue svelte".split())


def decode(data: bytes, encodings: tuple[str, ...] = TEXT_ENCODINGS) -> tuple[str, str]:
    """(text, encoding): the first that decodes; UTF-8 with replacements if none does."""
    for e in encodings:
        try:
            return data.decode(e), e
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8"


def decode_marked(data: bytes, preferred: str | None = None) -> tuple[str, str]:
    """As `decode`, a byte order mark first, then the preferred encoding."""
    for mark, e in MARKS:
        if data.startswith(mark):
            return data.decode(e, "replace"), e
    return decode(data, ((preferred,) if preferred else ()) + TEXT_ENCODINGS)


def clean(text: str) -> str:
    import re

    return re.sub(r"\n\s*\n\s*\n+", "\n\n", text).strip()


def read_text(data: bytes, extension: str) -> str:
    text, _ = decode(data)
    return text.rstrip().replace("\t", "    ") if extension in CODE else clean(text)


def header_like(rows: list[list[str]]) -> bool:
    import re

    number = re.compile(r"-?\d+|-?\d+\.\d+|-?\d{1,3}(,\d{3})*(\.\d+)?|-?\d+%|\$-?\d+(\.\d+)?|₩-?\d+(,\d{3})*")
    if len(rows) < 2:
        return False
    first, second = rows[0], rows[1]
    return not any(number.fullmatch(c.strip()) for c in first) and (any(number.fullmatch(c.strip()) for c in second) or len(set(first)) == len(first))


def merged(rows: list[list[str]]) -> bool:
    below = any(r and not r[0].strip() for r in rows[1:])
    return len(rows) > 1 and (below or any(not b.strip() and a.strip() for r in rows for a, b in zip(r, r[1:])))


def markdown(rows: list[list[str]]) -> str:
    lines = ["| " + " | ".join(c.strip().replace("|", "\\|").replace("\n", " ") for c in r) + " |" for r in rows]
    rule = "| " + " | ".join(["---"] * len(rows[0])) + " |" if rows else ""
    return "\n".join([*lines[:1], *([rule] if rows else []), *lines[1:]])


def read_csv(data: bytes, extension: str = "csv", delimiter: str | None = None) -> tuple[str, dict]:
    """(table text, facts): an HTML table where blanks hint at merged cells, else Markdown."""
    text, encoding = decode_marked(data)
    d = delimiter or ("\t" if extension == "tsv" else sniff(text))
    rows = parse(text, d)
    header = header_like(rows)
    body = rows_to_html(rows, header) if merged(rows) else markdown(rows)
    return body, {"encoding": encoding, "delimiter": d, "row_count": str(len(rows)), "col_count": str(max(map(len, rows), default=0))}


__all__ = ["decode", "decode_marked", "read_text", "read_csv", "merge_grid"]
