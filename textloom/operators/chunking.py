"""Chunking of whole documents: the router, positions, and the DataFrame operator.

Routes, in this order: table files (csv, tsv, xlsx, xls) by sheets and rows; text with page or slide tags by pages; text with
protected regions by the cursor; forced chunking by rows; plain text by separators. Texts that fit one chunk and hold
no tag are answered by the plan itself and never reach Python.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.tags import DEFAULT, Tags
from textloom.functions.text import strip
from textloom.operators.pages import clean_chunks, pack_pages, split_into_pages
from textloom.operators.regions import find_regions, split_around_regions
from textloom.operators.sheets import chunk_sheet_text, take_metadata
from textloom.operators.splitter import split_plain, split_recursive
from textloom.operators.tables import chunk_table, find_tables, is_markdown_table

TABLE_FILES = {"csv", "tsv", "xlsx", "xls"}
POSITIONS = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType() if n == "text" else T.IntegerType()) for n in ("text", "page_number", "line_start", "line_end", "global_start", "global_end", "chunk_index")])
)


def _by_rows(text: str, size: int, overlap: int) -> list[str]:
    """Forced chunking: tables are parted by rows, loose table rows are kept whole, the rest is plain."""
    out: list[str] = []
    at = 0

    def loose(part: str) -> None:
        part = part.strip()
        if not part:
            return
        if is_markdown_table(part):
            out.extend(chunk_table(part, size))
        elif "|" in part and (rows := [(m.start(), m.end()) for m in re.finditer(r"\|[^\n]+\|", part)]):
            from textloom.operators.regions import Region

            out.extend(split_around_regions(part, size, overlap, regions=[Region(a, b, "row") for a, b in rows]))
        else:
            out.extend(split_recursive(part, size, overlap))

    for start, end, _, content in find_tables(text):
        loose(text[at:start])
        out += chunk_table(content, size)
        at = end
    loose(text[at:])
    return out


def route_of(text: str, extension: str, forced: bool, tags: Tags) -> str:
    if extension in TABLE_FILES:
        return "table"
    if re.search(tags.page, text) or re.search(tags.slide, text):
        return "page"
    if find_regions(text, not forced, tags):
        return "region"
    return "row" if forced else "plain"


def chunk_document(text: str, extension: str | None = None, size: int = 1000, overlap: int = 200, preserve_tables: bool = True, tags: Tags = DEFAULT) -> list[str]:
    """Chunks of one document; blank text gives one empty chunk."""
    if not text or not text.strip():
        return [""]
    ext, forced = (extension or "").lower().lstrip("."), not preserve_tables
    if ext in TABLE_FILES:
        return chunk_sheet_text(text, size, tags)
    metadata, body = take_metadata(text, tags)
    route = route_of(body, ext, forced, tags)
    if route == "page":
        pages = next(p for p in (split_into_pages(body, tags.page), split_into_pages(body, tags.slide), [(0, body)]) if p)
        chunks = []
        for chunk in pack_pages([p for _, p in pages], size, overlap):
            chunks += split_around_regions(chunk, size, overlap, forced, tags) if len(chunk) > 1.5 * int(size * 1.5) else [chunk]
    elif route == "region":
        chunks = split_around_regions(body, size, overlap, forced, tags)
    elif route == "row":
        chunks = _by_rows(body, size, overlap)
    else:
        chunks = split_plain(body, size, overlap)
    kept = clean_chunks(chunks, tags)
    return [f"{metadata}\n\n{c}" for c in kept] if metadata else kept


def overlap_between(a: str, b: str, longest: int) -> int:
    return next((k for k in range(min(longest, len(a), len(b)), 0, -1) if a.endswith(b[:k])), 0)


def _pages_of_lines(text: str, extension: str, tags: Tags) -> list[tuple[int, int, int]]:
    """(start, end, page) in order of their start: by tags, sheets, estimate, or a thousand lines a page."""
    n = len(text)

    def behind(marks: list[re.Match], number) -> list[tuple[int, int, int]]:
        return [(m.end(), f.start() if f else n, number(i, m)) for i, (m, f) in enumerate(zip(marks, [*marks[1:], None]))]

    if extension in ("pdf", "ppt", "pptx", "doc", "docx"):
        for pattern in (tags.page, tags.slide):
            if marks := list(re.finditer(pattern, text)):
                return behind(marks, lambda i, m: int(m[1]))
        if extension in ("doc", "docx") and n > 1500:
            return [(k * 1500, min((k + 1) * 1500, n), k + 1) for k in range(-(-n // 1500))]
    elif extension in ("xlsx", "xls"):
        if marks := list(re.finditer(tags.sheet, text)):
            return behind(marks, lambda i, m: i + 1)
    elif text.count("\n") >= 1000:
        out, at = [], 0
        lines = text.split("\n")
        for k in range(0, len(lines), 1000):
            size = sum(map(len, lines[k : k + 1000])) + len(lines[k : k + 1000]) - 1
            out.append((at, at + size, k // 1000 + 1))
            at += size + 1
        return out
    return [(0, n, 1)]


def with_positions(chunks: list[str], extension: str, overlap: int, tags: Tags = DEFAULT) -> list[dict]:
    """Each chunk with its place in the text that the chunks rebuild: lines from 1, offsets from 0, ends inclusive."""
    steps = [overlap_between(a, b, overlap) for a, b in zip(chunks, chunks[1:])]
    text = "".join([*chunks[:1], *(c[k:] for c, k in zip(chunks[1:], steps))])
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    pages = sorted(_pages_of_lines(text, extension, tags))
    page_starts = [p[0] for p in pages]

    def page(line: int) -> int:
        start = starts[line]
        end = starts[line + 1] - 1 if line + 1 < len(starts) else len(text)
        middle = start + (end - start) // 2
        i = bisect_right(page_starts, middle) - 1
        return pages[i][2] if i >= 0 and middle < pages[i][1] else 1

    out, at = [], 0
    for i, chunk in enumerate(chunks):
        end = at + len(chunk) - 1
        first, last = max(0, bisect_right(starts, at) - 1), max(0, bisect_right(starts, end) - 1)
        out.append({"text": chunk, "page_number": page(first), "line_start": first + 1, "line_end": last + 1, "global_start": at, "global_end": end, "chunk_index": i})
        at += len(chunk) - (steps[i] if i < len(steps) else 0)
    return out


def chunks_column(text: Column, extension: Column, size: int = 1000, overlap: int = 200, preserve_tables: bool = True, positions: bool = False, tags: Tags = DEFAULT) -> Column:
    """array<string>, or array<struct> with positions, of the chunks of each document; null for null."""

    @F.pandas_udf(POSITIONS if positions else T.ArrayType(T.StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, exts in batches:
            out = []
            for t, e in zip(texts, exts):
                if t is None:
                    out.append(None)
                    continue
                chunks = chunk_document(t, e, size, overlap, preserve_tables, tags)
                out.append(with_positions(chunks, (e or "").lower().lstrip("."), overlap, tags) if positions else chunks)
            yield pd.Series(out, dtype=object)

    return run(text, extension)


def chunk_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", extension: str | None = None, size: int = 1000, overlap: int = 200, preserve_tables: bool = True, positions: bool = False, tags: Tags = DEFAULT
) -> DataFrame:
    """(key, chunk_index, text) of every document, with positions if asked for. Documents that fit one chunk and hold no
    bracket, angle bracket, pipe or fence are one stripped chunk by definition: they stay in the JVM. The rest goes through
    one Arrow UDF a document; the explode comes last. Texts are scanned once: the UDF gets nulls for what it need not see."""
    ext = F.col(extension) if extension else F.lit("txt")
    base = documents.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.lower(F.coalesce(ext, F.lit(""))).alias("__ext"))
    simple = (F.length("__text") <= size) & ~F.col("__text").rlike(r"[\[<|`]") & ~F.regexp_replace("__ext", r"^\.+", "").isin(*TABLE_FILES) & F.lit(tags == DEFAULT)
    python = chunks_column(F.when(~simple, F.col("__text")), F.col("__ext"), size, overlap, preserve_tables, positions, tags)
    body = strip(F.col("__text"))
    if positions:
        lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
        one = F.array(F.struct(body.alias("text"), F.lit(1).alias("page_number"), F.lit(1).alias("line_start"), lines.cast("int").alias("line_end"), F.lit(0).alias("global_start"), (F.length(body) - 1).alias("global_end"), F.lit(0).alias("chunk_index")))
        cut = base.select("__key", F.coalesce(python, one).alias("__chunks"))
        return cut.select(F.col("__key").alias(key), F.explode("__chunks").alias("c")).select(key, "c.*")
    cut = base.select("__key", F.coalesce(python, F.array(body)).alias("__chunks"))
    return cut.select(F.col("__key").alias(key), F.posexplode("__chunks").alias("chunk_index", "text"))
