"""Pages: splitting a tagged text into pages, and packing of pages into chunks.

Packing rule, with `largest` = one and a half sizes: a page joins the open chunk if both, reckoned with four characters
between them, stay within `largest`; if they exceed the size, the chunk is closed with it and the last characters of the
page are carried over to the next one. A page that would exceed `largest` opens a chunk of its own, without overlap.
`pack_pages` runs on lists, `pack_pages_column` is the same fold as a Catalyst expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.tags import DEFAULT, Tags
from textloom.functions.text import strip

GAP = 4  # what joining two pages is reckoned at (the join itself takes two)


def split_into_pages(text: str, pattern: str) -> list[tuple[int, str]]:
    """(number, page with its marker); pages that are only a marker are dropped, text before the first marker is page 0."""
    marks = list(re.finditer(pattern, text))
    out = []
    if marks and (lead := text[: marks[0].start()].strip()):
        out.append((0, lead))
    for m, following in zip(marks, [*marks[1:], None]):
        page = text[m.start() : following.start() if following else len(text)].strip()
        if page != m[0].strip():
            out.append((int(m[1]), page))
    return out


def split_into_pages_column(text: Column, kind: str = "page", tags: Tags = DEFAULT) -> Column:
    """array<struct<number, page>>: the same by a look-ahead split."""
    p = tags.numbered(kind)
    parts = F.filter(F.transform(F.split(text, f"(?={p})"), strip), lambda x: (x != "") & ~x.rlike(f"^{p}\\z"))
    return F.transform(parts, lambda x: F.struct(F.coalesce(F.regexp_extract(x, f"^{p}", 1).try_cast("int"), F.lit(0)).alias("number"), x.alias("page")))


def pack_pages(pages: list[str], size: int, overlap: int) -> list[str]:
    largest = int(size * 1.5)
    out, held, carried = [], "", ""
    for page in pages:
        if carried:
            page, carried = f"{carried}\n\n{page}", ""
        if not held:
            held = page
            continue
        reckoned = len(held) + GAP + len(page)
        if reckoned > largest:
            out.append(held)
            held = page
            continue
        held = f"{held}\n\n{page}"
        if reckoned > size:
            out.append(held)
            held, carried = "", page[-overlap:] if overlap > 0 else ""
    return [*out, held] if held else out


def pack_pages_column(pages: Column, size: int, overlap: int) -> Column:
    """array<string> of the chunks of an array<string> of pages."""
    largest = int(size * 1.5)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit("").alias("carried"))

    def step(acc: Column, raw: Column) -> Column:
        page = F.when(acc["carried"] == "", raw).otherwise(F.concat(acc["carried"], F.lit("\n\n"), raw))
        reckoned = F.length(acc["held"]) + GAP + F.length(page)
        joined = F.concat(acc["held"], F.lit("\n\n"), page)
        empty, tail = F.lit(""), F.right(page, F.lit(overlap)) if overlap > 0 else F.lit("")
        return (
            F.when(acc["held"] == "", F.struct(acc["out"].alias("out"), page.alias("held"), empty.alias("carried")))
            .when(reckoned > largest, F.struct(F.concat(acc["out"], F.array(acc["held"])).alias("out"), page.alias("held"), empty.alias("carried")))
            .when(reckoned > size, F.struct(F.concat(acc["out"], F.array(joined)).alias("out"), empty.alias("held"), tail.alias("carried")))
            .otherwise(F.struct(acc["out"].alias("out"), joined.alias("held"), empty.alias("carried")))
        )

    return F.aggregate(pages, start, step, lambda acc: F.when(acc["held"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"]))))


def only_marker(tags: Tags = DEFAULT) -> re.Pattern:
    from textloom.functions.tags import quoted

    ends = [(tags.page_prefix, tags.page_suffix), (tags.slide_prefix, tags.slide_suffix)]
    return re.compile("|".join(rf"{quoted(a)}\s*\d+(?:\s*\(OCR[+Ref]*\))?{quoted(b)}" for a, b in ends))


def clean_chunks(chunks: list[str], tags: Tags = DEFAULT) -> list[str]:
    """Without blank chunks and those that are a page or slide marker alone."""
    marker = only_marker(tags)
    return [c for c in chunks if c.strip() and not marker.fullmatch(c.strip())]


def clean_chunks_column(chunks: Column, tags: Tags = DEFAULT) -> Column:
    marker = only_marker(tags).pattern
    return F.filter(chunks, lambda c: (strip(c) != "") & ~strip(c).rlike(f"^(?:{marker})\\z"))
