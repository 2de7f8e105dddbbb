"""Protected regions: spans that no chunk boundary may cut, and the splitter that moves a cursor around them."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from textloom.functions.tags import DEFAULT, Tags
from textloom.operators.tables import HTML_TABLE, MARKDOWN_TABLE, chunk_html, chunk_markdown, is_markdown_table

NEAR = 5  # a cut this close behind a tag counts as ending with it
LOOK_BACK = 200  # how far before the limit a blank line is looked for


@dataclass(frozen=True)
class Region:
    start: int
    end: int
    kind: str


TABLES = {"html_table", "markdown_table"}
NO_OVERLAP = {"page_tag", "slide_tag", "sheet_tag", "chart", "metadata", "data_analysis"}


def _patterns(tags: Tags) -> list[tuple[str, re.Pattern]]:
    i, s = re.IGNORECASE, re.DOTALL
    return [
        ("chart", re.compile(tags.chart, s)),
        ("textbox", re.compile(r"\[textbox\].*?\[/textbox\]", s)),
        ("image_tag", re.compile(tags.image if tags != DEFAULT else r"\[(?i:image)\s*:\s*\{?[^\]\}]+\}?\]")),
        ("page_tag", re.compile(tags.page, i)),
        ("page_tag", re.compile(r"\[Page Number:\s*\d+\s*\(OCR(?:\+Ref)?\)\]", i)),
        ("slide_tag", re.compile(tags.slide, i)),
        ("slide_tag", re.compile(r"\[Slide Number:\s*\d+\s*\(OCR(?:\+Ref)?\)\]", i)),
        ("sheet_tag", re.compile(tags.numbered("sheet"), i)),
        ("metadata", re.compile(tags.metadata, s)),
        ("data_analysis", re.compile(r"\[(?:Data Analysis|데이터 분석)\].*?\[/(?:Data Analysis|데이터 분석)\]", s)),
    ]


_COMPILED: dict[Tags, list[tuple[str, re.Pattern]]] = {}


def find_regions(text: str, tables: bool = True, tags: Tags = DEFAULT) -> list[Region]:
    """Regions in order; overlapping ones become one whose kind joins theirs. tables: whether tables are protected."""
    if tags not in _COMPILED:
        _COMPILED[tags] = _patterns(tags)
    found = [Region(m.start(), m.end(), kind) for kind, p in _COMPILED[tags] for m in p.finditer(text)]
    if tables and "<" in text:
        found += [Region(m.start(), m.end(), "html_table") for m in HTML_TABLE.finditer(text)]
    if tables and "|" in text:
        found += [Region(m.start(1), m.end(1), "markdown_table") for m in MARKDOWN_TABLE.finditer(text)]
    return merge_regions(found)


def merge_regions(regions: list[Region]) -> list[Region]:
    out: list[Region] = []
    for r in sorted(regions, key=lambda r: r.start):
        if out and r.start < out[-1].end:
            out[-1] = Region(out[-1].start, max(out[-1].end, r.end), f"{out[-1].kind}+{r.kind}")
        else:
            out.append(r)
    return out


def merge_spans_column(spans):
    """The same merge of an array<struct<start, end, kind>> column, as a fold."""
    from pyspark.sql import functions as F

    def step(acc, r):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"), F.concat(last["kind"], F.lit("+"), r["kind"]).alias("kind"))
        return F.when((F.size(acc) > 0) & (r["start"] < F.element_at(F.when(F.size(acc) > 0, acc), -1)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int,kind:string>>"), step)


class CursorSplitter:
    """Splits one text. Blocks are kept whole (tables are parted by rows if `part_tables`), images are never cut into, and
    no overlap reaches into a block, an image or a tag. The cursor always advances, and no text is left out."""

    def __init__(self, text: str, regions: list[Region], size: int, overlap: int, part_tables: bool = False):
        self.text, self.size, self.overlap, self.part_tables = text, size, overlap, part_tables
        self.images = [r for r in regions if r.kind == "image_tag"]
        self.blocks = [r for r in regions if r.kind != "image_tag"]
        self.quiet = [r for r in regions if any(k in NO_OVERLAP for k in r.kind.split("+"))]
        self.block_ends = [r.end for r in self.blocks]
        self.image_starts = [r.start for r in self.images]
        self.quiet_ends = [r.end for r in self.quiet]

    def split(self) -> list[str]:
        out: list[str] = []
        at, given, n = 0, 0, len(self.text)  # given: how far the chunks so far reach
        while at < n:
            if n - at <= self.size:
                out.append(self.text[at:].strip())
                break
            i = bisect_right(self.block_ends, at)
            block = self.blocks[i] if i < len(self.blocks) and self.blocks[i].start < at + self.size else None
            pieces, following = self._free(at) if block is None else self._at_block(at, block, i, given)
            out += pieces
            given = max(given, self._reach)
            at = max(following, at + 1)
        return [c for c in out if c]

    def _settled(self, end: int) -> tuple[int, bool]:
        """(end moved behind an image that it would cut, whether what stands there forbids an overlap)"""
        i = bisect_right(self.image_starts, end) - 1
        if i >= 0 and self.images[i].start < end < self.images[i].end:
            return self.images[i].end, True
        if i >= 0 and self.images[i].end <= end <= self.images[i].end + NEAR:
            return end, True
        j = bisect_right(self.quiet_ends, end) - 1
        return end, j >= 0 and end <= self.quiet[j].end + NEAR

    def _free(self, at: int) -> tuple[list[str], int]:
        """No block ahead: the last blank line, else line, else space, else the limit."""
        limit, half = at + self.size, at + self.size // 2
        low = max(at, limit - LOOK_BACK)
        end = limit
        breaks = list(re.finditer(r"\n\s*\n", self.text[low:limit]))
        if breaks:
            end = low + breaks[-1].end()
        elif (line := self.text.rfind("\n", at, limit)) > half:
            end = line + 1
        elif (space := self.text.rfind(" ", at, limit)) > half:
            end = space + 1
        end, quiet = self._settled(end)
        self._reach = end
        following = end if quiet else end - self.overlap
        return [self.text[at:end].strip()], following if following > at else end

    def _whole(self, block: Region) -> list[str]:
        content = self.text[block.start : block.end].strip()
        if self.part_tables and block.end - block.start > self.size:
            if content.lower().startswith("<table"):
                return chunk_html(content, self.size)
            if is_markdown_table(content):
                return chunk_markdown(content, self.size)
        return [content]

    def _at_block(self, at: int, block: Region, i: int, given: int) -> tuple[list[str], int]:
        is_table = bool(TABLES & set(block.kind.split("+")))
        if block.end - min(at, block.start) <= self.size or (block.start <= at and block.end - block.start <= self.size):
            start = at if block.start > at else block.start
            end = min(block.end + self.size - (block.end - start), len(self.text))
            if i + 1 < len(self.blocks):  # a block that begins right behind this one stops it too
                end = min(end, max(self.blocks[i + 1].start, block.end))
            end, quiet = self._settled(end)
            self._reach = end
            ends_with_table = end == block.end or is_table
            return [self.text[at:end].strip()], end if quiet or ends_with_table else max(block.end, end - self.overlap)
        before = block.start - at
        if before > self.overlap:
            end, quiet = self._settled(block.start)
            self._reach = end
            return [self.text[at:end].strip()], end if quiet else max(at + 1, block.start - self.overlap)
        lead = self.text[at : block.start].strip() if block.start > given else ""  # short text before a block is kept, unless it is the last chunk's overlap
        self._reach = block.end
        return [*([lead] if lead else []), *self._whole(block)], block.end


def split_around_regions(text: str, size: int, overlap: int, part_tables: bool = False, tags: Tags = DEFAULT, regions: list[Region] | None = None) -> list[str]:
    found = find_regions(text, not part_tables, tags) if regions is None else regions
    if part_tables and regions is None:
        found = merge_regions(found + [Region(m.start(), m.end(), "html_table") for m in HTML_TABLE.finditer(text)] + [Region(m.start(1), m.end(1), "markdown_table") for m in MARKDOWN_TABLE.finditer(text)])
    return CursorSplitter(text, found, size, overlap, part_tables).split()
