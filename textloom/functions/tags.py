"""In-band tags: pages, slides, sheets, images, charts, metadata. Settings are plain values on the driver; patterns become
literals of Catalyst expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.lets import let


def quoted(text: str) -> str:
    """A literal as a pattern that Java, RE2 and Python read alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


@dataclass(frozen=True)
class Tags:
    """Prefixes and suffixes of the tags; the defaults are fixed values of the wire format."""

    page_prefix: str = "[Page Number: "
    page_suffix: str = "]"
    slide_prefix: str = "[Slide Number: "
    slide_suffix: str = "]"
    sheet_prefix: str = "[Sheet: "
    sheet_suffix: str = "]"
    image_prefix: str = "[Image:"
    image_suffix: str = "]"
    chart_prefix: str = "[chart]"
    chart_suffix: str = "[/chart]"
    metadata_prefix: str = "<Document-Metadata>"
    metadata_suffix: str = "</Document-Metadata>"

    def numbered(self, kind: str) -> str:
        """Pattern of a numbered tag, the number captured. Sheets are matched by number too, so named ones are not."""
        return quoted(getattr(self, kind + "_prefix")) + "([0-9]+)" + quoted(getattr(self, kind + "_suffix"))

    @property
    def page(self) -> str:
        return self.numbered("page")

    @property
    def slide(self) -> str:
        return self.numbered("slide")

    @property
    def sheet(self) -> str:
        return quoted(self.sheet_prefix.rstrip()) + r"\s*[^\]]+" + quoted(self.sheet_suffix)

    @property
    def image(self) -> str:
        last = quoted(self.image_suffix[:1]) if self.image_suffix else r"\s"
        return quoted(self.image_prefix) + f"([^{last}]+)" + quoted(self.image_suffix)

    @property
    def chart(self) -> str:
        return quoted(self.chart_prefix) + ".*?" + quoted(self.chart_suffix)

    @property
    def metadata(self) -> str:
        return quoted(self.metadata_prefix) + ".*?" + quoted(self.metadata_suffix)


DEFAULT = Tags()


def make_tag(number: Column, kind: str = "page", tags: Tags = DEFAULT) -> Column:
    return F.concat(F.lit(getattr(tags, kind + "_prefix")), number.cast("string"), F.lit(getattr(tags, kind + "_suffix")))


def find_numbers(text: Column, kind: str = "page", tags: Tags = DEFAULT) -> Column:
    """array<int> of the numbers of the tags, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)" + tags.numbered(kind)), 1), lambda x: x.cast("int"))


def find_spans(text: Column, kind: str = "page", tags: Tags = DEFAULT) -> Column:
    """array<struct<number, start, end>>, 0-based and half-open: offsets are running lengths of the pieces between."""
    p = "(?i)" + tags.numbered(kind)
    start = F.struct(F.array().cast("array<struct<number:int,start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        first = acc["at"] + F.length(s["gap"])
        last = first + F.length(s["tag"])
        return F.struct(F.array_append(acc["out"], F.struct(s["number"].alias("number"), first.alias("start"), last.alias("end"))).alias("out"), last.alias("at"))

    pieces = F.arrays_zip(F.split(text, p).alias("gap"), F.regexp_extract_all(text, F.lit(p), 0).alias("tag"), find_numbers(text, kind, tags).alias("number"))
    return let(pieces, lambda z: F.aggregate(F.filter(z, lambda s: s["tag"].isNotNull()), start, step, lambda acc: acc["out"]))


def has_markers(text: Column, kind: str = "page", tags: Tags = DEFAULT) -> Column:
    return F.coalesce(text.rlike("(?i)" + tags.numbered(kind)), F.lit(False))


def remove_markers(text: Column, tags: Tags = DEFAULT) -> Column:
    """Without page and slide tags."""
    return F.regexp_replace(F.regexp_replace(text, "(?i)" + tags.page, ""), "(?i)" + tags.slide, "")


def has_charts(text: Column, tags: Tags = DEFAULT) -> Column:
    return F.coalesce(text.rlike("(?is)" + tags.chart), F.lit(False))


def find_charts(text: Column, tags: Tags = DEFAULT) -> Column:
    return F.regexp_extract_all(text, F.lit("(?is)" + tags.chart), 0)


def remove_charts(text: Column, tags: Tags = DEFAULT) -> Column:
    return F.regexp_replace(text, "(?is)" + tags.chart, "")


def image_paths(text: Column, tags: Tags = DEFAULT) -> Column:
    return F.regexp_extract_all(text, F.lit(tags.image), 1)


def first_metadata(text: Column, tags: Tags = DEFAULT) -> Column:
    """struct<block, rest>: the first metadata block, and the text without it, stripped."""
    from textloom.functions.text import strip

    p = "(?s)" + tags.metadata
    block = F.regexp_extract(text, p, 0)
    at = F.call_function("locate", block, text)
    rest = strip(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(block), F.length(text))))
    return F.struct(block.alias("block"), F.when(block == "", text).otherwise(rest).alias("rest"))


def unbalanced(text: Column, tags: Tags = DEFAULT) -> Column:
    """How many blocks are opened and not closed, or the reverse: a data quality measure."""

    def count(tag: str) -> Column:
        return F.regexp_count(text, F.lit("(?i)" + quoted(tag)))

    return F.abs(F.regexp_count(text, F.lit("(?i)<table[^>]*>")) - count("</table>")) + F.abs(count(tags.chart_prefix) - count(tags.chart_suffix)) + F.abs(count("[textbox]") - count("[/textbox]"))
