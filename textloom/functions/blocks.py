"""Metadata and chart blocks, and images: structure rendered to text by Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.tags import DEFAULT, Tags
from textloom.functions.text import escape_html

# fixed values: standard fields in their order, with the labels of each language
METADATA_LABELS = {
    "ko": {"title": "제목", "subject": "주제", "author": "작성자", "keywords": "키워드", "comments": "설명", "last_saved_by": "마지막 저장자", "create_time": "작성일", "last_saved_time": "수정일"},
    "en": {"title": "Title", "subject": "Subject", "author": "Author", "keywords": "Keywords", "comments": "Comments", "last_saved_by": "Last Saved By", "create_time": "Created", "last_saved_time": "Last Modified"},
}
# fixed values: labels of further fields that readers add
MORE_LABELS = {
    "ko": {"version": "버전", "category": "범주", "company": "회사", "manager": "관리자", "file_name": "파일명", "file_size": "파일 크기", "encoding": "인코딩", "row_count": "행 수", "col_count": "열 수"},
    "en": {"version": "Version", "category": "Category", "company": "Company", "manager": "Manager", "file_name": "File Name", "file_size": "File Size", "encoding": "Encoding", "row_count": "Row Count", "col_count": "Column Count"},
}
TIMES = ("create_time", "last_saved_time")


def field_label(key: Column, language: str = "ko") -> Column:
    """The label of a standard field, else the key in title case."""
    pairs = METADATA_LABELS[language] | MORE_LABELS[language]
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)
    return F.coalesce(known, F.initcap(F.replace(key, F.lit("_"), F.lit(" "))))


def metadata_block(fields: dict[str, Column], custom: Column | None = None, language: str = "en", tags: Tags = DEFAULT) -> Column:
    """Block of the fields that have a value, in the standard order, then the custom ones (array<struct<k, v>>) in
    theirs; empty if there are none."""
    lines = []
    for key, label in METADATA_LABELS[language].items():
        if key in fields:
            value = F.date_format(fields[key], "yyyy-MM-dd HH:mm:ss") if key in TIMES else fields[key].cast("string")
            lines.append(F.when(value != "", F.concat(F.lit(f"  {label}: "), value)))
    body = F.array_compact(F.array(*lines)) if lines else F.array().cast("array<string>")
    if custom is not None:
        more = F.transform(F.filter(custom, lambda x: x["v"].isNotNull()), lambda x: F.concat(F.lit("  "), field_label(x["k"], language), F.lit(": "), x["v"]))
        body = F.concat(body, F.coalesce(more, F.array().cast("array<string>")))
    return F.when(F.size(body) == 0, F.lit("")).otherwise(F.concat(F.lit(tags.metadata_prefix + "\n"), F.array_join(body, "\n"), F.lit("\n" + tags.metadata_suffix)))


# fixed values: names of chart types in Office files
CHART_TYPES = {
    "barChart": "Bar Chart", "bar3DChart": "3D Bar Chart", "lineChart": "Line Chart", "line3DChart": "3D Line Chart", "pieChart": "Pie Chart", "pie3DChart": "3D Pie Chart", "doughnutChart": "Doughnut Chart",
    "areaChart": "Area Chart", "area3DChart": "3D Area Chart", "scatterChart": "Scatter Chart", "bubbleChart": "Bubble Chart", "radarChart": "Radar Chart", "surfaceChart": "Surface Chart", "surface3DChart": "3D Surface Chart",
    "stockChart": "Stock Chart", "ofPieChart": "Pie of Pie Chart", "colChart": "Column Chart", "col3DChart": "3D Column Chart",
}


def chart_type_name(kind: Column) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in CHART_TYPES.items() for x in kv]), kind)
    return F.coalesce(known, F.nullif(kind, F.lit("")), F.lit("Chart"))


def _grid(categories: Column, series: Column, cell) -> Column:
    """Rows of a chart's table: the category, or `Item i` beyond the last, then each series' value or nothing."""
    longest = F.greatest(F.size(categories), F.coalesce(F.array_max(F.transform(series, lambda s: F.size(s["values"]))), F.lit(0)))

    def row(i: Column) -> Column:
        category = F.coalesce(cell(F.get(categories, i)), F.concat(F.lit("Item "), (i + 1).cast("string")))
        values = F.transform(series, lambda s: F.coalesce(F.format_number(F.get(s["values"], i), 2), F.lit("")))
        return F.concat(F.array(category), values)

    return F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), row)).otherwise(F.array().cast("array<array<string>>"))


def _names(series: Column) -> Column:
    return F.transform(series, lambda s, i: F.coalesce(F.nullif(s["name"], F.lit("")), F.concat(F.lit("Series "), (i + 1).cast("string"))))


def chart_html(categories: Column, series: Column) -> Column:
    """series: array<struct<name, values array<double>>>"""
    head = F.concat(F.lit("<tr><th>Category</th>"), F.array_join(F.transform(_names(series), lambda n: F.concat(F.lit("<th>"), escape_html(n), F.lit("</th>"))), ""), F.lit("</tr>"))
    rows = F.transform(_grid(categories, series, escape_html), lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>")))
    return F.array_join(F.concat(F.array(F.lit("<table border='1'>"), head), rows, F.array(F.lit("</table>"))), "\n")


def chart_markdown(categories: Column, series: Column) -> Column:
    head = F.concat(F.array(F.lit("Category")), _names(series))
    rule = F.transform(head, lambda _: F.lit("---"))
    rows = F.concat(F.array(head, rule), _grid(categories, series, lambda c: c))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")


def chart_block(kind: Column, title: Column, categories: Column, series: Column, raw: Column | None = None, tags: Tags = DEFAULT) -> Column:
    """Prefix, type, title, a blank line and the table (or raw content), suffix."""
    full = F.exists(series, lambda s: F.size(s["values"]) > 0)
    table = F.when(F.coalesce(full, F.lit(False)), chart_html(categories, series))
    body = table if raw is None else F.coalesce(table, raw)
    parts = F.array(
        F.lit(tags.chart_prefix), F.when(kind != "", F.concat(F.lit("Chart Type: "), kind)), F.when(title != "", F.concat(F.lit("Title: "), title)), F.when(body.isNotNull(), F.concat(F.lit("\n"), body)), F.lit(tags.chart_suffix)
    )
    return F.array_join(F.array_compact(parts), "\n")


def chart_fallback(kind: Column, title: Column, message: Column | None = None, tags: Tags = DEFAULT) -> Column:
    said = F.coalesce(message, F.lit("(Chart content could not be extracted)")) if message is not None else F.lit("(Chart content could not be extracted)")
    parts = F.array(F.lit(tags.chart_prefix), F.when(kind != "", F.concat(F.lit("Chart Type: "), kind)), F.when(title != "", F.concat(F.lit("Title: "), title)), said, F.lit(tags.chart_suffix))
    return F.array_join(F.array_compact(parts), "\n")


# fixed values: first bytes of image formats, as hex
IMAGE_MAGIC = [("png", "89504E470D0A1A0A"), ("jpeg", "FFD8"), ("gif", "474946383761"), ("gif", "474946383961"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A")]


def image_format(data: Column) -> Column:
    """Format by the first bytes; unknown below twelve bytes."""
    head = F.hex(F.substring(data, 1, 12))
    out = F.when(F.octet_length(data) < 12, F.lit("unknown"))
    for name, magic in IMAGE_MAGIC:
        out = out.when(head.startswith(magic), F.lit(name))
    return out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp")).otherwise(F.lit("unknown"))


def image_hash(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 32)


def distinct_images(images: DataFrame, data: str = "content", tags: Tags = DEFAULT) -> DataFrame:
    """Each different image once, with hash, format, file name and tag; empty ones are left out."""
    marked = images.filter(F.octet_length(F.col(data)) > 0).withColumns({"image_hash": image_hash(F.col(data)), "format": image_format(F.col(data))})
    name = F.concat(F.lit("image_"), F.substring("image_hash", 1, 16), F.lit("."), F.when(F.col("format") == "unknown", F.lit("png")).otherwise(F.col("format")))
    return marked.dropDuplicates(["image_hash"]).withColumn("file_name", name).withColumn("tag", F.concat(F.lit(tags.image_prefix), F.col("file_name"), F.lit(tags.image_suffix)))
