"""Files to documents: one reader per format behind one Arrow UDF over a `binaryFile` scan.

Files that are plain valid UTF-8 text are decoded in the JVM; only the others reach Python. A file that cannot be read
keeps its row, with the reason in `error`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.blocks import METADATA_LABELS, MORE_LABELS
from textloom.functions.text import CATEGORIES, clean_code_text, clean_text, extension, file_category, is_supported
from textloom.sources import html, ole, ooxml, pdf, rtf, text_files, xls

Reader = Callable[[bytes, str], tuple[str, dict[str, str]]]


def sniff_doc(data: bytes) -> str:
    """What a .doc file really is. HTML shows in its first kilobyte, as the format's own sniffers have it."""
    if data.startswith(b"{\\rtf") or data.lstrip(b"\xef\xbb\xbf\xff\xfe").startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith(ole.MAGIC):
        return "ole"
    if data.startswith(b"PK\x03\x04"):
        return "docx"
    head = data[:1024].lstrip().lower()
    return "html" if head.startswith((b"<!doctype", b"<html")) or b"<html" in head else "ole"


def read_doc(data: bytes, ext: str) -> tuple[str, dict[str, str]]:
    kind = sniff_doc(data)
    if kind == "rtf":
        return rtf.read_rtf(data)
    if kind == "docx":
        return ooxml.read_docx(data)
    if kind == "html":
        return html.read_html_document(text_files.decode(data)[0]), {}
    return ole.doc_text(data), ole.summary(ole.CompoundFile(data).read("\x05SummaryInformation") or b"")


READERS: dict[str, Reader] = {
    "docx": lambda d, e: ooxml.read_docx(d) if d.startswith(b"PK") else read_doc(d, e),
    "xlsx": lambda d, e: ooxml.read_xlsx(d),
    "xls": lambda d, e: xls.read_xls(d),
    "pptx": lambda d, e: ooxml.read_pptx(d),
    "hwpx": lambda d, e: ooxml.read_hwpx(d),
    "rtf": lambda d, e: rtf.read_rtf(d),
    "doc": read_doc,
    "hwp": lambda d, e: ole.read_hwp(d),
    "pdf": lambda d, e: pdf.read_pdf(d),
    "csv": lambda d, e: text_files.read_csv(d, e),
    "tsv": lambda d, e: text_files.read_csv(d, e),
}
TEXT_LIKE = {e for c in ("text", "code", "config", "script", "log", "web") for e in CATEGORIES[c].split()}
IMAGES = set(CATEGORIES["image"].split())


def register(ext: str, reader: Reader) -> None:
    """Add or replace the reader of an extension."""
    READERS[ext.lower().lstrip(".")] = reader


def read_file(data: bytes, ext: str, name: str = "", extra: dict[str, Reader] | None = None) -> tuple[str, dict[str, str]]:
    """(text, metadata) of one file. `extra` readers come before those that are registered for all."""
    if extra and ext in extra:
        return extra[ext](data, ext)
    if ext in READERS:
        return READERS[ext](data, ext)
    if ext in IMAGES:
        return f"[Image:{name}]", {}
    if ext in TEXT_LIKE:
        return text_files.read_text(data, ext), {}
    raise ValueError(f"Unsupported file extension: {ext}")


def render_metadata(metadata: dict[str, str], language: str = "ko") -> str:
    labels = METADATA_LABELS[language] | MORE_LABELS[language]
    keys = [k for k in METADATA_LABELS[language] if metadata.get(k)] + [k for k in metadata if k not in METADATA_LABELS[language] and metadata[k]]
    lines = [f"  {labels.get(k, k.replace('_', ' ').title())}: {metadata[k]}" for k in keys]
    return "\n".join(["<Document-Metadata>", *lines, "</Document-Metadata>"]) if lines else ""


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])


def extracted(content: Column, ext: Column, name: Column, extra: dict[str, Reader] | None = None) -> Column:
    """struct<text, metadata, error>"""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, exts, names in batches:
            rows = []
            for data, e, n in zip(contents, exts, names):
                if data is None:
                    rows.append((None, None, None))
                    continue
                try:
                    text, meta = read_file(bytes(data), e, n, extra)
                    rows.append((text, {k: str(v) for k, v in meta.items()}, None))
                except Exception as error:  # a broken file must not end the job
                    rows.append((None, None, f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(rows, columns=["text", "metadata", "error"])

    return run(content, ext, name)


def scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, ext, category, length, content) of the files below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.withColumn("ext", extension(F.col("path"))).withColumn("category", file_category(F.col("ext")))


def read_documents(files: DataFrame, with_metadata: bool = True, language: str = "ko", extra: dict[str, Reader] | None = None) -> DataFrame:
    """(path, ext, category, text, metadata, error) of each file."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    own = F.col("ext").isin(sorted(extra or ()))
    supported = is_supported(F.col("ext")) | own
    plain = ~own & F.col("ext").isin(sorted(TEXT_LIKE)) & F.is_valid_utf8(F.col("content").cast("string"))
    raw = F.col("content").cast("string")
    direct = F.when(plain, F.when(F.col("ext").isin(sorted(text_files.CODE)), clean_code_text(raw)).otherwise(clean_text(raw)))
    parsed = extracted(F.when(~plain & supported, F.col("content")), F.col("ext"), name, extra)  # only these bytes go to Python; each file is scanned once
    refused = F.when(~supported, F.concat(F.lit("Unsupported file extension: "), F.col("ext")))
    read = files.select("path", "ext", "category", direct.alias("__direct"), refused.alias("__refused"), parsed.alias("r"))
    out = read.select("path", "ext", "category", F.coalesce("__direct", "r.text").alias("text"), "r.metadata", F.coalesce("__refused", "r.error").alias("error"))
    if not with_metadata:
        return out

    @F.pandas_udf(T.StringType())
    def block(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for maps in batches:
            yield pd.Series([render_metadata(dict(m), language) if m is not None else "" for m in maps], dtype=object)

    rendered = F.when(F.col("metadata").isNotNull(), block("metadata")).otherwise(F.lit(""))
    return out.withColumn("__b", rendered).withColumn("text", F.when(F.col("__b") != "", F.concat("__b", F.lit("\n\n"), "text")).otherwise(F.col("text"))).drop("__b")
