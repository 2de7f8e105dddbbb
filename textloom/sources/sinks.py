"""Sinks: Markdown files of chunks, and image files. Both write from the executors and never overwrite."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_documents(chunks: DataFrame, source: str = "doc_id", separator: str = "---") -> DataFrame:
    """(source, markdown): front matter, then each chunk under `## Chunk i/n`. One row a document."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    docs = chunks.groupBy(source).agg(ordered.alias("__c"))
    n = F.size("__c")
    front = F.concat(F.lit("---\ntotal_chunks: "), n.cast("string"), F.lit("\nsource_file: "), F.col(source).cast("string"), F.lit("\n---\n\n"))
    body = F.transform("__c", lambda c, i: F.concat(F.lit("## Chunk "), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit("\n\n"), F.regexp_replace(c, "[\\x{D800}-\\x{DFFF}]", "?")))
    return docs.select(source, F.concat(front, F.array_join(body, f"\n\n{separator}\n\n"), F.lit("\n")).alias("markdown"))


def save_markdown(chunks: DataFrame, path: str, source: str = "doc_id") -> None:
    """One text file a document below `path`, by partition directory, through Spark's committer."""
    markdown_documents(chunks, source).select(F.col(source).alias("source"), "markdown").write.partitionBy("source").option("lineSep", "\0").text(path)


def free_name(path: str) -> str:
    """path, or path_1, path_2, ... if it exists."""
    base, ext = os.path.splitext(path)
    n, out = 0, path
    while os.path.exists(out):
        n += 1
        out = f"{base}_{n}{ext}"
    return out


def save_images(images: DataFrame, folder: str, data: str = "content") -> DataFrame:
    """Writes each distinct image once below a folder that all executors share, under a name made of its hash, and
    returns (image_hash, file_name, tag). A file that is there already is the same image and is left alone."""
    from textloom.functions.blocks import distinct_images

    named = distinct_images(images, data)

    def write(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            target = os.path.join(folder, r["file_name"])
            if not os.path.exists(target):
                with open(target + ".part", "wb") as f:
                    f.write(bytes(r[data]))
                os.replace(target + ".part", target)

    named.select("file_name", data).foreachPartition(write)
    return named.select("image_hash", "file_name", "tag")
