"""The document processor: files to text to chunks, and its registration for SQL."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.tags import DEFAULT, Tags
from textloom.functions.text import CATEGORIES, supported_extensions
from textloom.operators.chunking import chunk_document, chunk_documents, with_positions
from textloom.operators.ocr import Engine, replace_here, replace_tags
from textloom.sources import readers
from textloom.sources.sinks import free_name


@dataclass
class Chunks:
    """Chunks of one document."""

    chunks: list[str]
    positions: list[dict] | None = None
    source: str | None = None

    def __len__(self) -> int:
        return len(self.chunks)

    def __iter__(self) -> Iterator[str]:
        return iter(self.chunks)

    def __getitem__(self, i: int) -> str:
        return self.chunks[i]

    @property
    def has_positions(self) -> bool:
        return self.positions is not None

    def save_markdown(self, folder: str, name: str = "chunks.md", separator: str = "---", with_front_matter: bool = True) -> str:
        """Writes a Markdown file that does not exist yet, and returns its path."""
        os.makedirs(folder, exist_ok=True)
        path = free_name(os.path.join(folder, name))
        n = len(self.chunks)
        front = f"---\ntotal_chunks: {n}\nsource_file: {self.source or ''}\n---\n\n" if with_front_matter else ""
        body = f"\n\n{separator}\n\n".join(f"## Chunk {i + 1}/{n}\n\n{c}" for i, c in enumerate(self.chunks))
        with open(path, "w", encoding="utf-8", errors="replace") as f:
            f.write(front + body + "\n")
        return path


def _load(path: str, folder: str) -> bytes | None:
    """An image by its path, or beside the file whose tag names it."""
    for candidate in (path, os.path.join(folder, path)):
        if os.path.isfile(candidate):
            with open(candidate, "rb") as f:
                return f.read()
    return None


@dataclass
class DocumentProcessor:
    """Settings in one place; every method on DataFrames is lazy, every method on single files runs here."""

    tags: Tags = DEFAULT
    language: str = "ko"
    engine: Engine | None = None
    extra_readers: dict[str, readers.Reader] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.extra_readers = {ext.lower().lstrip("."): reader for ext, reader in self.extra_readers.items()}

    @property
    def supported_extensions(self) -> list[str]:
        return sorted({*supported_extensions(), *self.extra_readers})

    def is_supported(self, extension: str) -> bool:
        return extension.lower().lstrip(".") in set(self.supported_extensions)

    def file_category(self, extension: str) -> str:
        ext = extension.lower().lstrip(".")
        return next((c for c, exts in CATEGORIES.items() if ext in exts.split()), "unknown")

    def extract_text(self, path: str, extension: str | None = None, with_metadata: bool = True, ocr: bool = False, progress: Callable[[int, int, str], None] | None = None) -> str:
        """Text of one file, with `ocr` and an engine the images that its tags name read into it; an image file is read itself.
        Raises FileNotFoundError, or ValueError for an unsupported extension."""
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        ext = (extension or os.path.splitext(path)[1]).lower().lstrip(".")
        if not self.is_supported(ext):
            raise ValueError(f"Unsupported file extension: {ext}")
        with open(path, "rb") as f:
            text, metadata = readers.read_file(f.read(), ext, os.path.basename(path), self.extra_readers)
        if ocr and self.engine is not None:
            text = replace_here(text, self.engine, lambda p: _load(p, os.path.dirname(os.path.abspath(path))), self.tags, progress)
        block = readers.render_metadata(metadata, self.language) if with_metadata else ""
        return f"{block}\n\n{text}" if block else text

    def chunk_text(self, text: str, size: int = 1000, overlap: int = 200, extension: str | None = None, preserve_tables: bool = True, positions: bool = False) -> list:
        """Blank text gives one empty chunk, with positions or without."""
        chunks = chunk_document(text, extension, size, overlap, preserve_tables, self.tags)
        return with_positions(chunks, (extension or "").lower().lstrip("."), overlap, self.tags) if positions and chunks != [""] else chunks

    def extract_chunks(self, path: str, extension: str | None = None, size: int = 1000, overlap: int = 200, preserve_tables: bool = True, positions: bool = False, ocr: bool = False) -> Chunks:
        ext = extension or os.path.splitext(path)[1]
        chunks = self.chunk_text(self.extract_text(path, extension, ocr=ocr), size, overlap, ext, preserve_tables)
        placed = with_positions(chunks, ext.lower().lstrip("."), overlap, self.tags) if positions else None
        return Chunks(chunks, placed, path)

    def read(self, spark: SparkSession, path: str, pattern: str | None = None, ocr: bool = False) -> DataFrame:
        """(path, ext, category, text, metadata, error) of all files below a path. With `ocr` and an engine, tags that name an
        image file below the path are replaced by what the engine reads, in image files too; tags name files without folders."""
        documents = readers.read_documents(readers.scan(spark, path, pattern), language=self.language, extra=self.extra_readers)
        if not ocr or self.engine is None:
            return documents
        images = readers.scan(spark, path).filter(F.col("category") == "image").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content").dropDuplicates(["path"])
        return self.replace_images(documents, images)

    def replace_images(self, documents: DataFrame, images: DataFrame, key: str = "path") -> DataFrame:
        return documents if self.engine is None else replace_tags(documents, images, self.engine, key, tags=self.tags)

    def chunk(self, documents: DataFrame, key: str = "path", text: str = "text", extension: str | None = "ext", size: int = 1000, overlap: int = 200, preserve_tables: bool = True, positions: bool = False) -> DataFrame:
        return chunk_documents(documents, key, text, extension, size, overlap, preserve_tables, positions, self.tags)


def register_sql(spark: SparkSession) -> None:
    """chunk_text(text, size, overlap) as a table function, and chunk_array(text, size, overlap), for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, text string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            for i, c in enumerate(chunk_document(text or "", None, size, overlap)):
                yield i, c

    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("chunk_array", F.udf(lambda t, s, o: chunk_document(t or "", None, s, o), "array<string>", useArrow=True))
