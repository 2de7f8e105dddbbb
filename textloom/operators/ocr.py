"""Replacing image tags by text of an external model: distinct images are read once, then joined back.

The engine is a function from image bytes to text; no vendor code is part of this package. Replacement is literal, and an
image that cannot be read keeps its tag."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions.tags import DEFAULT, Tags, image_paths

Engine = Callable[[bytes], str]
SALTS = 16


def replace_here(text: str, engine: Engine, load: Callable[[str], bytes | None], tags: Tags = DEFAULT, progress: Callable[[int, int, str], None] | None = None) -> str:
    """One text, on this machine: each distinct image is loaded and read once; what cannot be keeps its tag. `progress` is told how
    many are done, of how many, and which."""
    pattern = re.compile(tags.image)
    paths = list(dict.fromkeys(m[1] for m in pattern.finditer(text)))
    figures: dict[str, str] = {}
    for i, path in enumerate(paths):
        try:
            if data := load(path):
                figures[path] = f"[Figure:{engine(data)}]"
        except Exception:  # the tag stays
            pass
        if progress is not None:
            progress(i + 1, len(paths), path)
    return pattern.sub(lambda m: figures.get(m[1], m[0]), text)


def read_images(images: DataFrame, engine: Engine, path: str = "path", content: str = "content") -> DataFrame:
    """(path, figure, error): `[Figure:text]` of each image with bytes; where the engine fails, figure is null and error says why."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p, data in zip(frame["path"], frame["content"]):
                try:
                    out.append((p, f"[Figure:{engine(bytes(data))}]", None))
                except Exception as error:  # the tag stays
                    out.append((p, None, f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(out, columns=["path", "figure", "error"])

    usable = images.filter(F.octet_length(F.col(content)) > 0).select(F.col(path).alias("path"), F.col(content).alias("content"))
    return usable.mapInPandas(run, "path string, figure string, error string")


def replace_tags(documents: DataFrame, images: DataFrame, engine: Engine, key: str = "doc_id", text: str = "text", tags: Tags = DEFAULT, failures: Observation | None = None) -> DataFrame:
    """The documents with their image tags replaced. The model sees each path that occurs anywhere once; how many it read and
    failed on is counted in `failures`, if given. Documents without tags pass by and are not moved; an image that a third
    of all documents show is joined in `SALTS` parts."""
    tagged = documents.filter(F.col(text).rlike(tags.image))
    wanted = tagged.select(F.col(key).alias("__key"), F.explode(F.array_distinct(image_paths(F.col(text), tags))).alias("path"))
    todo = images.join(wanted.select("path").distinct(), "path", "left_semi")
    seen = read_images(todo, engine)
    if failures is not None:
        seen = seen.observe(failures, F.count("*").alias("images"), F.count("error").alias("failed"))
    figures = seen.filter(F.col("figure").isNotNull()).select("path", "figure", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = wanted.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
    mine = salted.join(figures, ["path", "__salt"]).groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("path", "figure"))).alias("__figures"))
    joined = tagged.join(mine, F.col(key) == F.col("__key"), "left").drop("__key")
    gaps, paths = F.split(F.col(text), tags.image), image_paths(F.col(text), tags)

    def piece(z):
        kept = F.concat(F.lit(tags.image_prefix), z["path"], F.lit(tags.image_suffix))
        return F.concat(z["gap"], F.when(z["path"].isNull(), F.lit("")).otherwise(F.coalesce(F.try_element_at(F.col("__figures"), z["path"]), kept)))

    pieces = F.transform(F.arrays_zip(gaps.alias("gap"), paths.alias("path")), piece)
    replaced = joined.withColumn(text, F.when(F.col("__figures").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))).drop("__figures")
    return replaced.unionByName(documents.filter(~F.coalesce(F.col(text).rlike(tags.image), F.lit(False))))



