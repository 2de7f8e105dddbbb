"""Arriving files as a stream: the readers and the chunker are stateless per file, so the batch plan runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.checkpoints import checkpointed
from textloom.functions.text import extension, file_category
from textloom.operators.chunking import chunk_documents
from textloom.sources.readers import read_documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("ext", extension(F.col("path"))).withColumn("category", file_category(F.col("ext")))


def chunk_arrivals(spark: SparkSession, path: str, out: str, checkpoint: str, size: int = 1000, overlap: int = 200):
    """Chunks of the files that arrive below `path`, written to Parquet batch by batch; started with available files. The files
    that no reader could parse are written beside them, path and error, to `{out}_rejects`."""

    def batch(files: DataFrame, batch_id: int) -> None:
        docs = checkpointed(read_documents(files))
        chunks = chunk_documents(docs.filter(F.col("error").isNull()), key="path", extension="ext", size=size, overlap=overlap)
        chunks.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a repeated batch replaces itself
        rejects = docs.filter(F.col("error").isNotNull()).select("path", "error")
        rejects.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}_rejects/batch={batch_id}")

    return arriving_files(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
