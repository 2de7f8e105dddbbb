"""Queries of the text problems, each over its whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.once import once
from textloom.llm import encodings, lookalikes, markup, packing, residue, splitting, tokenizer, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(*[table(spark, sf_dir, t) for t in ("rtf_converted_data", "chunks", "chunk_profiles")])


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(*[table(spark, sf_dir, t) for t in ("rtf_converted_data", "chunks", "chunk_profiles")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.affected(table(spark, sf_dir, "rtf_source_info"), table(spark, sf_dir, "csv_source_info"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its text restored as far as possible, and the mark of the affected ones; one row a key."""
    rtf = once(table(spark, sf_dir, "rtf_source_info").select("source_id", "file_path", "content"), ["source_id"])
    return encodings.repaired(rtf, once(table(spark, sf_dir, "csv_source_info").select("csv_id", "file_path", "parsed_rows"), ["csv_id"]))


def _looking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(table(spark, sf_dir, "cell_info"), table(spark, sf_dir, "docx_elements"))


def _items(cells: DataFrame, elements: DataFrame) -> DataFrame:
    a = cells.select(F.lit("cell_info").alias("item_table"), F.col("cell_id").alias("item_id"), "text")
    return a.unionByName(elements.select(F.lit("docx_elements").alias("item_table"), F.col("element_id").alias("item_id"), F.col("content").alias("text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.matches(_looking(spark, sf_dir), table(spark, sf_dir, "term_list"), keys=["item_table", "item_id"])


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in its one consistent form, one row a key."""
    cells, elements = (once(table(spark, sf_dir, t).select(k, v), [k]) for t, k, v in (("cell_info", "cell_id", "text"), ("docx_elements", "element_id", "content")))
    items = _items(cells, elements).filter(F.col("text").isNotNull())
    return items.select("item_table", "item_id", lookalikes.consistent_form(F.col("text")).alias("form"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.with_markup(table(spark, sf_dir, "rtf_converted_data"), table(spark, sf_dir, "docx_elements"))


def p6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrappers of each host, with the number of distinct streams that each stands for."""
    streams = wrappers.with_streams(markup.items(table(spark, sf_dir, "rtf_converted_data"), table(spark, sf_dir, "docx_elements")))
    return wrappers.infer_wrappers(streams).groupBy("host", "wrapper", "is_markup").agg(F.count("*").alias("streams"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_items(table(spark, sf_dir, "rtf_converted_data"), table(spark, sf_dir, "docx_elements"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, sf_dir, "documents"))


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its pieces where it exceeds the capacity, for each pack."""
    return packing.pack_items(tokenizer.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.judged(table(spark, sf_dir, "documents")).filter("residue").select("doc_id").distinct()


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain."""
    documents = table(spark, sf_dir, "documents")
    return residue.judged(documents).filter(~F.col("residue")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_forms": p4_forms, "p6_found": p6_found, "p6_wrappers": p6_wrappers, "p6_clean": p6_clean, "p7_ids": p7_ids, "p8_bins": p8_bins, "p9_found": p9_found, "p9_kept": p9_kept}

SQL = {
    "p1_found": """
        WITH r AS (SELECT DISTINCT convert_id, coalesce(profile, 'standard') AS profile, content FROM rtf_converted_data)
        SELECT DISTINCT 'rtf_converted_data' AS item_table, convert_id AS item_id FROM r JOIN chunk_profiles p USING (profile) WHERE length(content) > chunk_size
        UNION ALL
        SELECT DISTINCT 'chunks', chunk_id FROM chunks c LEFT JOIN (SELECT DISTINCT convert_id, profile FROM r) r USING (convert_id)
        JOIN chunk_profiles p ON p.profile = coalesce(r.profile, 'standard') WHERE length(text) > chunk_size""",
}
