"""Queries of the document operators over the driver's tables, and the same questions in SQL.

Each query runs over its whole tables. Text columns come from `documents`, `rtf_converted_data`, `csv_source_info` and
`cell_info`; structure that the tables lack (charts, geometry) is made from the star schema inside the query, by the same
rule in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import blocks, tags, text
from textloom.functions.once import once
from textloom.operators import chunking, csv_tables, geometry, grids, ocr, pages, regions, sheets, splitter, tables
from textloom.plans.general import table
from textloom.sources import sinks

SP = text.SPACE


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _converted(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "rtf_converted_data").filter(F.col("content").isNotNull()).select("convert_id", F.col("content").alias("text")), ["convert_id"])


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "csv_source_info").filter(F.col("parsed_rows").isNotNull()).select("csv_id", F.col("parsed_rows").alias("rows"), "has_header", "delimiter"), ["csv_id"])


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "cell_info").select("cell_id", "grid_key", "row_no", "col_no", "bbox", "text", "is_header"), ["cell_id"])


_R = "r AS (SELECT DISTINCT convert_id, content AS text FROM rtf_converted_data WHERE content IS NOT NULL)"
_C = "c AS (SELECT csv_id, any_value(parsed_rows) AS rows FROM csv_source_info WHERE parsed_rows IS NOT NULL GROUP BY csv_id)"
_G = "g AS (SELECT DISTINCT ON (cell_id) cell_id, grid_key, row_no, col_no, bbox, text, is_header FROM cell_info)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+\\z', '', 'g')"


def _count(chars: str) -> str:
    return f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"



QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# scalar text


@query(f"SELECT doc_id, {_strip(f'''regexp_replace(coalesce(text, ''), '\\n[{SP}]*\\n[{SP}]*\\n+', chr(10) || chr(10), 'g')''')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, replace(regexp_replace(coalesce(text, ''), '[{SP}]+\\z', ''), chr(9), '    ') AS cleaned FROM documents")
def clean_code_text(spark, sf):
    return _docs(spark, sf).select("doc_id", text.clean_code_text(F.col("text")).alias("cleaned"))


@query("SELECT DISTINCT source_id, regexp_replace(coalesce(content, ''), '[\\x{E000}-\\x{F8FF}\\x{FFFE}\\x{FFFF}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS cleaned FROM rtf_source_info")
def sanitize_text(spark, sf):
    return once(table(spark, sf, "rtf_source_info").select("source_id", "content"), ["source_id"]).select("source_id", text.sanitize_for_json(F.col("content")).alias("cleaned"))


_PUA, _LOST = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}", r"\x{FFFD}"
_CONTROL = r"\x00-\x1f\x7f-\x{9f}\x{FFF0}-\x{FFFC}\x{FFFE}\x{FFFF}"
_VALID = r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}A-Za-z0-9 \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,!?;:''\"()\[\]{}\-–—…·•\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}"


@query(f"""
    WITH d AS (SELECT DISTINCT source_id, coalesce(content, '') AS t FROM rtf_source_info),
    n AS (SELECT source_id, length(t) AS total, {_count(_PUA)} AS pua, {_count(_LOST)} AS lost, {_count(_CONTROL)} AS controls, {_count(_VALID)} AS valid FROM d),
    q AS (SELECT *, CASE WHEN total < 10 THEN 1.0 ELSE least(1.0, greatest(0.0, (1.0 - 0.8 * pua / total - 0.9 * lost / total) * (0.5 + 0.5 * valid / total))) END AS score FROM n)
    SELECT source_id, total::INTEGER AS total, (CASE WHEN total < 10 THEN 0 ELSE pua END)::INTEGER AS pua, (CASE WHEN total < 10 THEN 0 ELSE lost END)::INTEGER AS replacement, (CASE WHEN total < 10 THEN 0 ELSE controls END)::INTEGER AS controls,
        (CASE WHEN total < 10 THEN total ELSE valid END)::INTEGER AS valid, CAST(floor(score * 1000 + 0.500001) AS BIGINT) AS score_permille, total >= 10 AND (score < 0.7 OR pua / greatest(1, total) >= 0.1) AS needs_ocr FROM q""")
def text_quality(spark, sf):
    q = text.text_quality(F.col("content"))
    d = once(table(spark, sf, "rtf_source_info").select("source_id", "content"), ["source_id"]).select("source_id", q.alias("q"))
    return d.select("source_id", "q.total", "q.pua", "q.replacement", "q.controls", "q.valid", F.floor(F.col("q.score") * 1000 + 0.500001).alias("score_permille"), "q.needs_ocr")


@query(r"SELECT doc_id, coalesce(length(text) >= 500 AND length(regexp_replace(text, '[^\p{L}\p{N}_\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]', '', 'g')) / greatest(1, length(text)) >= 0.6, false) AS sufficient FROM documents")
def text_quality_sufficient(spark, sf):
    return _docs(spark, sf).select("doc_id", text.is_quality_sufficient(F.col("text")).alias("sufficient"))


@query("SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN n <= 1000 THEN 1 ELSE greatest(1, (n - 200) // 800 + 1) END::INTEGER AS chunks FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)")
def estimate_chunks(spark, sf):
    return _docs(spark, sf).select("doc_id", text.estimate_chunks(F.col("text")).alias("chunks"))


@query("""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    p AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
    s AS (SELECT doc_id, i, t, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p)
    SELECT doc_id, count(*) AS lines, CAST(sum(start) AS BIGINT) AS sum_of_starts, CAST(max(start) AS BIGINT) AS last_start FROM s WHERE i = 1 OR start < length(t) GROUP BY doc_id""")
def line_starts(spark, sf):
    d = _docs(spark, sf).select("doc_id", text.line_starts(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("lines"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_of_starts"), F.array_max("s").cast("long").alias("last_start"))


@query("SELECT doc_id, greatest(1, length(substr(t, 1, length(t) // 2 + 1)) - length(replace(substr(t, 1, length(t) // 2), chr(10), '')) - CASE WHEN length(t) > 0 THEN 0 ELSE 0 END - (length(substr(t, 1, length(t) // 2 + 1)) - length(substr(t, 1, length(t) // 2))) + 1) AS line FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def position_to_line(spark, sf):
    """The line in which the middle of each text lies."""
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, sf).select("doc_id", text.position_to_line(F.floor(F.length(t) / 2), text.line_starts(t)).cast("long").alias("line"))


@query("""
    SELECT doc_id, length(a) AS length_a, coalesce((SELECT max(k) FROM range(1, 301) t(k) WHERE k <= length(a) AND k <= length(b) AND right(a, k) = left(b, k)), 0) AS shared
    FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 300) AS a, substr(coalesce(text, ''), 201, 300) AS b FROM documents)""")
def overlap_length(spark, sf):
    t = F.coalesce("text", F.lit(""))
    d = _docs(spark, sf).select("doc_id", F.substring(t, 1, 300).alias("a"), F.substring(t, 201, 300).alias("b"))
    return d.select("doc_id", F.length("a").cast("long").alias("length_a"), text.overlap_length(F.col("a"), F.col("b"), F.lit(300)).cast("long").alias("shared"))


@query("""
    WITH c AS (SELECT DISTINCT chunk_id, convert_id, chunk_index, coalesce(text, '') AS b FROM chunks WHERE convert_id IS NOT NULL),
    p AS (SELECT chunk_id, b, lag(b) OVER (PARTITION BY convert_id ORDER BY chunk_index, chunk_id) AS a FROM c)
    SELECT chunk_id, length(b) AS length_b, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) AS shared FROM p WHERE a IS NOT NULL""")
def chunk_overlaps(spark, sf):
    """What each chunk shares with the chunk before it in its record, whole texts compared."""
    c = table(spark, sf, "chunks").filter(F.col("convert_id").isNotNull()).dropDuplicates(["chunk_id"]).withColumn("b", F.coalesce("text", F.lit("")))
    p = c.withColumn("a", F.lag("b").over(W.partitionBy("convert_id").orderBy("chunk_index", "chunk_id"))).filter(F.col("a").isNotNull())
    return p.select("chunk_id", F.length("b").cast("long").alias("length_b"), text.overlap_length(F.col("a"), F.col("b"), F.length("a")).cast("long").alias("shared"))


@query("SELECT convert_id, length(text) AS n, true AS same FROM (WITH " + _R + " SELECT * FROM r)")
def reconstruct_chunks(spark, sf):
    """Pieces of 400 characters with 100 of overlap, put together again by the overlap that is found between them. By chance it
    may be longer only where text repeats itself, which the length of the overlap searched for rules out."""
    t, n = F.col("text"), F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - 400) / 300)) * 300, F.lit(300))
    pieces = F.transform(starts, lambda s: F.substr(t, s.cast("int") + 1, F.lit(400)))
    return _converted(spark, sf).select("convert_id", n.cast("long").alias("n"), (text.reconstruct(pieces, 100) == t).alias("same"))


_NUM = "^(" + "|".join(text.NUMERIC) + r")\z"


@query(f"WITH {_G} SELECT cell_id, coalesce(regexp_matches({_strip('text')}, '{_NUM}'), false) AS numeric FROM g")
def is_numeric(spark, sf):
    return _cells(spark, sf).select("cell_id", text.is_numeric(F.col("text")).alias("numeric"))


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 + o_custkey AS n FROM orders)")
def file_size(spark, sf):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 37 + F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", text.format_file_size(n).alias("size"))


@query("WITH " + _R + " SELECT convert_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS cell FROM r")
def escape_html(spark, sf):
    return _converted(spark, sf).select("convert_id", text.escape_html(F.col("text")).alias("escaped"), text.escape_html(F.col("text"), quotes=False, breaks=True).alias("cell"))


@query(f"WITH {_G} SELECT cell_id, {_strip(f'''regexp_replace(coalesce(text, ''), '[{SP}]+', ' ', 'g')''')} AS cleaned FROM g")
def cell_whitespace(spark, sf):
    return _cells(spark, sf).select("cell_id", text.cell_whitespace(F.col("text")).alias("cleaned"))


@query("""
    SELECT DISTINCT l_partkey % 3000 AS n, (WITH RECURSIVE s(rest, out, k) AS (SELECT (l_partkey % 3000)::INTEGER, '', 1 UNION ALL
        SELECT rest % v[k], out || repeat(t[k], (rest // v[k])::INTEGER), k + 1 FROM s, (SELECT [1000,900,500,400,100,90,50,40,10,9,5,4,1] AS v, ['M','CM','D','CD','C','XC','L','XL','X','IX','V','IV','I'] AS t) WHERE k <= 13)
        SELECT out FROM s WHERE k = 14) AS roman,
      CASE WHEN n = 0 THEN '' WHEN n <= 26 THEN chr(64 + n::INTEGER) WHEN n <= 702 THEN chr(64 + ((n - 1) // 26)::INTEGER) || chr(65 + ((n - 1) % 26)::INTEGER)
        ELSE chr(64 + ((n - 27) // 676)::INTEGER) || chr(65 + (((n - 27) // 26) % 26)::INTEGER) || chr(65 + ((n - 1) % 26)::INTEGER) END AS alpha FROM lineitem""")
def list_numbers(spark, sf):
    n = (F.col("l_partkey") % 3000).alias("n")
    d = table(spark, sf, "lineitem").select(n).distinct()
    return d.select("n", text.roman(F.col("n")).alias("roman"), text.alpha(F.col("n")).alias("alpha"))


_CATS = " ".join("WHEN e IN (" + ",".join(f"'{x}'" for x in exts.split()) + f") THEN '{name}'" for name, exts in text.CATEGORIES.items())


@query(f"SELECT DISTINCT meta_id, e AS ext, CASE {_CATS} ELSE 'unknown' END AS category FROM (SELECT meta_id, lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) AS e FROM document_metadata)")
def file_category(spark, sf):
    d = table(spark, sf, "document_metadata").dropDuplicates(["meta_id"]).withColumn("ext", text.extension(F.col("file_path")))
    return d.select("meta_id", "ext", text.file_category(F.col("ext")).alias("category"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN strftime(DATE '1899-12-30' + (l_orderkey % 60000)::INTEGER, '%Y-%m-%d') ELSE (l_orderkey % 60000)::VARCHAR END AS shown FROM lineitem")
def spreadsheet_cell(spark, sf):
    v = (F.col("l_orderkey") % 60000).cast("double")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.xls_cell(v, F.col("l_linenumber") % 2 == 0).alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def pdf_date(spark, sf):
    written = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+09'00'"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(text.pdf_date(written), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT csv_id, CASE delimiter WHEN ',' THEN 'Comma (,)' WHEN chr(9) THEN 'Tab (\\t)' WHEN ';' THEN 'Semicolon (;)' WHEN '|' THEN 'Pipe (|)' ELSE '''' || delimiter || '''' END AS label FROM (SELECT csv_id, any_value(delimiter) AS delimiter FROM csv_source_info WHERE parsed_rows IS NOT NULL GROUP BY csv_id)")
def delimiter_label(spark, sf):
    return _csv(spark, sf).select("csv_id", text.delimiter_label(F.col("delimiter")).alias("label"))


# tags


@query("WITH " + _R + r" SELECT convert_id, array_to_string(regexp_extract_all(text, '(?i)\[Page Number: ([0-9]+)\]', 1), ',') AS pages, regexp_matches(text, '(?i)\[Page Number: ([0-9]+)\]') AS has_pages, regexp_matches(text, '(?i)\[Slide Number: ([0-9]+)\]') AS has_slides FROM r")
def find_page_numbers(spark, sf):
    n = F.transform(tags.find_numbers(F.col("text")), lambda x: x.cast("string"))
    return _converted(spark, sf).select("convert_id", F.array_join(n, ",").alias("pages"), tags.has_markers(F.col("text")).alias("has_pages"), tags.has_markers(F.col("text"), "slide").alias("has_slides"))


@query("WITH " + _R + r""", p AS (SELECT convert_id, text, unnest(regexp_extract_all(text, '\[Page Number: [0-9]+\]')) AS tag, generate_subscripts(regexp_extract_all(text, '\[Page Number: [0-9]+\]'), 1) AS i, regexp_split_to_array(text, '\[Page Number: [0-9]+\]') AS gaps FROM r)
    SELECT convert_id, i - 1 AS i, regexp_extract(tag, '[0-9]+')::INTEGER AS number, CAST(sum(length(gaps[i]) + length(tag)) OVER (PARTITION BY convert_id ORDER BY i) - length(tag) AS BIGINT) AS start FROM p""")
def page_spans(spark, sf):
    d = _converted(spark, sf).select("convert_id", F.posexplode(tags.find_spans(F.col("text"))).alias("i", "s"))
    return d.select("convert_id", F.col("i").cast("long").alias("i"), "s.number", F.col("s.start").cast("long").alias("start"))


@query("WITH " + _R + r" SELECT convert_id, regexp_replace(regexp_replace(text, '(?i)\[Page Number: ([0-9]+)\]', '', 'g'), '(?i)\[Slide Number: ([0-9]+)\]', '', 'g') AS text FROM r")
def remove_page_markers(spark, sf):
    return _converted(spark, sf).select("convert_id", tags.remove_markers(F.col("text")).alias("text"))


@query("WITH " + _R + r" SELECT convert_id, unnest(regexp_extract_all(text, '\[Image:([^\]]+)\]', 1)) AS path FROM r")
def image_tags(spark, sf):
    return _converted(spark, sf).select("convert_id", F.explode(tags.image_paths(F.col("text"))).alias("path"))


@query("WITH " + _R + r" SELECT convert_id, regexp_replace(text, '\[Image:([^\]]+)\]', '[Figure:seen \1]', 'g') AS text FROM r")
def ocr_replace(spark, sf):
    """The OCR join with an engine that says the path it is given as bytes."""
    docs = _converted(spark, sf)
    paths = docs.select(F.explode(tags.image_paths(F.col("text"))).alias("path")).distinct()
    images = paths.withColumn("content", F.col("path").cast("binary"))
    return ocr.replace_tags(docs, images, lambda data: "seen " + data.decode(), key="convert_id")


@query("WITH " + _R + r" SELECT count(DISTINCT p) AS images, count(DISTINCT left(sha256(p), 32)) AS hashes FROM (SELECT unnest(regexp_extract_all(text, '\[Image:([^\]]+)\]', 1)) AS p FROM r)")
def distinct_images(spark, sf):
    paths = _converted(spark, sf).select(F.explode(tags.image_paths(F.col("text"))).alias("path"))
    images = blocks.distinct_images(paths.withColumn("content", F.col("path").cast("binary")))
    return images.agg(F.count("*").alias("images"), F.countDistinct("image_hash").alias("hashes"))


# metadata and charts

_META = """
    WITH d AS (SELECT DISTINCT ON (meta_id) meta_id, title, subject, author, keywords, comments, last_saved_by, custom, TIMESTAMP '2020-01-01' + to_days((meta_id % 1000)::INTEGER) AS day FROM document_metadata),
    b AS (SELECT meta_id, list_concat(list_filter(['  Title: ' || nullif(title, ''), '  Subject: ' || nullif(subject, ''), '  Author: ' || nullif(author, ''), '  Keywords: ' || nullif(keywords, ''), '  Comments: ' || nullif(comments, ''), '  Last Saved By: ' || nullif(last_saved_by, ''),
            '  Created: ' || strftime(day, '%Y-%m-%d %H:%M:%S'), '  Last Modified: ' || strftime(day + INTERVAL 3600 SECOND, '%Y-%m-%d %H:%M:%S')], lambda x: x IS NOT NULL),
        coalesce(list_transform(list_filter(custom, lambda x: x.v IS NOT NULL), lambda x: '  K/' || replace(x.k, '_', ' ') || ': ' || x.v), [])) AS lines FROM d)"""
_BLOCK = "CASE WHEN len(lines) = 0 THEN '' ELSE '<Document-Metadata>' || chr(10) || array_to_string(lines, chr(10)) || chr(10) || '</Document-Metadata>' END"


def _metadata(spark, sf):
    """All eight fields and the custom ones. The dates are made from the key, since the table's own times are text of
    many forms; `K/` before a custom key keeps it from being put into title case."""
    keys = ["title", "subject", "author", "keywords", "comments", "last_saved_by"]
    rows = once(table(spark, sf, "document_metadata").select("meta_id", *keys, "custom", F.expr("timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(cast(meta_id % 1000 as int))").alias("day")), ["meta_id"])
    fields = {k: F.col(k) for k in keys} | {"create_time": F.col("day"), "last_saved_time": F.col("day") + F.expr("INTERVAL 1 HOUR")}
    custom = F.transform("custom", lambda x: F.struct(F.concat(F.lit("K/"), x["k"]).alias("k"), x["v"].alias("v")))
    return rows.select("meta_id", blocks.metadata_block(fields, custom).alias("block"))


@query(_META + f" SELECT meta_id, {_BLOCK} AS block FROM b")
def metadata_block(spark, sf):
    return _metadata(spark, sf)


@query(_META + f" SELECT meta_id, {_BLOCK} AS block, 'before' || chr(10) || chr(10) || 'after' AS rest FROM b WHERE len(lines) > 0")
def metadata_extract(spark, sf):
    d = _metadata(spark, sf).filter("block != ''").withColumn("text", F.concat(F.lit("before\n"), "block", F.lit("\nafter")))
    return d.select("meta_id", tags.first_metadata(F.col("text")).alias("m")).select("meta_id", "m.block", "m.rest")


_CHART = """
    WITH m AS (SELECT year(o_orderdate)::INTEGER AS chart, month(o_orderdate)::INTEGER AS mo, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL),
    st AS (SELECT unnest(['F', 'O', 'P']) AS s), ca AS (SELECT DISTINCT chart FROM m), mo AS (SELECT unnest(range(1, 13))::INTEGER AS mo),
    v AS (SELECT ca.chart, mo.mo, st.s, m.n FROM ca, mo, st LEFT JOIN m ON m.chart = ca.chart AND m.mo = mo.mo AND m.s = st.s)"""


def _chart_series(spark, sf):
    """Orders of a year by month (categories) and status (series); months without orders have no value."""
    m = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("chart"), F.month("o_orderdate").alias("mo"), F.col("o_orderstatus").alias("s")).count()
    years = m.groupBy("chart").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "s", "mo"), "count"))).alias("v"))
    months = F.sequence(F.lit(1), F.lit(12))

    def one(s: str):
        return F.struct(F.lit(s).alias("name"), F.transform(months, lambda i: F.try_element_at("v", F.concat(F.lit(s + "/"), i.cast("string"))).cast("double")).alias("values"))

    series = F.array(one("F"), one("O"), one("P"))
    return years.select("chart", F.transform(months, lambda i: F.concat(F.lit("M"), i.cast("string"))).alias("categories"), series.alias("series"))


@query(_CHART + """, r AS (SELECT chart, mo, '<tr><td>M' || mo || '</td>' || string_agg('<td>' || coalesce(format('{:,.2f}', n::DOUBLE), '') || '</td>', '' ORDER BY s) || '</tr>' AS row FROM v GROUP BY chart, mo)
    SELECT chart, '[chart]' || chr(10) || 'Chart Type: Bar Chart' || chr(10) || 'Title: Orders of ' || chart || chr(10) || chr(10) || '<table border=''1''>' || chr(10) || '<tr><th>Category</th><th>F</th><th>O</th><th>P</th></tr>' || chr(10) || string_agg(row, chr(10) ORDER BY mo) || chr(10) || '</table>' || chr(10) || '[/chart]' AS block FROM r GROUP BY chart""")
def chart_block(spark, sf):
    d = _chart_series(spark, sf)
    title = F.concat(F.lit("Orders of "), F.col("chart").cast("string"))
    return d.select("chart", blocks.chart_block(blocks.chart_type_name(F.lit("barChart")), title, F.col("categories"), F.col("series")).alias("block"))


@query(_CHART + """, r AS (SELECT chart, mo, '| M' || mo || ' | ' || string_agg(coalesce(format('{:,.2f}', n::DOUBLE), ''), ' | ' ORDER BY s) || ' |' AS row FROM v GROUP BY chart, mo)
    SELECT chart, '| Category | F | O | P |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg(row, chr(10) ORDER BY mo) AS block FROM r GROUP BY chart""")
def chart_markdown(spark, sf):
    return _chart_series(spark, sf).select("chart", blocks.chart_markdown(F.col("categories"), F.col("series")).alias("block"))


# pages

_PAGES = r"""
    WITH """ + _R + r""", p AS (SELECT convert_id, unnest(regexp_extract_all(text, '\[Page Number: [0-9]+\]')) AS tag, generate_subscripts(regexp_extract_all(text, '\[Page Number: [0-9]+\]'), 1) AS i, regexp_split_to_array(text, '\[Page Number: [0-9]+\]') AS gaps FROM r),
    q AS (SELECT convert_id, i, tag || gaps[i + 1] AS page, tag FROM p UNION ALL SELECT convert_id, 0, regexp_split_to_array(text, '\[Page Number: [0-9]+\]')[1], '' FROM r),
    s AS (SELECT convert_id, i, regexp_extract(tag, '[0-9]+') AS number, """ + _strip("page") + """ AS page, tag FROM q),
    pages AS (SELECT convert_id, i, coalesce(try_cast(number AS INTEGER), 0) AS number, page FROM s WHERE page != '' AND page != tag)"""


@query(_PAGES + " SELECT convert_id, CAST(row_number() OVER (PARTITION BY convert_id ORDER BY i) - 1 AS INTEGER) AS page_no, number, page FROM pages")
def split_into_pages(spark, sf):
    d = _converted(spark, sf).select("convert_id", F.posexplode(pages.split_into_pages_column(F.col("text"))).alias("page_no", "p"))
    return d.select("convert_id", "page_no", "p.number", "p.page")


@query(_PAGES + """, l AS (SELECT convert_id, list(page ORDER BY i) AS ps FROM pages GROUP BY convert_id),
    f AS (SELECT convert_id, list_reduce(list_transform(ps, lambda p: {'done': []::VARCHAR[], 'held': p, 'carried': ''}), lambda a, b:
        CASE WHEN a.held = '' THEN {'done': a.done, 'held': CASE WHEN a.carried = '' THEN b.held ELSE a.carried || chr(10) || chr(10) || b.held END, 'carried': ''}
             WHEN length(a.held) + 4 + length(b.held) > 1500 THEN {'done': list_append(a.done, a.held), 'held': b.held, 'carried': ''}
             WHEN length(a.held) + 4 + length(b.held) > 1000 THEN {'done': list_append(a.done, a.held || chr(10) || chr(10) || b.held), 'held': '', 'carried': right(b.held, 200)}
             ELSE {'done': a.done, 'held': a.held || chr(10) || chr(10) || b.held, 'carried': ''} END) AS s FROM l),
    c AS (SELECT convert_id, CASE WHEN s.held = '' THEN s.done ELSE list_append(s.done, s.held) END AS chunks FROM f)
    SELECT convert_id, generate_subscripts(chunks, 1)::INTEGER - 1 AS chunk_index, unnest(chunks) AS text FROM c""")
def chunk_by_pages(spark, sf):
    p = F.transform(pages.split_into_pages_column(F.col("text")), lambda x: x["page"])
    return _converted(spark, sf).select("convert_id", F.posexplode(pages.pack_pages_column(p, 1000, 200)).alias("chunk_index", "text"))


# tables


@query("WITH " + _C + f""", f AS (SELECT csv_id, rows, rows[1] AS a, rows[2] AS b FROM c)
    SELECT csv_id, coalesce(len(rows) >= 2 AND NOT list_bool_or(list_append(list_transform(a, lambda x: regexp_matches({_strip("coalesce(x, '')")}, '{_NUM}')), false))
        AND (list_bool_or(list_append(list_transform(b, lambda x: regexp_matches({_strip("coalesce(x, '')")}, '{_NUM}')), false)) OR len(list_distinct(a)) + CASE WHEN len(list_filter(a, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END = len(a)), false) AS header FROM f""")
def detect_header(spark, sf):
    return _csv(spark, sf).select("csv_id", csv_tables.detect_header(F.col("rows")).alias("header"))


@query("WITH " + _C + f""", x AS (SELECT csv_id, len(rows) AS n, generate_subscripts(rows, 1) AS i, unnest(rows) AS r FROM c), y AS (SELECT csv_id, n, i, generate_subscripts(r, 1) AS j, {_strip("coalesce(unnest(r), '')")} AS v FROM x),
    z AS (SELECT *, lag(v) OVER (PARTITION BY csv_id, i ORDER BY j) AS before FROM y)
    SELECT c.csv_id, coalesce(bool_or(n >= 2 AND v = '' AND ((i > 1 AND j = 1) OR (before != ''))), false) AS merged FROM c LEFT JOIN z USING (csv_id) GROUP BY c.csv_id""")
def merged_cells(spark, sf):
    return _csv(spark, sf).select("csv_id", csv_tables.has_merged_cells(F.col("rows")).alias("merged"))


@query("WITH " + _C + f""", x AS (SELECT csv_id, generate_subscripts(rows, 1) AS i, unnest(rows) AS r FROM c),
    l AS (SELECT csv_id, i, '| ' || array_to_string(list_transform(r, lambda v: replace(replace({_strip("coalesce(v, '')")}, '|', '\\|'), chr(10), ' ')), ' | ') || ' |' AS line, '| ' || array_to_string(list_transform(r, lambda v: '---'), ' | ') || ' |' AS rule FROM x)
    SELECT csv_id, string_agg(CASE WHEN i = 1 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY i) AS markdown FROM l GROUP BY csv_id""")
def markdown_table(spark, sf):
    return _csv(spark, sf).select("csv_id", csv_tables.to_markdown(F.col("rows")).alias("markdown"))


@query("WITH " + _C + f""", x AS (SELECT csv_id, generate_subscripts(rows, 1) AS i, unnest(rows) AS r FROM c),
    l AS (SELECT csv_id, i, '<tr>' || chr(10) || array_to_string(list_transform(r, lambda v: '<td>' || replace(replace(replace(replace({_strip("coalesce(v, '')")}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</td>'), chr(10)) || chr(10) || '</tr>' AS line FROM x)
    SELECT csv_id, '<table border=''1''>' || chr(10) || string_agg(line, chr(10) ORDER BY i) || chr(10) || '</table>' AS html FROM l GROUP BY csv_id""")
def html_table(spark, sf):
    return _csv(spark, sf).select("csv_id", csv_tables.plain_html(F.col("rows"), F.lit(False)).alias("html"))


@query()
def merged_html_table(spark, sf):
    """Tables with merged cells as HTML; a sequential rule over the grid, tested against a brute-force version."""
    return _csv(spark, sf).select("csv_id", csv_tables.merged_html(F.col("rows"), F.coalesce("has_header", F.lit(False))).alias("html"))


def _brand_tables(spark, sf):
    """A Markdown table of the parts of each brand."""
    row = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" | "), "p_type", F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"])
    return table(spark, sf, "part").groupBy("p_brand").agg(rows.alias("rows"))


def _pack(limit: int) -> str:
    return f"""
    WITH p AS (SELECT p_brand, list('| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' |' ORDER BY p_partkey) AS rows FROM part GROUP BY p_brand),
    k AS (SELECT p_brand, rows, list_reduce(list_transform(rows, lambda r: {{'out': [0], 'chunk': 0, 'filled': length(r) + 1, 'n': length(r) + 1}}),
        lambda a, b: {{'out': list_append(a.out, a.chunk + CASE WHEN a.filled + b.n > {limit} THEN 1 ELSE 0 END), 'chunk': a.chunk + CASE WHEN a.filled + b.n > {limit} THEN 1 ELSE 0 END, 'filled': CASE WHEN a.filled + b.n > {limit} THEN b.n ELSE a.filled + b.n END, 'n': b.n}}) AS s FROM p)"""


@query(_pack(1428) + " , e AS (SELECT p_brand, unnest(s.out) AS chunk FROM k) SELECT p_brand, chunk, count(*) AS n FROM e GROUP BY ALL")
def pack_table_rows(spark, sf):
    """Greedy packing of table rows as a fold in the JVM, at most 1428 characters a chunk."""
    d = _brand_tables(spark, sf)
    sizes = F.transform("rows", lambda r: (F.length(r) + 1).cast("bigint"))
    return d.select("p_brand", F.explode(tables.pack_column(sizes, F.lit(1428))).alias("chunk")).groupBy("p_brand", "chunk").agg(F.count("*").alias("n"))


_HEAD = "| part number | name    | type        |\n|---|---|---|"


@query(_pack(1470 - len(_HEAD) - 1) + f""" , e AS (SELECT p_brand, unnest(rows) AS row, unnest(s.out) AS chunk, generate_subscripts(rows, 1) AS i, s.chunk + 1 AS total, list_sum(list_transform(rows, lambda r: length(r) + 1)) AS size FROM k),
    t AS (SELECT *, CASE WHEN total > 1 THEN total ELSE ceil(size / {1000 - len(_HEAD) - 31}.0)::INTEGER END AS shown FROM e WHERE size + {len(_HEAD)} > 1000)
    SELECT p_brand, chunk AS chunk_index, '[Table Chunk ' || (chunk + 1) || '/' || shown || ']' || chr(10) || '{_HEAD.replace(chr(10), "' || chr(10) || '")}' || chr(10) || string_agg(row, chr(10) ORDER BY i) AS text FROM t GROUP BY p_brand, chunk, shown""")
def markdown_table_chunks(spark, sf):
    """Tables that do not fit 1000 characters, by the chunker itself. At most one and a half sizes less header and label
    go into a chunk; a lone chunk keeps the label of the estimate."""
    d = _brand_tables(spark, sf).select("p_brand", F.concat(F.lit(_HEAD + "\n"), F.array_join("rows", "\n")).alias("text"))
    chunks = chunking.chunks_column(F.col("text"), F.lit("csv"), 1000, 0)
    return d.select("p_brand", F.posexplode(chunks).alias("chunk_index", "text")).filter(F.col("text").startswith("[Table Chunk"))


@query("SELECT n_regionkey, count(*) AS rows, 1 AS header_rows, true AS spans FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def parse_html_table(spark, sf):
    """Nations of a region under a cell that spans them, parsed again."""
    first = F.concat(F.lit("<tr><td rowspan='"), F.col("n").cast("string"), F.lit("'>"), F.col("n_regionkey").cast("string"), F.lit("</td><td>"))
    d = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("n_name")).alias("names"))
    html = F.concat(F.lit("<table border='1'><tr><th>region</th><th>nation</th></tr>"), first, F.array_join("names", "</td></tr><tr><td>"), F.lit("</td></tr></table>"))

    @F.udf("struct<rows bigint, header_rows int, spans boolean>", useArrow=True)
    def parsed(source):
        t = tables.parse_html(source)
        return len(t.rows), len(t.header), tables.has_rowspans(source)

    return d.filter("n > 1").select("n_regionkey", parsed(html).alias("t")).select("n_regionkey", "t.*")


@query("""
    WITH d AS (SELECT element_id, any_value(content) AS t FROM docx_elements WHERE element_type = 'table' AND content IS NOT NULL GROUP BY element_id),
    r AS (SELECT element_id, t, regexp_extract_all(t, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS trs FROM d),
    n AS (SELECT element_id, t, list_transform(trs, lambda x: [len(regexp_extract_all(x, '(?is)<th[^>]*>.*?</th>')), len(regexp_extract_all(x, '(?is)<td[^>]*>.*?</td>'))]) AS k FROM r),
    f AS (SELECT *, coalesce(list_position(list_transform(k, lambda x: NOT (x[1] > 0 AND x[2] = 0)), true) - 1, CASE WHEN len(k) > 0 THEN len(k) END) AS heads FROM n)
    SELECT element_id, CASE WHEN len(k) > 0 THEN (len(k) - heads)::BIGINT END AS rows, CASE WHEN len(k) > 0 THEN heads::INTEGER END AS header_rows,
        list_max(list_transform(k, lambda x: CASE WHEN x[1] > 0 AND x[2] = 0 THEN x[1] ELSE x[2] END))::INTEGER AS columns,
        CASE WHEN len(k) > 0 THEN len(list_filter(regexp_extract_all(t, '(?i)rowspan=["'']?([0-9]+)', 1), lambda x: x::INTEGER > 1)) > 0 END AS spans FROM f""")
def parse_docx_tables(spark, sf):
    """Every table of the documents' elements, parsed; nulls where there is no table in it."""

    @F.udf("struct<rows bigint, header_rows int, columns int, spans boolean>", useArrow=True)
    def parsed(source):
        t = tables.parse_html(source)
        return None if t is None else (len(t.rows), len(t.header), t.columns, tables.has_rowspans(source))

    d = table(spark, sf, "docx_elements").filter((F.col("element_type") == "table") & F.col("content").isNotNull()).dropDuplicates(["element_id"])
    return d.select("element_id", parsed("content").alias("t")).select("element_id", "t.*")


@query("WITH " + _R + r", t AS (SELECT convert_id, text FROM r), x AS (SELECT convert_id, unnest(regexp_extract_all(text, '\[Image:[^\]]+\]|\[Page Number: [0-9]+\]')) AS tag FROM t) SELECT convert_id, count(*) AS regions, CAST(sum(length(tag)) AS BIGINT) AS characters FROM x GROUP BY convert_id")
def tag_regions(spark, sf):
    """Protected image and page tags of each record, merged as spans by the fold."""
    page = F.transform(tags.find_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("page_tag").alias("kind")))
    zipped = F.arrays_zip(F.split("text", tags.DEFAULT.image).alias("gap"), F.regexp_extract_all("text", F.lit(tags.DEFAULT.image), 0).alias("tag"))
    step = F.transform(F.filter(zipped, lambda z: z["tag"].isNotNull()), lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["tag"]).alias("n")))
    start = F.struct(F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"), F.lit(0).alias("at"))
    image = F.aggregate(step, start, lambda a, s: F.struct(F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["n"]).alias("end"), F.lit("image_tag").alias("kind")))).alias("out"), (a["at"] + s["gap"] + s["n"]).alias("at")), lambda a: a["out"])
    d = _converted(spark, sf).select("convert_id", regions.merge_spans_column(F.concat(page, image)).alias("m")).filter(F.size("m") > 0)
    return d.select("convert_id", F.size("m").cast("long").alias("regions"), F.aggregate("m", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("characters"))


# chunking of whole documents


@query("SELECT doc_id, true AS covered, 0 AS too_long FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^" + SP + "]')")
def recursive_split(spark, sf):
    """Chunks of 500 with 50 of overlap: none too long, and all visible characters there in order."""

    @F.udf("struct<covered boolean, too_long int>", useArrow=True)
    def checked(t):
        chunks = splitter.split_recursive(t, 500, 50)
        seen = iter("".join("".join(chunks).split()))
        return all(c in seen for c in "".join(t.split())), sum(len(c) > 500 for c in chunks)

    d = _docs(spark, sf).filter(F.col("text").rlike(f"[^{SP}]"))
    return d.select("doc_id", checked("text").alias("c")).select("doc_id", "c.*")


@query()
def chunk_documents(spark, sf):
    """Every document through the router, 1000 with 200 of overlap."""
    return chunking.chunk_documents(_docs(spark, sf))


@query()
def chunk_positions(spark, sf):
    return chunking.chunk_documents(_converted(spark, sf), key="convert_id", positions=True)


@query("WITH " + _R + r" SELECT convert_id, len(regexp_extract_all(text, '\[Image:[^\]]+\]')) AS tags, 0 AS cut FROM r WHERE regexp_matches(text, '\[Image:[^\]]+\]')")
def region_split(spark, sf):
    """Texts with image tags split around them: each tag is whole in some chunk."""

    @F.udf("struct<tags bigint, cut int>", useArrow=True)
    def checked(t):
        import re

        chunks = regions.split_around_regions(t, 600, 80)
        found = re.findall(r"\[Image:[^\]]+\]", t)
        return len(found), sum(not any(x in c for c in chunks) for x in found)

    d = _converted(spark, sf).filter(F.col("text").rlike(r"\[Image:[^\]]+\]"))
    return d.select("convert_id", checked("text").alias("c")).select("convert_id", "c.*")


@query("SELECT n_regionkey AS r_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name || ']') - 1 AS INTEGER) AS chunk_index, '[Sheet: ' || n_name || ']' || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' AS text FROM nation")
def sheet_chunks(spark, sf):
    """Nations as sheets of one row each, per region: one chunk a sheet, under its tag."""
    sheet = F.concat(F.lit("[Sheet: "), "n_name", F.lit("]\n| key | name |\n| --- | --- |\n| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    books = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list(sheet)), "\n\n").alias("text"))

    @F.udf("array<string>", useArrow=True)
    def chunks(t):
        return sheets.chunk_sheet_text(t, 1000)

    return books.select("r_regionkey", F.posexplode(chunks("text")).alias("chunk_index", "text"))


@query()
def csv_sheet_chunks(spark, sf):
    """CSV sources as the sheets of workbooks, four to a book, in chunks of 300, so that longer sheets occur and are parted by their rows."""
    sheet = F.concat(F.lit("[Sheet: "), F.col("csv_id").cast("string"), F.lit("]\n"), csv_tables.to_markdown(F.col("rows")))
    one = F.struct("csv_id", sheet.alias("text"))
    books = _csv(spark, sf).groupBy(F.floor(F.col("csv_id") / 4).alias("book")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"]), "\n\n").alias("text"))

    @F.udf("array<string>", useArrow=True)
    def chunks(t):
        return sheets.chunk_sheet_text(t, 300)

    return books.select("book", F.posexplode(chunks("text")).alias("chunk_index", "text"))


@query("""
    WITH c AS (SELECT DISTINCT chunk_id, convert_id, chunk_index, text FROM chunks WHERE convert_id IS NOT NULL AND text IS NOT NULL AND chunk_index IS NOT NULL),
    n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY convert_id) AS n FROM c WINDOW w AS (PARTITION BY convert_id ORDER BY chunk_index, text))
    SELECT convert_id, '---' || chr(10) || 'total_chunks: ' || any_value(n) || chr(10) || 'source_file: ' || convert_id || chr(10) || '---' || chr(10) || chr(10)
        || string_agg('## Chunk ' || i || '/' || n || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) || chr(10) AS markdown FROM n GROUP BY convert_id""")
def markdown_sink(spark, sf):
    """The chunks of each record as one Markdown document."""
    c = table(spark, sf, "chunks").filter(F.col("convert_id").isNotNull() & F.col("text").isNotNull() & F.col("chunk_index").isNotNull()).select("chunk_id", "convert_id", "chunk_index", "text")
    return sinks.markdown_documents(once(c, ["chunk_id"]).drop("chunk_id"), "convert_id")


# geometry: cells of a grid stand for the elements of a page


def _elements(spark, sf):
    c = _cells(spark, sf).filter(F.col("bbox").isNotNull() & F.col("text").isNotNull())
    return c.select(F.col("grid_key").alias("doc_id"), F.lit(1).alias("page_no"), F.col("cell_id").alias("seq"), F.lit("text").alias("kind"), F.col("text").alias("content"), "bbox.*")


@query("WITH " + _G + " SELECT grid_key AS doc_id, string_agg(text, chr(10) ORDER BY bbox.y0, bbox.x0, cell_id) AS text FROM g WHERE bbox IS NOT NULL AND text IS NOT NULL AND text != '' GROUP BY grid_key")
def reading_order(spark, sf):
    return geometry.reading_order(_elements(spark, sf)).select("doc_id", "text")


@query("WITH " + _G + ", s AS (SELECT grid_key, bbox.x0 - lag(bbox.x0) OVER (PARTITION BY grid_key ORDER BY bbox.x0) AS step FROM g WHERE bbox IS NOT NULL AND text IS NOT NULL) SELECT grid_key AS doc_id, CAST(count(*) FILTER (step >= 50) + 1 AS BIGINT) AS columns FROM s GROUP BY grid_key")
def column_count(spark, sf):
    return geometry.column_count(_elements(spark, sf)).select("doc_id", "columns")


_SCORE = """
    WITH d AS (SELECT l_orderkey, sum(l_linenumber) AS items, count(*) AS drawings, count(*) FILTER (l_returnflag = 'R') AS fills, sum(l_linenumber) FILTER (l_linestatus = 'O') AS curves, count(DISTINCT l_suppkey % 9) AS columns, avg(l_discount) AS bad FROM lineitem GROUP BY l_orderkey),
    f AS (SELECT l_orderkey, least(1.0, CASE WHEN items / 500.0 >= 5 THEN 1.0 WHEN items / 500.0 >= 2 THEN 0.7 WHEN items / 500.0 >= 0.5 THEN 0.4 ELSE items / 500.0 / 0.5 * 0.4 END + coalesce(curves, 0) / items * 0.2 + fills / drawings * 0.1) AS drawing,
        CASE WHEN columns >= 7 THEN 0.95 WHEN columns >= 5 THEN 0.75 WHEN columns >= 3 THEN 0.5 WHEN columns >= 2 THEN 0.3 ELSE 0.0 END AS layout, 1 - bad * 5 AS quality FROM d),
    s AS (SELECT *, CASE WHEN layout >= 0.95 THEN 0.9 ELSE least(1.0, drawing * 0.3 + (1 - quality) * 0.25 + layout * 0.25) END AS score FROM f),
    l AS (SELECT *, CASE WHEN score >= 0.9 THEN 'EXTREME' WHEN score >= 0.65 THEN 'COMPLEX' WHEN score >= 0.35 THEN 'MODERATE' ELSE 'SIMPLE' END AS level FROM s)"""


@query(_SCORE + " SELECT l_orderkey, CAST(floor(score * 10000 + 0.500001) AS BIGINT) AS score, level, CASE WHEN quality < 0.4 OR (level = 'EXTREME' AND quality < 0.6) THEN 'FULL_PAGE_OCR' WHEN level IN ('COMPLEX', 'MODERATE') THEN 'HYBRID' ELSE 'TEXT_EXTRACTION' END AS strategy FROM l")
def page_complexity(spark, sf):
    """Orders stand for pages of 500 000 square points, their lines for drawings."""
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_linenumber").alias("items"), F.count("*").alias("drawings"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("fills"),
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))), F.lit(0)).alias("curves"), F.countDistinct(F.col("l_suppkey") % 9).alias("columns"), F.avg("l_discount").alias("bad"),
    )
    quality = 1 - F.col("bad") * 5
    drawing = geometry.drawing_score(F.col("items"), F.col("curves"), F.col("drawings"), F.col("fills"), F.lit(500_000.0))
    layout = geometry.layout_score(F.col("columns"), F.lit(0), F.lit(0))
    s = d.withColumn("score", geometry.complexity(drawing, F.lit(0.0), quality, layout)).withColumn("level", geometry.level(F.col("score")))
    return s.select("l_orderkey", F.floor(F.col("score") * 10000 + 0.500001).alias("score"), "level", geometry.strategy(F.col("level"), quality, F.lit(0.0)).alias("strategy"))


@query("WITH " + _G + ", f AS (SELECT grid_key, row_no, col_no, cell_id, text FROM g WHERE col_no = 0 OR col_no = 1) SELECT cell_id, last_value(nullif(trim(text), '') IGNORE NULLS) OVER (PARTITION BY grid_key, col_no ORDER BY row_no, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM f")
def continue_category(spark, sf):
    """The first columns of each grid, blanks filled from above."""
    c = _cells(spark, sf).filter(F.col("col_no").isin(0, 1)).select(F.col("grid_key").alias("doc_id"), F.col("col_no").alias("table_id"), F.col("row_no").alias("page_no"), F.col("cell_id").alias("row_no"), "cell_id", F.trim("text").alias("category"))
    return geometry.continue_category(c).select("cell_id", "category")


@query("WITH " + _G + " SELECT grid_key AS sheet, min(row_no) AS min_row, min(col_no) AS min_col, max(row_no) AS max_row, max(col_no) AS max_col, 0::BIGINT AS left_out FROM g WHERE trim(coalesce(text, '')) != '' GROUP BY grid_key")
def used_range(spark, sf):
    c = _cells(spark, sf).select(F.col("grid_key").alias("sheet"), F.col("row_no").alias("row"), F.col("col_no").alias("col"), F.col("text").alias("value"))
    return grids.used_range(c)


@query()
def table_regions(spark, sf):
    """Connected groups of filled cells of each grid, merged to tables."""
    c = _cells(spark, sf).select(F.col("grid_key").alias("sheet"), F.col("row_no").alias("row"), F.col("col_no").alias("col"), F.col("text").alias("value"), F.col("is_header").alias("bordered"))
    return grids.table_regions(c)


@query("""
    WITH b AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, coalesce(text, '') AS t FROM documents)
    SELECT source, count(*) AS pages, CAST(sum(length(t)) AS BIGINT) AS characters, max(length(t)) AS longest FROM b GROUP BY source""")
def pages_per_source(spark, sf):
    """Documents as the pages of their source: counts and sizes without gathering the pages."""
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, sf).groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.length(t)).alias("characters"), F.max(F.length(t)).cast("long").alias("longest"))



def _boxes(spark, sf):
    """Tables of a page: each grid cell's box, its row number as the number of columns."""
    c = _cells(spark, sf).filter(F.col("bbox").isNotNull())
    return c.select(F.col("grid_key").alias("doc_id"), F.lit(1).alias("page_no"), "cell_id", (F.col("col_no") % 3).alias("columns"), "bbox.*")


@query("WITH " + _G + """, b AS (SELECT grid_key, cell_id, col_no % 3 AS columns, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM g WHERE bbox IS NOT NULL),
    l AS (SELECT *, lag(x0) OVER w AS ax0, lag(x1) OVER w AS ax1, lag(y1) OVER w AS ay1, lag(columns) OVER w AS ac FROM b WINDOW w AS (PARTITION BY grid_key ORDER BY y0, x0, cell_id)),
    n AS (SELECT *, CASE WHEN coalesce(y0 - ay1 BETWEEN 0 AND 30 AND least(x1, ax1) - greatest(x0, ax0) >= 0.8 * least(x1 - x0, ax1 - ax0) AND ac = columns, false) THEN 0 ELSE 1 END AS opens FROM l)
    SELECT cell_id, CAST(sum(opens) OVER (PARTITION BY grid_key ORDER BY y0, x0, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM n""")
def adjacent_tables(spark, sf):
    return geometry.adjacent_tables(_boxes(spark, sf), order=["y0", "x0", "cell_id"]).select("cell_id", "run")


@query("WITH " + _G + """, b AS (SELECT grid_key, cell_id, bbox.y0 AS y0, bbox.y1 AS y1 FROM g WHERE bbox IS NOT NULL), p AS (SELECT grid_key, max(y1) AS height FROM b GROUP BY grid_key)
    SELECT cell_id, CASE WHEN y1 - y0 <= 60 AND y1 <= height * 0.1 THEN 'header' WHEN y1 - y0 <= 60 AND y0 >= height * 0.9 THEN 'footer' ELSE 'body' END AS zone FROM b JOIN p USING (grid_key)""")
def header_footer(spark, sf):
    b = _boxes(spark, sf)
    p = b.groupBy("doc_id", "page_no").agg(F.max("y1").alias("height"), F.max("x1").alias("width"))
    return geometry.header_footer(b, p).select("cell_id", "zone")


@query("WITH " + _G + """, b AS (SELECT grid_key, bbox.y0 AS y FROM g WHERE bbox IS NOT NULL), s AS (SELECT grid_key, y, CASE WHEN coalesce(y - lag(y) OVER (PARTITION BY grid_key ORDER BY y), 1e9) > 3 THEN 1 ELSE 0 END AS opens FROM b),
    c AS (SELECT grid_key, y, sum(opens) OVER (PARTITION BY grid_key ORDER BY y) AS k FROM s)
    SELECT grid_key AS doc_id, count(*) AS lines, CAST(floor(avg(y) * 100 + 0.500001) AS BIGINT) AS position FROM c GROUP BY grid_key, k""")
def line_positions(spark, sf):
    d = geometry.line_positions(_boxes(spark, sf))
    return d.select("doc_id", "lines", F.floor(F.col("position") * 100 + 0.500001).alias("position"))


@query("WITH " + _G + """, b AS (SELECT grid_key, cell_id, is_header, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM g WHERE bbox IS NOT NULL)
    SELECT a.cell_id FROM b a WHERE NOT coalesce(a.is_header, false) AND NOT EXISTS (SELECT 1 FROM b t WHERE coalesce(t.is_header, false) AND t.grid_key = a.grid_key
      AND CASE WHEN (a.x1 - a.x0) * (a.y1 - a.y0) > 0 THEN greatest(0, least(a.x1, t.x1) - greatest(a.x0, t.x0)) * greatest(0, least(a.y1, t.y1) - greatest(a.y0, t.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) ELSE 0 END > 0.01)""")
def text_outside_tables(spark, sf):
    """Boxes that no header box of their grid overlaps by a hundredth."""
    c = _cells(spark, sf).filter(F.col("bbox").isNotNull()).select(F.col("grid_key").alias("doc_id"), F.lit(1).alias("page_no"), "cell_id", F.coalesce("is_header", F.lit(False)).alias("h"), "bbox.*")
    return geometry.text_outside_tables(c.filter(~F.col("h")), c.filter("h"), 0.01).select("cell_id")


@query("WITH " + _C + f""", x AS (SELECT csv_id, rows, len(rows) AS n, list_max(list_transform(rows, lambda r: len(r))) AS width FROM c WHERE len(rows) > 0),
    j AS (SELECT csv_id, rows, width, list_transform(range(1, width + 1), lambda i: len(list_filter(rows, lambda r: trim(coalesce(r[i], '')) = '')) >= 0.9 * n) AS sparse FROM x)
    SELECT csv_id, CAST(greatest(1, width - len(list_filter(sparse, lambda s: s))) AS BIGINT) AS columns FROM j""")
def merge_sparse_columns(spark, sf):
    d = _csv(spark, sf).filter(F.size("rows") > 0)
    return d.select("csv_id", F.size(F.get(geometry.merge_sparse_columns(F.col("rows")), 0)).cast("long").alias("columns"))


@query("WITH " + _C + f""", x AS (SELECT csv_id, rows, list_transform(flatten(rows), lambda v: trim(coalesce(v, ''))) AS cells FROM c),
    f AS (SELECT csv_id, len(rows) AS n, list_max(list_transform(rows, lambda r: len(r))) AS width, len(cells) AS total, len(list_filter(cells, lambda v: v != '')) AS filled, len(list_filter(cells, lambda v: length(v) >= 2)) AS meaningful, len(list_filter(rows, lambda r: len(list_filter(r, lambda v: trim(coalesce(v, '')) != '')) > 0)) AS valid FROM x),
    d AS (SELECT *, CASE WHEN total > 0 THEN filled / total ELSE 1.0 END AS density FROM f)
    SELECT csv_id, CAST(floor(greatest(0.0, least(1.0, 0.6 + CASE WHEN n >= 2 THEN 0.1 ELSE 0 END + CASE WHEN width >= 2 THEN 0.1 ELSE 0 END + CASE WHEN density < 0.05 THEN -0.2 WHEN density < 0.1 THEN -0.1 ELSE density * 0.15 END - CASE WHEN meaningful < 2 THEN 0.1 ELSE 0 END - CASE WHEN valid <= 1 THEN 0.1 ELSE 0 END)) * 10000 + 0.500001) AS BIGINT) AS confidence FROM d""")
def table_confidence(spark, sf):
    return _csv(spark, sf).select("csv_id", F.floor(geometry.native_confidence(F.col("rows"), F.lit(False)) * 10000 + 0.500001).alias("confidence"))


@query("WITH " + _C + """, x AS (SELECT csv_id, array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda v: coalesce(v, '')), chr(9))), chr(10)) AS text, array_to_string(list_transform(list_filter(rows, lambda r: r[1] IS NOT NULL), lambda r: r[1]), chr(10)) AS first_column FROM c) SELECT * FROM x""")
def table_text(spark, sf):
    return _csv(spark, sf).select("csv_id", csv_tables.table_text(F.col("rows")).alias("text"), csv_tables.single_column_text(F.col("rows")).alias("first_column"))


@query("""SELECT p_brand, p_partkey // 1000 AS block, ';' AS delimiter, 'key,name,type,size' || chr(10) || string_agg(p_partkey || ',' || p_name || ',' || p_type || ',' || p_size, chr(10) ORDER BY p_partkey::VARCHAR || ';') AS cells FROM part GROUP BY ALL""")
def csv_parse(spark, sf):
    """Parts of a brand and thousand of keys written as a delimited file with quoted fields, sniffed and parsed again."""
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(';"'), "p_name", F.lit('";'), "p_type", F.lit(";"), F.col("p_size").cast("string"))
    files = table(spark, sf, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("block")).agg(F.concat(F.lit("key;name;type;size\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("content"))
    d = files.withColumn("delimiter", csv_tables.sniff_delimiter("content"))
    cells = F.array_join(F.transform(csv_tables.parse_text("content", "delimiter"), lambda r: F.array_join(r, ",")), "\n")
    return d.select("p_brand", "block", "delimiter", cells.alias("cells"))


@query("SELECT doc_id, true AS covered, 0 AS too_long FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^" + SP + "]')")
def code_split(spark, sf):
    """The same invariants for the separators of a language."""

    @F.udf("struct<covered boolean, too_long int>", useArrow=True)
    def checked(t):
        chunks = splitter.split_code(t, "py", 500, 50)
        seen = iter("".join("".join(chunks).split()))
        return all(c in seen for c in "".join(t.split())), sum(len(c) > 500 for c in chunks)

    d = _docs(spark, sf).filter(F.col("text").rlike(f"[^{SP}]"))
    return d.select("doc_id", checked("text").alias("c")).select("doc_id", "c.*")


@query("WITH " + _R + r" SELECT convert_id, CAST(abs(len(regexp_extract_all(text, '(?i)<table[^>]*>')) - len(regexp_extract_all(text, '(?i)</table>'))) AS BIGINT) AS unbalanced FROM r")
def block_integrity(spark, sf):
    return _converted(spark, sf).select("convert_id", tags.unbalanced(F.col("text")).cast("long").alias("unbalanced"))


@query("WITH " + _R + " SELECT convert_id, strpos(text, substr(text, (length(text) // 3) + 1, length(text) // 3)) - 1 AS place FROM r WHERE length(text) >= 20")
def find_chunk_position(spark, sf):
    """Where the middle third of each text is first found in it."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    d = _converted(spark, sf).filter(n >= 20).withColumn("chunk", F.substr("text", third + 1, third))
    return d.select("convert_id", text.find_chunk_position(F.col("chunk"), F.col("text"), F.lit(0)).cast("long").alias("place"))