"""Queries of the general data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.once import once
from textloom.operators import records, timestamps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.saved_before_created(table(spark, sf_dir, "document_metadata"))


def p2_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's two instants and the forms they were read in."""
    metadata = table(spark, sf_dir, "document_metadata").select("meta_id", "create_time", "last_saved_time", "locale", "source_zone")
    times = timestamps.normalise_times(once(metadata, ["meta_id"]), ["create_time", "last_saved_time"])
    return times.select("meta_id", "create_time_utc", "create_time_form", "last_saved_time_utc", "last_saved_time_form")


def _csv(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("csv_records", "csv_source_info", "csv_layouts")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rejects(*_csv(spark, sf_dir))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records, each once, as the typed columns of their layout."""
    return records.typed_records(*_csv(spark, sf_dir))


def p5_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows at the start of each source, written as a file of quoted fields in which the second record lacks its last quote:
    how many records are read, how many with a fault, and where the grammar took up again."""
    rows = F.transform("parsed_rows", lambda r: F.concat(F.lit('"'), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""'))), '";"'), F.lit('"')))
    sources = once(table(spark, sf_dir, "csv_source_info").select("csv_id", "parsed_rows"), ["csv_id"]).filter((F.size("parsed_rows") >= 3) & F.forall("parsed_rows", lambda r: F.size(r) == F.size(F.get("parsed_rows", 0))) & (F.size(F.get("parsed_rows", 0)) >= 2))
    lines = sources.select("csv_id", F.size(F.get("parsed_rows", 0)).alias("width"), rows.alias("lines"))
    broken = F.transform("lines", lambda x, i: F.when(i == 1, F.expr("substring(lines[1], 1, length(lines[1]) - 1)")).otherwise(x))
    files = lines.select("csv_id", records.parse_file(F.array_join(broken, "\n"), F.lit(";"), F.col("width")).alias("f"))
    resumed = F.get(F.col("f"), 2)["start"]
    return files.select("csv_id", F.size("f").cast("long").alias("records"), F.size(F.filter("f", lambda r: r["fault"].isNotNull())).cast("long").alias("faults"), resumed.cast("long").alias("resumed_at"))


QUERIES = {"p2_found": p2_found, "p2_instants": p2_instants, "p5_found": p5_found, "p5_records": p5_records, "p5_recovered": p5_recovered}


def _p5_sql() -> str:
    """The rules of p5_found in SQL, one branch a delimiter so that every pattern is a constant."""
    marks = [(",", ","), (";", ";"), ("|", "\\|"), ("\t", "\\t")]
    sound, fields = [], []
    for d, e in marks:
        char = f"chr({ord(d)})"
        one = f'("(?:[^"]|"")*"|[^"{e}]*)'
        sound.append(f"WHEN d = {char} THEN regexp_full_match(t, '{one}(?:{e}{one})*')")
        fields.append(f"WHEN d = {char} THEN regexp_extract_all(t || {char}, '{one}{e}', 1)")
    widths = " ".join(f"WHEN length(f.t) - length(replace(f.t, chr({ord(d)}), '')) + 1 = l.n THEN chr({ord(d)})" for d in ",;\t|")
    return f"""
    WITH l AS (SELECT layout_id, count(*) AS n, list(value_type ORDER BY col_index) AS kinds, list(required ORDER BY col_index) AS needed FROM csv_layouts GROUP BY layout_id),
    f AS (SELECT csv_id, min(raw_record) AS t FROM csv_records WHERE record_no = 1 GROUP BY csv_id),
    s AS (SELECT DISTINCT csv_id, has_header, layout_id, CASE lower(trim(delimiter, ' ')) WHEN 'comma' THEN ',' WHEN 'semicolon' THEN ';' WHEN 'pipe' THEN '|' WHEN 'tab' THEN chr(9) WHEN '\\t' THEN chr(9) ELSE delimiter END AS d FROM csv_source_info),
    o AS (SELECT s.csv_id, has_header, l.n, kinds, needed, coalesce(s.d, CASE {widths} ELSE ',' END) AS d FROM s JOIN l USING (layout_id) LEFT JOIN f USING (csv_id)),
    r AS (SELECT DISTINCT record_id, raw_record AS t, o.* FROM csv_records JOIN o USING (csv_id) WHERE NOT regexp_full_match(coalesce(raw_record, ''), '[ \r\n]*') AND NOT (has_header AND record_no = 1)),
    q AS (SELECT *, CASE {" ".join(sound)} END AS sound, CASE {" ".join(fields)} END AS fields FROM r),
    v AS (SELECT *, list_transform(fields, lambda x: trim(CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) AS v FROM q),
    w AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN v[i] = '' THEN NOT needed[i] WHEN kinds[i] = 'integer' THEN regexp_full_match(v[i], '[+-]?[0-9]+') AND try_cast(v[i] AS BIGINT) IS NOT NULL
        WHEN kinds[i] = 'decimal' THEN regexp_full_match(v[i], '[+-]?[0-9]+(\\.[0-9]+)?') WHEN kinds[i] = 'date' THEN regexp_full_match(v[i], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(v[i] AS DATE) IS NOT NULL
        WHEN kinds[i] = 'flag' THEN v[i] IN ('Y', 'N') ELSE true END) AS fits FROM v),
    x AS (SELECT record_id, CASE WHEN NOT sound THEN 'quoting' WHEN len(fields) != n THEN 'column_count' WHEN NOT list_bool_and(fits) THEN 'value' END AS reason FROM w)
    SELECT record_id, reason FROM x WHERE reason IS NOT NULL"""


_P5_RECOVERED = """
    WITH s AS (SELECT csv_id, any_value(parsed_rows) AS rows FROM csv_source_info WHERE parsed_rows IS NOT NULL GROUP BY csv_id),
    l AS (SELECT csv_id, rows, list_transform(rows, lambda r: '"' || array_to_string(list_transform(r, lambda c: replace(coalesce(c, ''), '"', '""')), '";"') || '"') AS lines FROM s
        WHERE len(rows) >= 3 AND len(rows[1]) >= 2 AND len(list_filter(rows, lambda r: len(r) = len(rows[1]))) = len(rows))
    SELECT csv_id, len(lines) AS records, 1::BIGINT AS faults, length(lines[1]) + length(lines[2]) + 1 AS resumed_at FROM l"""

SQL: dict[str, str] = {"p5_found": _p5_sql(), "p5_recovered": _P5_RECOVERED}
