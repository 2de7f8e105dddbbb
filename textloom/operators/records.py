"""Rows that fail to parse: typed records beside rejects with a located reason.

Each raw record is read by the grammar of `record_grammar` with the delimiter and layout of its source.
Reasons, the first that applies: `quoting`, `column_count`, `value`.

Defined cases
    * null raw records count as empty; empty records, records of spaces only and the header (record 1 of a
      source with a header) are neither records nor rejects;
    * a source without delimiter takes the one that cuts its first record into as many fields as its layout has
      columns, comma if none does; names (comma, tab, ...) and escapes (\\t) are understood;
    * a record whose source or layout is unknown is only checked for quoting;
    * redelivered sources and records carry equal values and are listed once;
    * an empty table gives no rows; further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.once import once
from textloom.operators.record_grammar import RecordGrammar, check_values, grammar

FORMAT_ROWS = 500_000  # sources up to which their formats (some 100 bytes each) may be broadcast; beyond, the join shuffles

# fixed values: delimiters by name
DELIMITER_NAMES = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|", "colon": ":", "space": " ", "\\t": "\t", "\\x09": "\t", "\\x2c": ",", "\\x3b": ";", "\\x7c": "|", "vertical bar": "|", "bar": "|", "tabulator": "\t"}
CANDIDATES = [",", ";", "\t", "|"]

OUTCOME = T.StructType([T.StructField("reason", T.StringType()), T.StructField("column", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType()))])


def delimiter_of(name: Column) -> Column:
    """The delimiter character that a label means, null if it says nothing."""
    known = F.create_map(*[F.lit(x) for pair in DELIMITER_NAMES.items() for x in pair])
    plain = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(known, plain), F.when(F.length(name) == 1, name))


def layouts_as_text(layouts: DataFrame) -> DataFrame:
    """(layout_id, columns, layout, names): the kinds of a layout's columns in order, `!` where one is required, as one short
    text which the grammar caches by value, and their names."""
    cols = F.sort_array(F.collect_set(F.struct("col_index", "value_type", F.coalesce("required", F.lit(False)).alias("required"), "col_name")))
    text = F.array_join(F.transform("cols", lambda x: F.concat(F.coalesce(x["value_type"], F.lit("text")), F.when(x["required"], "!").otherwise(""))), " ")
    return layouts.groupBy("layout_id").agg(cols.alias("cols")).select("layout_id", F.size("cols").alias("columns"), text.alias("layout"), F.transform("cols", lambda x: x["col_name"]).alias("names"))


def typed_columns(fields: Column, layout: Column, names: Column) -> Column:
    """array<struct<name, integer, decimal, date, flag, text>>: each field in the column of its kind, trimmed; the others
    are null, and all of them where the field is empty. A decimal that its column cannot hold exactly (more than 26 digits before
    the point, or 12 after it) keeps its text beside it."""
    kinds = F.transform(F.split(layout, " "), lambda k: F.regexp_replace(k, "!", ""))

    def typed(z: Column) -> Column:
        value = F.nullif(F.trim(z["field"]), F.lit(""))

        def of(kind: str, made: Column) -> Column:
            return F.when(z["kind"] == kind, made)

        decimal = value.try_cast("decimal(38,12)")
        inexact = (z["kind"] == "decimal") & (decimal.isNull() | value.rlike(r"\.[0-9]{12}[0-9]*[1-9]"))

        return F.struct(
            z["name"].alias("name"), of("integer", value.try_cast("bigint")).alias("integer"), of("decimal", decimal).alias("decimal"),
            of("date", F.try_to_date(value, "yyyy-MM-dd")).alias("date"), of("flag", value == "Y").alias("flag"), F.when(~z["kind"].isin("integer", "decimal", "date", "flag") | inexact, value).alias("text"),
        )

    return F.transform(F.arrays_zip(fields.alias("field"), kinds.alias("kind"), names.alias("name")), typed)


def _shown_delimiter(first: Column, columns: Column) -> Column:
    """The candidate that cuts a source's first record into the layout's number of fields."""
    picked = None
    for d in CANDIDATES:
        fits = F.size(F.split(first, "\\" + d if d == "|" else d)) == columns
        picked = F.when(fits, d) if picked is None else picked.when(fits, d)
    return F.coalesce(picked, F.lit(","))


def source_formats(sources: DataFrame, layouts: DataFrame, records: DataFrame) -> DataFrame:
    """(csv_id, has_header, delimiter, layout, names) of each source, once."""
    distinct = sources.select("csv_id", delimiter_of(F.col("delimiter")).alias("delimiter"), F.coalesce("has_header", F.lit(False)).alias("has_header"), "layout_id").dropDuplicates(["csv_id"])
    formats = distinct.join(layouts_as_text(layouts), "layout_id", "left").drop("layout_id")
    unnamed = formats.filter(F.col("delimiter").isNull()).select("csv_id")
    first = records.filter(F.col("record_no") == 1).join(unnamed, "csv_id", "left_semi").groupBy("csv_id").agg(F.min("raw_record").alias("first"))
    return formats.join(first, "csv_id", "left").select("csv_id", "has_header", F.coalesce("delimiter", _shown_delimiter(F.col("first"), F.col("columns"))).alias("delimiter"), "layout", "names")


def _parse_batches(with_fields: bool):
    @F.pandas_udf(OUTCOME)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        specs: dict[str | None, tuple] = {}
        for raw, delimiter, layout in batches:
            rows = []
            for text, d, spec in zip(raw, delimiter, layout):
                if spec not in specs:
                    cols = (spec or "").split(" ") if spec else None
                    specs[spec] = (None, [], []) if cols is None else (len(cols), [c.rstrip("!") for c in cols], [c.endswith("!") for c in cols])
                width, kinds, required = specs[spec]
                rec = grammar(d, width).record(text)
                reason = column = offset = None
                if rec.issues:
                    reason, column, offset = "quoting", rec.issues[0].column, rec.issues[0].offset
                elif width is not None and len(rec.fields) != width:
                    reason, column, offset = "column_count", min(width, len(rec.fields)), len(text)
                elif width is not None and (bad := check_values(rec.fields, kinds, required)) is not None:
                    reason, column = "value", bad
                rows.append((reason, column, offset, rec.fields if with_fields and reason is None else None))
            out = pd.DataFrame(rows, columns=["reason", "column", "offset", "fields"])
            yield out.astype({"column": "Int32", "offset": "Int32"})

    return parse


FILE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("fault", T.StringType()), T.StructField("offset", T.IntegerType())]))


@F.pandas_udf(FILE)
def parse_file(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The records of a whole file (text, delimiter, columns), each with where it stands and its first syntax error. Behind an
    error the grammar takes up again at the next line start from which a whole record of that many columns parses. Null text
    gives null; without columns any sound record is an anchor."""
    for texts, delimiters, widths in batches:
        out = []
        for text, d, width in zip(texts, delimiters, widths):
            if text is None:
                out.append(None)
                continue
            found = RecordGrammar(d or ",", None if pd.isna(width) else int(width)).file(text)
            out.append([{"start": r.start, "end": r.end, "fields": r.fields, "fault": r.issues[0].message if r.issues else None, "offset": r.issues[0].offset if r.issues else None} for r in found])
        yield pd.Series(out, dtype=object)


def read_records(records: DataFrame, sources: DataFrame, layouts: DataFrame, with_fields: bool = True) -> DataFrame:
    """(record_id, csv_id, record_no, layout, names, outcome): each data record with its fields, or with the reason, column
    and offset of its failure. The formats are broadcast if there are at most `FORMAT_ROWS` sources by count, so that no record
    moves; else both sides are shuffled on the source's key, and hot sources are split (AQE skew join)."""
    formats = source_formats(sources, layouts, records)
    if sources.limit(FORMAT_ROWS + 1).count() <= FORMAT_ROWS:
        formats = F.broadcast(formats)
    data = records.filter(~F.coalesce("raw_record", F.lit("")).rlike(r"^[ \r\n]*$")).select("record_id", "csv_id", "record_no", "raw_record")
    joined = data.join(formats, "csv_id", "left").filter(~(F.coalesce("has_header", F.lit(False)) & F.col("record_no").eqNullSafe(1)))
    outcome = _parse_batches(with_fields)("raw_record", F.coalesce("delimiter", F.lit(",")), "layout")
    return joined.select("record_id", "csv_id", "record_no", "layout", "names", outcome.alias("outcome"))


def typed_records(records: DataFrame, sources: DataFrame, layouts: DataFrame) -> DataFrame:
    """(record_id, csv_id, record_no, columns) of each valid record, once."""
    valid = read_records(once(records, ["record_id"]), sources, layouts).filter(F.col("outcome.reason").isNull())
    return valid.select("record_id", "csv_id", "record_no", typed_columns(F.col("outcome.fields"), F.col("layout"), F.col("names")).alias("columns"))


def rejects(records: DataFrame, sources: DataFrame, layouts: DataFrame) -> DataFrame:
    """(record_id, reason) of each failing record, once."""
    read = read_records(records, sources, layouts, with_fields=False)
    return read.select("record_id", F.col("outcome.reason").alias("reason")).filter(F.col("reason").isNotNull()).distinct()
