from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import records as R
from textloom.operators.record_grammar import RecordGrammar, check_values

SCHEMA = "record_id bigint, csv_id bigint, record_no int, raw_record string, reason string"
SOURCES = "csv_id bigint, delimiter string, has_header boolean, layout_id int, layout string"


def brute_reason(text, d, kinds, required):
    """The rules said once more, by hand."""
    fields, at = [], 0
    while True:
        if text.startswith('"', at):
            i = at + 1
            value = ""
            while True:
                if i >= len(text):
                    return "quoting"
                if text[i] == '"':
                    if text.startswith('"', i + 1):
                        value += '"'
                        i += 2
                        continue
                    break
                value += text[i]
                i += 1
            i += 1
            if i < len(text) and text[i] != d:
                return "quoting"
        else:
            i = text.find(d, at)
            i = len(text) if i < 0 else i
            value = text[at:i]
            if '"' in value:
                return "quoting"
        fields.append(value)
        if i >= len(text):
            break
        at = i + 1
    if len(fields) != len(kinds):
        return "column_count"
    return None if check_values(fields, kinds, required) is None else "value"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='a1",;\n -', max_size=14))
def test_grammar_against_brute_force(text):
    rec = RecordGrammar(",", 2, True).record(text)
    kinds, required = ["integer", "text"], [True, False]
    got = "quoting" if rec.issues else "column_count" if len(rec.fields) != 2 else None if check_values(rec.fields, kinds, required) is None else "value"
    assert got == brute_reason(text, ",", kinds, required)


def test_recovery_at_record_starts():
    g = RecordGrammar(",", 3)
    text = 'a,b,c\n1,"broken,2\nx,y\n3,4,5\n"q,\n1","",z\n'
    got = g.file(text)
    assert [r.fields for r in got if not r.issues] == [["a", "b", "c"], ["3", "4", "5"], ["q,\n1", "", "z"]]
    bad = [r for r in got if r.issues]
    assert len(bad) == 1 and text[bad[0].start : bad[0].end] == '1,"broken,2\nx,y' and bad[0].issues[0].column == 1
    assert g.file("") == []


def test_values():
    assert check_values([" 12 ", "1.5", "2020-02-29", "Y", ""], ["integer", "decimal", "date", "flag", "text"], [True] * 4 + [False]) is None
    for value, kind in (("１２", "integer"), ("9223372036854775808", "integer"), ("1e5", "decimal"), (".5", "decimal"), ("5.", "decimal"), ("2021-02-29", "date"), ("2021-2-1", "date"), ("y", "flag"), ("1 2", "integer"), ("9" * 100_000, "integer")):
        assert check_values([value], [kind], [False]) == 0
    assert check_values(["-9223372036854775808", "+7", "-0.5"], ["integer", "integer", "decimal"], [False] * 3) is None
    assert check_values([" "], ["text"], [True]) == 0 and check_values(["x"], ["unheard of"], [True]) is None


def test_rejects(spark):
    layouts = spark.createDataFrame([(1, 0, "integer", True), (1, 1, "text", None), (2, 0, "text", False)], "layout_id int, col_index int, value_type string, required boolean").selectExpr("*", "concat('c', col_index) AS col_name")
    sources = spark.createDataFrame([(1, "comma", True, 1, "x"), (1, "comma", True, 1, "x"), (2, None, True, 1, "x"), (3, "\\t", None, 1, "x"), (4, "|", False, None, "x")], SOURCES)
    rows = [
        (1, 1, 1, "n,t", "r"), (2, 1, 2, "5,x", "r"), (3, 1, 3, "5", "r"), (3, 1, 3, "5", "r"), (4, 1, 4, 'a"b,c', "r"), (5, 1, 5, "x,y", "r"), (6, 1, 6, "   ", "r"), (7, 1, 7, None, "r"), (8, 1, 8, "", "r"),
        (9, 2, 1, "n;t", "r"), (10, 2, 2, "1;x", "r"), (11, 2, 3, "1,x", "r"), (12, 3, 1, "1\tx", "r"), (13, 3, 2, "\t", "r"), (14, 4, 1, "any|thing", "r"), (15, 99, 1, '"', "r"), (16, None, None, "a,b", "r"), (17, 1, 9, "5," + "y" * 300_000, "r"),
    ]
    records = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, R.rejects(records, sources, layouts).collect())) == [(3, "column_count"), (4, "quoting"), (5, "value"), (11, "column_count"), (13, "value"), (15, "quoting")]
    good = {r["record_id"]: r["outcome"]["fields"] for r in R.read_records(records, sources, layouts).filter("outcome.reason IS NULL").collect()}
    assert good[2] == ["5", "x"] and good[10] == ["1", "x"] and good[12] == ["1", "x"] and 1 not in good and 6 not in good and 9 not in good
    typed = {r["record_id"]: r["columns"] for r in R.typed_records(records, sources, layouts).collect()}
    assert [tuple(c) for c in typed[2]] == [("c0", 5, None, None, None, None), ("c1", None, None, None, None, "x")] and len(typed) == len(good)
    assert R.rejects(records.limit(0), sources.limit(0), layouts.limit(0)).count() == 0


def test_typed_columns(spark):
    import datetime
    from decimal import Decimal

    df = spark.createDataFrame([([" 12 ", "-1.50", "2020-02-29", "N", " a b ", ""], "integer! decimal date flag text integer", ["a", "b", "c", "d", "e", "f"])], "fields array<string>, layout string, names array<string>")
    got = [tuple(c) for c in df.select(R.typed_columns(df.fields, df.layout, df.names)).first()[0]]
    assert got == [("a", 12, None, None, None, None), ("b", None, Decimal("-1.5"), None, None, None), ("c", None, None, datetime.date(2020, 2, 29), None, None), ("d", None, None, None, False, None), ("e", None, None, None, None, "a b"), ("f", None, None, None, None, None)]


def test_decimals_that_do_not_fit_keep_their_text(spark):
    from decimal import Decimal

    values = ["1" * 27, "-0." + "0" * 12 + "1", "1." + "5" * 12 + "000", "+" + "9" * 26 + ".5", "12"]
    df = spark.createDataFrame([(values, " ".join(["decimal"] * 5), list("abcde"))], "fields array<string>, layout string, names array<string>")
    got = [(x["decimal"], x["text"]) for x in df.select(R.typed_columns(df.fields, df.layout, df.names)).first()[0]]
    assert got == [(None, values[0]), (Decimal(0), values[1]), (Decimal("1." + "5" * 12), None), (Decimal("9" * 26 + ".5"), None), (Decimal(12), None)]


def test_file_is_read_beyond_a_broken_quote(spark):
    from pyspark.sql import functions as F

    from textloom.operators.csv_tables import parse
    from textloom.operators.records import parse_file

    text = 'a;b\n"one;1\n"two";2\n3;4'
    df = spark.createDataFrame([(1, text, ";", 2), (2, None, ";", 2), (3, "", None, None), (4, '"x;y', ";", None)], "i int, t string, d string, w int")
    got = {r["i"]: r["f"] for r in df.select("i", parse_file("t", F.col("d"), F.col("w")).alias("f")).collect()}
    assert [(r["start"], r["fault"] is not None) for r in got[1]] == [(0, False), (4, True), (11, False), (19, False)] and got[1][2]["fields"] == ["two", "2"]
    assert got[2] is None and got[3] == [] and len(got[4]) == 1 and got[4][0]["fault"]
    assert [r for r in parse(text, ";") if r[0] in ("two", "3")] == [["two", "2"], ["3", "4"]]
