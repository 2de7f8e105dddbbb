"""Mixed timestamp formats and time zones to UTC instants.

An ordered cascade of anchored patterns rewrites each time to one canonical reading
`year|month|day|hour|minute|second|fraction|half|zone`, which is then parsed strictly; wall clock times
take the zone of a lookup column. Everything is a Catalyst expression, so the operator is a projection:
no shuffle, no Python, any number of rows.

Policy
    * an offset, Z, zone name, abbreviation or an absolute count speaks for itself;
    * any other value is wall clock time in the zone column, and null if that is null or unknown;
    * wall clock times skipped or repeated by a clock change take the offset in force before the change;
    * missing, placeholder and impossible values (30 February, 24:01, month 13) are null;
    * more than six fraction digits are cut, never rounded up;
    * null text, empty text and very long text give null; repeated rows are each converted alike;
    * an empty table gives an empty table with the added columns; other columns pass through untouched,
      and an input column that already has the name of an output column is replaced.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.lets import let
from textloom.functions.zones import ABBREVIATIONS, region_names

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONGEST = 96  # no timestamp of any form is longer without the blanks around it; longer values are rejected before a pattern runs

_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?"
_ZONE = r"(?:\s*(Z|z|[+-][0-9]{2}(?::?'?[0-9]{2}'?)?|[A-Z]{2,5}|\[[A-Za-z0-9_+/-]+\])(?:\[[A-Za-z0-9_+/-]+\])?)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_WEEKDAY = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
_YEAR = r"([0-9]{4}|[0-9]{2})"

# name, pattern, canonical reading
FORMS = [
    ("iso", r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[T ]\s*" + _CLOCK + _ZONE + ")?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact", r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:T?([0-9]{2})([0-9]{2})([0-9]{2})?(?:[.,]([0-9]{1,9}))?" + _ZONE + ")?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("pdf", r"^D:([0-9]{4})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})([0-9]{2})?)?)?)?)?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|||$7"),
    ("rtf", r"^\{?\\[a-z]+\\yr([0-9]{1,4})\\mo([0-9]{1,2})\\dy([0-9]{1,2})(?:\\hr([0-9]{1,2}))?(?:\\min([0-9]{1,2}))?(?:\\sec([0-9]{1,2}))?\s*\}?$", "$1|$2|$3|$4|$5|$6|||"),
    ("day_month", "^" + _WEEKDAY + r"([0-9]{1,2})[ -]([A-Za-z]{3,9})\.?[ -]" + _YEAR + r"(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_day", "^" + _WEEKDAY + r"([A-Za-z]{3,9})\.?\s+([0-9]{1,2}),?\s+([0-9]{4})(?:,?\s+(?:at\s+)?" + _CLOCK + _HALF + _ZONE + ")?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("dotted", r"^([0-9]{1,2})\.([0-9]{1,2})\." + _YEAR + r"(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("slashed_us", r"^([0-9]{1,2})/([0-9]{1,2})/" + _YEAR + r"(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("slashed", r"^([0-9]{1,2})/([0-9]{1,2})/" + _YEAR + r"(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("korean_am", r"^([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일\s*오전\s*" + _CLOCK + "$", "$1|$2|$3|$4|$5|$6|$7|a|"),
    ("korean_pm", r"^([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일\s*오후\s*" + _CLOCK + "$", "$1|$2|$3|$4|$5|$6|$7|p|"),
    ("korean", r"^([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일(?:\s*" + _CLOCK + ")?$", "$1|$2|$3|$4|$5|$6|$7||"),
]
# absolute counts and day numbers are told apart by their digits; compact readings have 8, 12 or 14
COUNTS = {"serial": r"^[0-9]{5}(?:\.[0-9]{1,10})?$", "unix_s": r"^[0-9]{9,10}$", "unix_ms": r"^[0-9]{13}$", "unix_us": r"^[0-9]{15,16}$", "filetime": r"^[0-9]{17,18}$"}


def _stripped(value: Column) -> Column:
    text = F.regexp_replace(value, r"^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$", "")
    return F.nullif(F.when(F.length(text) <= LONGEST, text), F.lit(""))


def _serial_reading(text: Column) -> Column:
    """Canonical reading of a spreadsheet day number: days since 1899-12-30, rounded to the second."""
    seconds = F.round(text.try_cast("decimal(20,10)") * 86400).cast("long")
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = seconds % 86400
    return F.concat_ws("|", F.date_format(day, "yyyy|MM|dd"), F.floor(rest / 3600).cast("int"), F.floor(rest % 3600 / 60).cast("int"), (rest % 60).cast("int"), F.lit("||"))


def _form(text: Column, locale: Column) -> Column:
    """Name of the first form whose pattern fits, null if none does."""
    chosen = None
    tries = [(n, p) for n, p in COUNTS.items()] + [(n, p) for n, p, _ in FORMS]
    for name, pattern in tries:
        fits = text.rlike(pattern)
        if name == "slashed_us":
            fits = fits & F.coalesce(locale == "en_US", F.lit(False))
        chosen = F.when(fits, name) if chosen is None else chosen.when(fits, name)
    return chosen


def _reading(text: Column, form: Column) -> Column:
    out = F.when(form == "serial", _serial_reading(text))
    for name, pattern, reading in FORMS:
        out = out.when(form == name, F.regexp_replace(text, pattern, reading))
    return F.split(out, r"\|")


def _absolute(text: Column, form: Column) -> Column:
    count = text.try_cast("long")
    ticks = count - F.lit(116444736000000000)
    return (
        F.when(form == "unix_s", F.timestamp_seconds(count))
        .when(form == "unix_ms", F.timestamp_millis(count))
        .when(form == "unix_us", F.timestamp_micros(count))
        .when(form == "filetime", F.timestamp_micros(((ticks - F.pmod(ticks, F.lit(10))) / 10).cast("long")))
    )


def _zone(mark: Column, default: Column) -> Column:
    """Zone of a time: the mark in the text if there is one, else the default; null where neither is known."""
    names = region_names()
    sign, digits = F.substring(mark, 1, 1), F.regexp_replace(F.substring(mark, 2, 8), "[:']", "")
    hours, minutes = F.substring(digits, 1, 2), F.when(F.length(digits) >= 4, F.substring(digits, 3, 2)).otherwise(F.lit("00"))
    abbreviations = F.create_map(*[F.lit(x) for x in chain(*ABBREVIATIONS.items())])
    name = F.when(mark == "", default).when(sign == "[", F.regexp_replace(mark, r"[\[\]]", ""))
    return (
        F.when((mark == "Z") | (mark == "z"), F.lit("+00:00"))
        .when(sign.isin("+", "-"), F.when((hours.try_cast("int") < 18) & (minutes.try_cast("int") < 60), F.concat(sign, hours, F.lit(":"), minutes)))
        .when(name.isNotNull(), F.when(name.isin(names), name))
        .otherwise(F.try_element_at(abbreviations, mark))
    )


def _wall(reading: Column, default_zone: Column) -> Column:
    """The instant of a canonical reading, null if it is impossible or of unknown zone."""

    def part(i: int) -> Column:
        return F.get(reading, i)

    def number(i: int, empty: int) -> Column:
        return F.when(part(i) == "", F.lit(empty)).otherwise(part(i).try_cast("int"))

    months = F.array(*[F.lit(m) for m in MONTHS])
    month = F.when(part(1).rlike("^[A-Za-z]"), F.array_position(months, F.lower(F.substring(part(1), 1, 3))).cast("int")).otherwise(number(1, 1))
    year = number(0, 0) + F.when(F.length(part(0)) == 2, 2000).otherwise(0)
    hour, half = number(3, 0), F.lower(part(7))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = number(5, 0)
    micros = F.substring(F.rpad(part(6), 6, "0"), 1, 6).try_cast("int")
    seconds = F.when(second < 60, (second + micros / 1_000_000).cast("decimal(16,6)"))
    return F.when((year >= 1) & (hour24 < 24), F.try_make_timestamp(year, month, number(2, 1), hour24, number(4, 0), seconds, _zone(part(8), default_zone)))


def read_time(value: Column, locale: Column, zone: Column) -> Column:
    """struct<instant timestamp, form string> of a time: the UTC instant, and the name of the form that
    was read (null where no instant is known). Every step is bound once: plain nesting would copy it into each use,
    and Catalyst's merging of projections does the same, until the generated code is too large to compile."""

    def of_text(text: Column) -> Column:
        return let(_form(text, locale), lambda form: of_form(text, form))

    def of_form(text: Column, form: Column) -> Column:
        wall = let(_reading(text, form), lambda reading: _wall(reading, zone))
        return let(F.coalesce(_absolute(text, form), wall), lambda made: F.struct(made.alias("instant"), F.when(made.isNotNull(), form).alias("form")))

    return let(_stripped(value), of_text)


def normalise_times(df: DataFrame, columns: list[str], locale: str = "locale", zone: str = "source_zone", suffix: str = "_utc", form_suffix: str = "_form") -> DataFrame:
    """Add for each column its instant `<column>_utc` and the name of the form that was read, `<column>_form`."""
    out = {}
    for c in columns:
        read = read_time(F.col(f"`{c}`"), F.col(f"`{locale}`"), F.col(f"`{zone}`"))
        out |= {c + suffix: read.getField("instant"), c + form_suffix: read.getField("form")}
    return df.withColumns(out)


def saved_before_created(df: DataFrame, key: str = "meta_id") -> DataFrame:
    """Keys of records whose last save lies before their creation, each once. Redelivered rows carry equal
    values, so the few keys that remain are made distinct, not the rows."""
    times = normalise_times(df, ["create_time", "last_saved_time"])
    return times.filter(F.col("last_saved_time_utc") < F.col("create_time_utc")).select(key).distinct()
