"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.lets import let

# whitespace as Unicode has it, spelled out because engines disagree on \s
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# fixed values: extensions by category, in order of precedence
CATEGORIES = {
    "document": "pdf docx doc rtf pptx ppt hwp hwpx",
    "text": "txt md markdown",
    "code": "py js ts java cpp c h cs go rs php rb swift kt scala dart r sql html css jsx tsx vue svelte",
    "config": "json yaml yml xml toml ini cfg conf properties env",
    "data": "csv tsv xlsx xls",
    "script": "sh bat ps1 zsh fish",
    "log": "log",
    "web": "htm xhtml",
    "image": "jpg jpeg png gif bmp webp",
}
# fixed values: image types by extension, and display names of delimiters
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}
DELIMITER_LABELS = {",": "Comma (,)", "\t": "Tab (\\t)", ";": "Semicolon (;)", "|": "Pipe (|)"}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+\\z", "")


def clean_text(text: Column) -> Column:
    """Three or more line breaks, blanks between them or not, become two; both ends are stripped. Null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"\\n[{SPACE}]*\\n[{SPACE}]*\\n+", "\n\n"))


def clean_code_text(text: Column) -> Column:
    return F.replace(rstrip(F.coalesce(text, F.lit(""))), F.lit("\t"), F.lit("    "))


def sanitize_for_json(text: Column) -> Column:
    """Without private-use characters, noncharacters U+FFFE and U+FFFF, and controls but tab, line feed and return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{E000}-\x{F8FF}\x{FFFE}\x{FFFF}\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def word_ratio(text: Column) -> Column:
    """Share of word characters of any script."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]")) / F.greatest(F.lit(1), F.length(text))


def is_quality_sufficient(text: Column, min_chars: int = 500, min_ratio: float = 0.6) -> Column:
    return F.coalesce((F.length(text) >= min_chars) & (word_ratio(text) >= min_ratio), F.lit(False))


def text_quality(text: Column) -> Column:
    """struct<score, total, pua, replacement, controls, valid, needs_ocr>: how well text was extracted. Text under ten
    characters counts as good."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)

    def count(chars: str) -> Column:
        return F.regexp_count(t, F.lit(f"[{chars}]"))

    pua, lost, controls = count(r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"), count(r"\x{FFFD}"), count(r"\x00-\x1f\x7f-\x{9f}\x{FFF0}-\x{FFFC}\x{FFFE}\x{FFFF}")
    valid = count(r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}A-Za-z0-9 \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,!?;:'\"()\[\]{}\-–—…·•\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}")
    short = n < 10
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1.0 - 0.8 * pua / n - 0.9 * lost / n) * (0.5 + 0.5 * valid / n)))
    score = F.when(short, F.lit(1.0)).otherwise(score)

    def unless_short(c: Column) -> Column:
        return F.when(short, F.lit(0)).otherwise(c)

    return F.struct(
        score.alias("score"), n.alias("total"), unless_short(pua).alias("pua"), unless_short(lost).alias("replacement"), unless_short(controls).alias("controls"),
        F.when(short, n).otherwise(valid).alias("valid"), (~short & ((score < 0.7) | (pua / F.greatest(F.lit(1), n) >= 0.1))).alias("needs_ocr"),
    )


def estimate_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """0 for no text, 1 for text that fits, else by arithmetic."""
    n = F.length(F.coalesce(text, F.lit("")))
    steps = F.floor((n - overlap) / (size - overlap)) + 1
    return F.when(n == 0, F.lit(0)).when(n <= size, F.lit(1)).otherwise(F.greatest(F.lit(1), steps)).cast("int")


def find_chunk_position(chunk: Column, text: Column, start: Column) -> Column:
    """0-based place of a chunk in its text from `start` on: exact, else by its first line, else by its first fifty
    characters; -1 if there is none."""

    def find(needle: Column) -> Column:
        return F.when(F.length(needle) > 0, F.nullif(F.call_function("locate", needle, text, (start + 1).cast("int")), F.lit(0)) - 1)

    stripped = strip(chunk)
    first = F.get(F.split(stripped, "\n"), 0)
    by_line = F.when(F.length(first) >= 10, find(strip(first)))
    head = F.when(F.length(chunk) > 50, F.substring(chunk, 1, 50)).otherwise(chunk)
    closer = F.nullif(F.call_function("locate", head, text, (by_line + 1).cast("int")), F.lit(0)) - 1
    by_head = F.when(F.length(stripped) >= 10, find(F.substring(stripped, 1, 50)))
    return F.coalesce(find(chunk), F.when(by_line.isNotNull(), F.coalesce(closer, by_line)), by_head, F.lit(-1))


def line_starts(text: Column) -> Column:
    """0-based offsets of the lines; a line break at the very end opens no line."""

    def of(lines: Column) -> Column:
        n = F.size(lines)
        kept = F.when((n > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.greatest(n - 1, F.lit(1)))).otherwise(lines)
        before = F.transform(F.slice(kept, 1, F.size(kept)), lambda line: F.length(line) + 1)
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(before, start, lambda acc, n: F.struct(F.array_append(acc["out"], acc["at"]).alias("out"), (acc["at"] + n).alias("at")), lambda acc: acc["out"])

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), of)


def position_to_line(position: Column, starts: Column) -> Column:
    """1-based line of a position."""
    return let(position, lambda at: F.greatest(F.lit(1), F.size(F.filter(starts, lambda s: s <= at))))


def overlap_length(a: Column, b: Column, longest: Column) -> Column:
    """Longest suffix of a, up to `longest`, that is a prefix of b."""

    def of(m: Column) -> Column:
        first = F.substring(b, 1, 1)

        def in_tail(tail: Column) -> Column:
            # only where the first character agrees is a suffix cut out and compared
            return F.array_max(F.transform(F.regexp_extract_all(tail, F.lit("(?s)."), F.lit(0)), lambda c, i: F.when((c == first) & F.startswith(b, F.right(tail, m - i)), m - i)))

        return F.coalesce(let(F.right(a, m), in_tail), F.lit(0))

    return let(F.least(longest, F.length(a), F.length(b)), of)


def reconstruct(chunks: Column, overlap: int) -> Column:
    """The text that consecutive chunks cover, their real overlaps removed."""
    return F.aggregate(
        chunks,
        F.struct(F.lit("").alias("text"), F.lit("").alias("last")),
        lambda acc, c: F.struct(F.concat(acc["text"], F.when(acc["last"] == "", c).otherwise(F.substring(c, overlap_length(acc["last"], c, F.lit(overlap)) + 1, F.length(c)))).alias("text"), c.alias("last")),
        lambda acc: acc["text"],
    )


NUMERIC = [r"-?[0-9]+", r"-?[0-9]+\.[0-9]+", r"-?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?", r"-?[0-9]+%", r"\$-?[0-9]+(\.[0-9]+)?", r"₩-?[0-9]+(,[0-9]{3})*"]  # fixed values: forms that count as numbers


def is_numeric(value: Column) -> Column:
    return F.coalesce(strip(value).rlike("^(" + "|".join(NUMERIC) + r")\z"), F.lit(False))


def format_file_size(size: Column) -> Column:
    kb = 1024.0
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.format_string("%.1f KB", size / kb))
        .when(size < 1024**3, F.format_string("%.1f MB", size / kb**2))
        .otherwise(F.format_string("%.1f GB", size / kb**3))
    )


def delimiter_label(delimiter: Column) -> Column:
    return F.coalesce(_lookup(DELIMITER_LABELS, delimiter), F.concat(F.lit("'"), delimiter, F.lit("'")))


def escape_html(text: Column, quotes: bool = True, breaks: bool = False) -> Column:
    """& < > and, if asked for, double quotes and line breaks (as <br>)."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out
    return F.replace(out, F.lit("\n"), F.lit("<br>")) if breaks else out


def cell_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))


ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]  # fixed values


def roman(number: Column) -> Column:
    """Roman numeral; empty for zero."""
    out, rest = [], number
    for value, letters in ROMAN:
        out.append(F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*out)


def alpha(number: Column) -> Column:
    """A, B, ..., Z, AA, ... of a number up to about eight million."""
    out, rest = F.lit(""), number
    for _ in range(5):
        out = F.when(rest > 0, F.concat(F.call_function("char", 65 + (rest - 1) % 26), out)).otherwise(out)
        rest = F.floor((rest - 1) / 26).cast("long")
    return out


def list_number(number: Column, form: str) -> Column:
    """A number of a numbered list, by the name of its form (arabicPeriod, romanLcParenR, ...)."""
    body = roman(number) if "roman" in form.lower() else alpha(number) if "alpha" in form.lower() else number.cast("string")
    if "Lc" in form:
        body = F.lower(body)
    for name, before, after in (("Period", "", "."), ("ParenBoth", "(", ")"), ("ParenR", "", ")"), ("ParenL", "(", ""), ("Plain", "", "")):
        if name in form:
            return F.concat(F.lit(before), body, F.lit(after))
    return F.concat(body, F.lit("."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_category(ext: Column) -> Column:
    plain = F.regexp_replace(F.lower(ext), r"^\.+", "")
    out = None
    for name, exts in CATEGORIES.items():
        fits = plain.isin(exts.split())
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("unknown")


def supported_extensions() -> list[str]:
    return sorted({e for exts in CATEGORIES.values() for e in exts.split()})


def is_supported(ext: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(ext), r"^\.+", "").isin(supported_extensions()), F.lit(False))


def mime_type(path: Column) -> Column:
    return F.coalesce(_lookup(MIME_TYPES, extension(path)), F.lit("image/jpeg"))


def storage_url(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def xls_cell(value: Column, is_date: Column) -> Column:
    """A spreadsheet number as shown: integral ones without a point, dates as yyyy-mm-dd."""
    date = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value).cast("int")), "yyyy-MM-dd")
    return F.when(is_date, date).when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))


def pdf_date(value: Column) -> Column:
    """Wall clock timestamp of D:YYYYMMDDhhmmss, null if it is none."""
    digits = F.regexp_extract(value, r"^(?:D:)?([0-9]{14})", 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))
