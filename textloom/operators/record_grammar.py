"""An error-recovering recursive-descent grammar for delimited records.

    file   := record (NEWLINE record)*
    record := field (DELIMITER field)*
    field  := QUOTED | BARE
    QUOTED := '"' ([^"] | '""')* '"'      followed by DELIMITER or the record's end
    BARE   := no double quote

A field that breaks the grammar is a located syntax error. The parser then skips to the next record-start
anchor: a line start from which a whole record parses with the expected number of columns (`columns`), so
that one broken quote does not swallow the records behind it. Without such an anchor the rest of the text
belongs to the broken record.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from functools import lru_cache


@dataclass
class SyntaxIssue:
    offset: int
    column: int
    message: str


@dataclass
class ParsedRecord:
    start: int
    end: int
    fields: list[str]
    issues: list[SyntaxIssue] = field(default_factory=list)


class RecordGrammar:
    """Parser for one delimiter. `multiline`: line breaks may stand in bare fields too, as in a record that
    was delivered alone; otherwise a line break outside quotes ends the record."""

    def __init__(self, delimiter: str, columns: int | None = None, multiline: bool = False):
        d = re.escape(delimiter)
        self.delimiter, self.columns, self.multiline = delimiter, columns, multiline
        stop = d if multiline else d + r"\r\n"
        self._quoted = re.compile(r'"((?:[^"]|"")*+)"')
        self._bare = re.compile(rf'[^"{stop}]*+')
        self._skip = re.compile(rf"[^{stop}]*+")
        self._newline = re.compile(r"\r\n|\n|\r")

    def _ends(self, text: str, at: int) -> bool:
        return at == len(text) or text[at] == self.delimiter or (not self.multiline and text[at] in "\r\n")

    def _field(self, text: str, at: int) -> tuple[str, int, str | None]:
        """(value, end, fault) of the field at `at`."""
        if text.startswith('"', at):
            m = self._quoted.match(text, at)
            if m is None:
                return text[at:], len(text), "quote is never closed"
            if not self._ends(text, m.end()):
                return text[at : m.end()], m.end(), "text after a closing quote"
            return m[1].replace('""', '"'), m.end(), None
        m = self._bare.match(text, at)
        if not self._ends(text, m.end()):
            return text[at : m.end()], m.end(), "quote inside a bare field"
        return m[0], m.end(), None

    def record(self, text: str, at: int = 0) -> ParsedRecord:
        """The record at `at`. After a fault the field runs to the next delimiter, and parsing goes on."""
        out = ParsedRecord(at, at, [])
        while True:
            value, end, fault = self._field(text, at)
            if fault is not None:
                out.issues.append(SyntaxIssue(end if end < len(text) else at, len(out.fields), fault))
                end = self._skip.match(text, at + 1 if end == len(text) else end).end()
                value = text[at:end]
            out.fields.append(value)
            at = end
            if at < len(text) and text[at] == self.delimiter:
                at += 1
                continue
            out.end = at
            return out

    def _anchored(self, text: str, at: int) -> bool:
        """Whether a sound record of the expected width starts at `at`."""
        tried = self.record(text, at)
        return not tried.issues and (self.columns is None or len(tried.fields) == self.columns) and (tried.end == len(text) or text[tried.end] in "\r\n")

    def file(self, text: str) -> list[ParsedRecord]:
        """Every record of a file, sound or not."""
        out, at = [], 0
        while at < len(text):
            rec = self.record(text, at)
            if rec.issues:
                out.append(rec)
                first = self._newline.search(text, rec.start)
                while first is not None and not self._anchored(text, first.end()):
                    first = self._newline.search(text, first.end())
                rec.end = len(text) if first is None else first.start()
            else:
                out.append(rec)
            m = self._newline.match(text, rec.end)
            at = rec.end if m is None else m.end()
            if m is None and at < len(text):
                at = len(text)
        return out


@lru_cache(maxsize=256)
def grammar(delimiter: str, columns: int | None, multiline: bool = True) -> RecordGrammar:
    return RecordGrammar(delimiter, columns, multiline)


_INTEGER = re.compile(r"[+-]?[0-9]+\Z")
_DECIMAL = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?\Z")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})\Z")


def _is_date(x: str) -> bool:
    m = _DATE.match(x)
    if m is None:
        return False
    try:
        datetime.date(int(m[1]), int(m[2]), int(m[3]))
        return True
    except ValueError:
        return False


def _is_integer(x: str) -> bool:
    if _INTEGER.match(x) is None:
        return False
    digits = x.lstrip("+-").lstrip("0")
    return len(digits) < 19 or (len(digits) == 19 and int(digits) < 2**63 + x.startswith("-"))


FITS = {
    "integer": _is_integer,
    "decimal": lambda x: _DECIMAL.match(x) is not None,
    "date": _is_date,
    "flag": lambda x: x in ("Y", "N"),
    "text": lambda x: True,
}


def check_values(fields: list[str], kinds: list[str], required: list[bool]) -> int | None:
    """Index of the first field that does not fit its column, else None. An unknown kind fits anything."""
    for i, (value, kind, need) in enumerate(zip(fields, kinds, required)):
        x = value.strip(" ")
        if x == "":
            if need:
                return i
        elif kind != "text" and not FITS.get(kind, FITS["text"])(x):
            return i
    return None
