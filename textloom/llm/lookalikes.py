"""Visually identical text with different characters: confusables skeletons.

The skeleton of a text is: decompose, replace every character by its prototype, decompose again. Texts with equal
skeletons look the same. Originals are grouped, or matched with a list of terms, by equal skeleton.

What counts as looking the same
    * full-width and half-width forms, mathematical alphabets and ligatures, and the letters they stand for;
    * precomposed and combining accents, Hangul syllables and jamo;
    * Cyrillic and Greek letters drawn like Latin ones; hyphens of the same width; all spaces of one kind or another;
    * invisible characters (zero width, soft hyphen, joiners, marks of direction, variation selectors) count as absent.
What does not: case, accents, punctuation, spaces that are missing or added, superscripts, circled forms, l and 1, O and 0.

Defined cases: null text has a null skeleton and matches nothing; empty text has the empty skeleton; texts of any
length are mapped in time linear in their length; a text that equals a term code point by code point is no match of
it, but still matches another term of the same skeleton; repeated rows are listed once a key.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: letters of other scripts that are drawn like a Latin letter, and that letter below each
LOOKALIKE = [
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮ", "ABESIJKMHOPCTYXGQWY"),
    ("аеѕіјорсухһԁԛԝӏ", "aesijopcyxhdqwl"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "ABEZHIKMNOPTYXCC"),
    ("οονϲϳαρυιγ", "oovcjapuiy"),
    ("ՏՍՕԼ", "SUOL"),
    ("օսոզհցյգ", "ounqhgjq"),
    ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ", "ABCDEHJKLMPRSTVWZ"),
    ("ɑɡıɩ", "agii"),
    ("‐‑﹣－", "----"),
    ("’＇ʼ", "'''"),
]
# decompositions of these kinds keep the look; <super>, <sub>, <circle>, <square>, <fraction> do not
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_INVISIBLE_RANGES = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]


def _prototype(cp: int) -> str | None:
    """What stands for a character in a skeleton, None if it stands for itself."""
    c = chr(cp)
    if any(a <= cp <= b for a, b in _INVISIBLE_RANGES):
        return ""
    if unicodedata.category(c) == "Zs" and c != " ":
        return " "
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind in _SAME_LOOK or (kind == "<compat>" and (0xFB00 <= cp <= 0xFB06 or 0x3131 <= cp <= 0x318E)):
        return unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
    return None


class Prototypes(dict):
    """The look-alike table, from the Unicode character database and the short lists above. Characters are looked up when they
    are first met, so a worker pays for those of its texts only. A prototype is itself made of prototypes."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        p = _LISTED.get(c, _prototype(cp) if cp >= 0x80 and not 0xD800 <= cp <= 0xDFFF else None)
        self[cp] = out = c if p is None or p == c else p if p.isascii() else p.translate(self)
        return out


_LISTED = {odd: plain for a, b in LOOKALIKE for odd, plain in zip(a, b)}


@lru_cache(maxsize=1)
def prototypes() -> Prototypes:
    return Prototypes()


def skeleton_of(text: str) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


@F.pandas_udf(StringType())
def _skeleton(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else skeleton_of(t) for t in texts], dtype=object)


def skeleton(text: Column) -> Column:
    return _skeleton(text)


def consistent_form(text: Column) -> Column:
    """The one form in which texts that look the same are equal: the composed skeleton."""

    @F.pandas_udf(StringType())
    def composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else unicodedata.normalize("NFC", skeleton_of(t)) for t in texts], dtype=object)

    return composed(text)


def matches(items: DataFrame, terms: DataFrame, text: str = "text", keys: list[str] = ["item_id"], term_table_rows: int = 100_000) -> DataFrame:
    """(keys, term_id) of each item that looks the same as a term without being identical to it, each once.

    The term side is broadcast only if it counts at most `term_table_rows` rows; beyond that both sides are shuffled
    on the skeleton. Only skeletons, not texts, are compared."""
    side = terms.select("term_id", "term", skeleton(F.col("term")).alias("__skeleton")).filter(F.col("term").isNotNull()).dropDuplicates(["term_id"])
    if terms.limit(term_table_rows + 1).count() <= term_table_rows:
        side = F.broadcast(side)
    marked = items.select(*keys, F.col(f"`{text}`").alias("__text")).filter(F.col("__text").isNotNull()).withColumn("__skeleton", skeleton(F.col("__text")))
    return marked.join(side, "__skeleton").filter(F.col("__text") != F.col("term")).select(*keys, "term_id").distinct()
