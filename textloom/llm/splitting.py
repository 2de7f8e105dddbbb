"""Splitting oversized items at natural boundaries.

Every position of a text has a boundary strength. A sparse table over the strengths answers range-maximum queries in
constant time: for the piece that starts at s it gives the strongest cut in the permissible window, ties rightward. The
next piece starts `overlap` code points before the cut. Texts of a batch lie in one flat array, so strengths and table
are built by a few numpy operations for all of them together.

Defined cases
    * sizes count code points; a text of exactly the size is one piece, as is the empty text; null text has no pieces;
    * pieces hold at most `size` code points and, joined without their overlaps, give the text back exactly;
    * the window is the second half of a full piece; only if it holds no boundary at all, it is widened down to
      the overlap; text without any boundary is cut at the size;
    * no cut falls inside a tag ([Page Number: n], [Image:...]), a combining sequence or a surrogate pair, unless a
      single such run is longer than the whole window;
    * an overlap of the size or more is reduced to size - 1; a size below 1 raises ValueError;
    * very long texts are cut block by block; a block is `BLOCK` positions, or four pieces where these are longer;
    * ties and repeated rows give equal pieces; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.once import once

BLOCK = 1 << 18
STEP = 1 << 12  # positions of one bucket where windows are longer than a quarter of a block
PROFILE_ROWS = 1_000_000  # records up to which their profiles (some 20 bytes each) may be broadcast; beyond, the join shuffles
PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))
STARTS = T.ArrayType(T.IntegerType())

# strengths, strongest first
PAGE, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, SCRIPT, INSIDE, FORBIDDEN = 8, 7, 6, 5, 4, 3, 2, 1, 0
_TAG = re.compile(r"\[(?:Page Number|Slide Number|Sheet|Image)\s*:[^\]\n]*\]", re.IGNORECASE)
_PAGE = re.compile(r"\[(?:Page Number|Slide Number|Sheet)\s*:", re.IGNORECASE)
_SENTENCE_END = np.array([ord(c) for c in ".!?…。！？"], dtype=np.uint32)
_CLAUSE_END = np.array([ord(c) for c in ",;:—–、，；："], dtype=np.uint32)
_SPACE = np.array([9, 11, 12, 32, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)], dtype=np.uint32)
_CLOSING = np.array([ord(c) for c in "\"')]}»”’」』"], dtype=np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def strengths(text: str, cp: np.ndarray) -> np.ndarray:
    """uint8 strength of cutting before each position; position 0 is never asked for."""
    n = len(cp)
    out = np.full(n, INSIDE, dtype=np.uint8)
    if n < 2:
        return out
    before, after = cp[:-1], cp[1:]
    newline = (cp == 10) | (cp == 13)
    blank = newline | np.isin(cp, _SPACE)
    wide = (cp >= 0x2E80) & (cp < 0xE000)
    at = out[1:]
    at[wide[:-1] | wide[1:]] = SCRIPT
    at[blank[:-1] & ~blank[1:]] = WORD
    # what ends before the blanks: look back over blanks and closing quotes to the last real character
    solid = np.maximum.accumulate(np.where(blank, 0, np.arange(n)))
    last = cp[solid]
    closing = np.isin(last, _CLOSING)
    inner = np.where(closing, np.maximum(solid - 1, 0), solid)
    ends = np.isin(cp[inner], _SENTENCE_END)[:-1]
    start = blank[:-1] & ~blank[1:]
    at[start & np.isin(last, _CLAUSE_END)[:-1]] = CLAUSE
    at[start & ends] = SENTENCE
    at[(wide[1:] & ~blank[:-1]) & np.isin(before, np.array([0x3002, 0xFF01, 0xFF1F], dtype=np.uint32))] = SENTENCE
    # a line break and a blank line weigh by the breaks inside the run of blanks before the position
    breaks = np.cumsum(cp == 10)
    since = breaks - breaks[solid]
    at[start & (since[:-1] >= 1)] = LINE
    at[start & (since[:-1] >= 2)] = PARAGRAPH
    joined = ((after >= 0x300) & (after < 0x370)) | ((after >= 0x1AB0) & (after < 0x1B00)) | ((after >= 0x20D0) & (after < 0x2100)) | ((after >= 0xFE00) & (after < 0xFE10)) | (after == 0x200D) | (before == 0x200D) | ((after >= 0x1F3FB) & (after <= 0x1F3FF)) | ((before == 13) & (after == 10)) | ((after >= 0x1160) & (after < 0x1200)) | ((after >= 0xDC00) & (after < 0xE000))
    at[joined] = FORBIDDEN
    if "[" in text:
        for m in _TAG.finditer(text):
            out[m.start() + 1 : m.end()] = FORBIDDEN
            if _PAGE.match(m[0]):
                out[m.start()] = PAGE
    return out


class RangeMaximum:
    """Sparse table of keys strength * 2^40 + position: the maximum of a range is its strongest, rightmost cut. Where windows are
    long, the table is over buckets of `STEP` positions, and a range's ends are looked at as they are; so the table stays
    smaller than the text."""

    def __init__(self, strength: np.ndarray, longest: int):
        self.strength, self.step = strength, 1 if longest <= BLOCK // 4 else STEP
        level = strength.astype(np.uint64) << np.uint64(40) | np.arange(len(strength), dtype=np.uint64)
        if self.step > 1:
            level = np.maximum.reduceat(level, np.arange(0, len(level), self.step))
        self.levels = [level]
        width = 1
        while width * 2 <= min(longest // self.step + 1, len(level)):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def strongest(self, low: int, high: int) -> tuple[int, int]:
        """(position, strength) of the strongest cut in [low, high], the rightmost of equals."""
        first, last = (low, high) if self.step == 1 else (-(-low // self.step), (high + 1) // self.step - 1)
        if first > last:
            return self._direct(low, high)
        k = (last - first + 1).bit_length() - 1
        row = self.levels[k]
        key = max(int(row[first]), int(row[last - (1 << k) + 1]))
        best = key & ((1 << 40) - 1), key >> 40
        if self.step > 1:
            ends = [self._direct(a, b) for a, b in ((low, first * self.step - 1), ((last + 1) * self.step, high)) if a <= b]
            best = max([best, *ends], key=lambda x: (x[1], x[0]))
        return best

    def _direct(self, low: int, high: int) -> tuple[int, int]:
        part = self.strength[low : high + 1][::-1]
        at = int(part.argmax())
        return high - at, int(part[at])


def _cuts(table: RangeMaximum, base: int, offset: int, stop: int, size: int, overlap: int, start: int, length: int) -> tuple[list[tuple[int, int]], int]:
    """Pieces (start, end) from `start` on as far as the table reaches. Positions are of the text; the table's
    index of position p is p - offset + base; stop is the first position it does not hold."""
    out = []
    while length - start > size:
        if start + size >= stop and stop < length:
            break
        shift = base - offset
        high = start + size
        low = max(start + overlap + 1, start + size // 2 + 1)
        cut, strength = table.strongest(low + shift, high + shift)
        if strength <= INSIDE and start + overlap + 1 < low:
            wider, better = table.strongest(start + overlap + 1 + shift, low - 1 + shift)
            if better > strength:
                cut, strength = wider, better
        cut -= shift
        if strength == FORBIDDEN:
            cut = high
        out.append((start, cut))
        start = cut - overlap
    return out, start


def pieces_of(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text."""
    return pieces_of_batch([text], [size], [overlap])[0]


def _one_long(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    out, start, length = [], 0, len(text)
    reach = max(BLOCK, 4 * size)
    while length - start > size:
        lo = max(0, start - 64)  # a little context, so that strengths at the block's edge are right
        part = text[lo : start + reach + 320]
        table = RangeMaximum(strengths(part, code_points(part)), size)
        stop = lo + len(part) if lo + len(part) >= length else start + reach
        got, start = _cuts(table, 0, lo, stop, size, overlap, start, length)
        out += got
    out.append((start, length))
    return out


def pieces_of_batch(texts: list[str], sizes: list[int], overlaps: list[int]) -> list[list[tuple[int, int]]]:
    """Pieces of many texts; those that need cutting share one flat array up to BLOCK positions."""
    out: list[list[tuple[int, int]]] = [[(0, len(t))] for t in texts]
    todo: list[int] = []
    for i, (t, s) in enumerate(zip(texts, sizes)):
        if s < 1:
            raise ValueError(f"chunk size {s} is below 1")
        if len(t) > s:
            if len(t) > BLOCK:
                out[i] = _one_long(t, s, min(overlaps[i], s - 1))
            else:
                todo.append(i)
    at = 0
    while at < len(todo):
        group, total = [], 0
        while at < len(todo) and (not group or total + len(texts[todo[at]]) + 2 <= BLOCK):
            group.append(todo[at])
            total += len(texts[todo[at]]) + 2
            at += 1
        flat = "\n\n".join(texts[i] for i in group)
        table = RangeMaximum(strengths(flat, code_points(flat)), max(sizes[i] for i in group))
        base = 0
        for i in group:
            n, overlap = len(texts[i]), max(0, min(overlaps[i], sizes[i] - 1))
            got, start = _cuts(table, base, 0, n, sizes[i], overlap, 0, n)
            out[i] = [*got, (start, n)]
            base += n + 2
    return out


def _kernel(with_text: bool):
    @F.pandas_udf(PIECES if with_text else STARTS)
    def split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes, overlaps in batches:
            known = [i for i, t in enumerate(texts) if t is not None]
            cut = pieces_of_batch([texts.iat[i] for i in known], [int(sizes.iat[i]) for i in known], [int(overlaps.iat[i]) for i in known])
            out: list = [None] * len(texts)
            for i, spans in zip(known, cut):
                out[i] = [{"start": a, "text": texts.iat[i][a:b]} for a, b in spans] if with_text else [a for a, _ in spans]
            yield pd.Series(out, dtype=object)

    return split


def pieces(text: Column, size: Column, overlap: Column) -> Column:
    """array<struct<start, text>>"""
    return _kernel(True)(text, size, overlap)


def piece_starts(text: Column, size: Column, overlap: Column) -> Column:
    """array<int>: the starts alone, where the texts of the pieces are not needed."""
    return _kernel(False)(text, size, overlap)


def with_limits(items: DataFrame, profiles: DataFrame, profile: str = "profile", default: str = "standard") -> DataFrame:
    """Add __size and __overlap of each item's profile; null and unknown profiles mean the default. The profiles'
    table is a fixed handful of rows; whether it is broadcast is left to its measured size."""
    p = profiles.groupBy(F.col("profile").alias("__profile")).agg(F.max("chunk_size").alias("__size"), F.max("chunk_overlap").alias("__overlap"))
    fallback = profiles.filter(F.col("profile") == default)
    known = items.withColumn("__p", F.coalesce(F.col(profile), F.lit(default))).join(p, F.col("__p") == F.col("__profile"), "left")
    size, overlap = (F.coalesce("__" + n, fallback.agg(F.max("chunk_" + n)).scalar()) for n in ("size", "overlap"))
    return known.withColumn("__size", size).withColumn("__overlap", overlap).drop("__p", "__profile")


def items_to_split(converted: DataFrame, chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(item_table, item_id, text, __size, __overlap) of every item that is longer than its limit, by a length test in
    the scan. Chunks no longer than the smallest limit of all are passed by before the join that finds their
    record's profile; that one moves no chunk while there are at most `PROFILE_ROWS` records."""
    least = profiles.agg(F.min("chunk_size")).scalar()
    records = with_limits(converted.filter(F.col("content").isNotNull()), profiles)
    own = records.select(F.lit("rtf_converted_data").alias("item_table"), F.col("convert_id").alias("item_id"), F.col("content").alias("text"), "__size", "__overlap")
    long = chunks.filter(F.length("text") > least).select("chunk_id", "convert_id", "text")
    profile_of = converted.select("convert_id", "profile").groupBy("convert_id").agg(F.max("profile").alias("profile"))
    if converted.limit(PROFILE_ROWS + 1).count() <= PROFILE_ROWS:
        profile_of = F.broadcast(profile_of)
    parts = with_limits(long.join(profile_of, "convert_id", "left"), profiles)
    cut = parts.select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), "text", "__size", "__overlap")
    return own.unionByName(cut).filter(F.length("text") > F.col("__size"))


def oversized(converted: DataFrame, chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(item_table, item_id) of every item that the operator cuts into more than one piece, each once."""
    todo = items_to_split(converted, chunks, profiles)
    cut = todo.select("item_table", "item_id", piece_starts(F.col("text"), F.col("__size"), F.col("__overlap")).alias("starts"))
    return cut.filter(F.size("starts") > 1).select("item_table", "item_id").distinct()


def split_items(converted: DataFrame, chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(item_table, item_id, piece_no, start, text) of the pieces of every oversized item."""
    todo = items_to_split(once(converted.select("convert_id", "content", "profile"), ["convert_id"]), once(chunks.select("chunk_id", "convert_id", "text"), ["chunk_id"]), profiles)
    cut = todo.select("item_table", "item_id", F.posexplode(pieces(F.col("text"), F.col("__size"), F.col("__overlap"))).alias("piece_no", "piece"))
    return cut.select("item_table", "item_id", "piece_no", F.col("piece.start").alias("start"), F.col("piece.text").alias("text"))
