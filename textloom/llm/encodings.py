"""Garbled text from wrong character encodings: detection and repair.

A latent chain says how each word came about: it is sound, or its bytes were written in one encoding and read in another
(sometimes twice). Every chain that can be undone gives a candidate text. Expectation-maximization over the corpus' distinct
words learns two things at once: a language model of sound words (characters in pairs, and whole words) and, for each
source and field pool, how common each chain is there. Weak evidence is so pooled across records. Then each record is
repaired word by word, by the normalised posterior of the chains.

The E step runs distributed over the distinct words of each pool; what it returns are sums in a fixed number of hash
buckets, of words, pairs, characters and pools alike, so the model has one size (about 13 MB) whatever the corpus. What other
words leave in a bucket on average is taken off, so that crowded buckets say nothing rather than something wrong.

Marks: "repaired" where a chain was undone, "lossy" where characters are lost (U+FFFD, question marks inside words), so
that the text cannot be restored in whole.

Defined cases: the `encoding` label is not consulted; RTF escapes (\\'e9, \\u233?) are ASCII and sound; null and empty
texts are sound and stay what they are; ties between chains go to the one listed first; texts of any length are whole;
repeated rows are listed once a key; an empty table gives no rows (the model is then empty and changes nothing).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from textloom.functions.checkpoints import checkpointed

ROUNDS = 4
WORDS, PAIRS, SINGLES = 1 << 20, 1 << 18, 1 << 16
POOLS = 1 << 14  # slots that pools are hashed to, so that what is known of them has one size however many folders there are
SOUND_PRIOR = 0.9

# (read as, written as) of each chain that is considered, most common first
CHAINS = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp949", "utf-8"), ("mac-roman", "utf-8"), ("cp1251", "utf-8"), ("cp850", "utf-8"), ("cp437", "utf-8"), ("koi8-r", "utf-8"),
          ("cp1252", "cp949"), ("latin-1", "cp949"), ("mac-roman", "cp949"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
          ("cp1252", "cp850"), ("latin-1", "cp850"), ("cp1252", "mac-roman"), ("latin-1", "mac-roman"), ("cp850", "cp1252"), ("mac-roman", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp949", "cp1252"),
          ("cp1252", "cp437"), ("mac-roman", "cp850"), ("cp850", "mac-roman"), ("mac-roman", "cp1251"), ("cp1251", "mac-roman"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("cp850", "cp1251"), ("cp850", "cp949"), ("cp1251", "cp949"), ("koi8-r", "cp949"),
          ("cp1250", "utf-8"), ("cp1252", "shift_jis"), ("utf-16-be", "utf-16-le"), ("utf-16-le", "utf-16-be"), ("gbk", "utf-8"), ("shift_jis", "utf-8")]
TWICE = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac-roman", "utf-8"), ("cp850", "utf-8")]

_READS = sorted({read for read, _ in CHAINS + TWICE})

# a word is a run of letters, marks and anything beyond ASCII; RTF control words and escapes are passed by
_WORD = re.compile(r"\\[A-Za-z]+-?[0-9]*\??|\\'[0-9a-fA-F]{2}|((?:[A-Za-z]|[^\x00-\x7f])+(?:\?(?:[A-Za-z]|[^\x00-\x7f])+)*)")
_LOST = re.compile(r"[^\W\d_]\?[^\W\d_]")
_HOLDS = re.compile(r"[^\x00-\x7f]|[A-Za-z]\?[A-Za-z]")


def words_of(text: str) -> Iterator[re.Match]:
    for m in _WORD.finditer(text):
        if m[1] is not None and _HOLDS.search(m[1]):
            yield m


@lru_cache(maxsize=32)
def _bytes_of(codec: str) -> dict[int, bytes]:
    """Byte of each character of a one-byte code page; bytes without a character stand for the control of that number."""
    out: dict[int, bytes] = {}
    for b in range(255, -1, -1):
        try:
            out[ord(bytes([b]).decode(codec))] = bytes([b])
        except UnicodeDecodeError:
            out.setdefault(b, bytes([b]))
    return out


_MANY = {"cp949", "utf-16-be", "utf-16-le", "gbk", "shift_jis", "utf-8"}


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]")


def _encoded(text: str, read: str) -> bytes | None:
    try:
        if read in _MANY:
            return text.encode(read)
        table = _bytes_of(read)
        return b"".join([table[ord(c)] for c in text])
    except (KeyError, UnicodeError):
        return None


def _decoded(text: str, raw: bytes | None, written: str) -> str | None:
    if raw is None:
        return None
    try:
        out = raw.decode(written)
    except UnicodeError:
        return None
    return None if out == text or _CONTROL.search(out) else out


def undo(text: str, read: str, written: str) -> str | None:
    """The text whose bytes in `written`, read as `read`, give `text`; null if there is none or nothing changes."""
    return _decoded(text, _encoded(text, read), written)


def candidates(word: str) -> list[tuple[int, str]]:
    """(chain, text) of each chain that can be undone; chains from len(CHAINS) on are those of two misreadings."""
    out = []
    raw = {read: _encoded(word, read) for read in _READS}  # each reading is undone once, whatever was written
    for k, (read, written) in enumerate(CHAINS):
        if (t := _decoded(word, raw[read], written)) is not None:
            out.append((k, t))
    for k, (read, written) in enumerate(TWICE):
        if (t := _decoded(word, raw[read], written)) is not None and (u := undo(t, read, written)) is not None:
            out.append((len(CHAINS) + k, u))
    return out


def _bucket(key: str, size: int) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % size


def _mixed(a, b, size: int):
    """Bucket of two code points, of numbers or of arrays."""
    return (a * 2654435761 + b * 40503 + (a * 2654435761 >> 15)) & (size - 1)


class SoundModel:
    """Log probability of a sound word, from pairs of characters. A pair is trusted only as far as its first character is
    common, so text made of rare characters alone is improbable, however regular it is. `raw` counts words as they stand."""

    def __init__(self, flat: np.ndarray):
        self.words, self.raw = flat[:WORDS], flat[WORDS : 2 * WORDS]
        self.pairs, self.singles = flat[2 * WORDS : 2 * WORDS + PAIRS], flat[2 * WORDS + PAIRS : 2 * WORDS + PAIRS + SINGLES]
        self.n_chars = float(self.singles.sum())
        self.trust = max(50.0, self.n_chars / 2000)
        self.noise = float(self.words.sum()) / WORDS, float(self.raw.sum()) / WORDS  # what other words leave in a bucket on average

    def log_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Log probability of each second character behind the first."""
        seen, before = self.pairs[_mixed(first, second, PAIRS)], self.singles[_mixed(first, 0, SINGLES)]
        char = (self.singles[_mixed(second, 0, SINGLES)] + 0.02) / (self.n_chars + 0.02 * 60_000)
        return np.log((seen + self.trust * char) / (before + self.trust))

    def log_p(self, texts: list[str]) -> np.ndarray:
        first, second, of = pairs_of(texts)
        return np.bincount(of, self.log_pairs(first, second), minlength=len(texts))

    def known(self, text: str, word: str) -> bool:
        """Whether `text` is common as a sound word beside the cases in which it stands garbled as `word`."""
        sound, garbled = float(self.words[_bucket(text, WORDS)]) - self.noise[0], float(self.raw[_bucket(word, WORDS)]) - self.noise[1]
        return sound > 2 * max(0.0, garbled) + 1


def pairs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, which text) of every pair of characters of texts that are marked at both ends."""
    points = np.frombuffer("".join(f"^{t}$" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    at = np.arange(lengths.sum()) + np.repeat(np.arange(len(texts)), lengths)
    return points[at], points[at + 1], np.repeat(np.arange(len(texts)), lengths)


def _kinds(word: str) -> set[str]:
    return {"h" if "\uac00" <= c <= "\ud7a3" else "c" if "\u0400" <= c <= "\u04ff" else "l" if c < "\u0250" else "o" for c in word if c.isalpha()}


def first_guess(word: str) -> float:
    """Weight of a word in the first language model: nothing for what sound words rarely show."""
    if any("\x7f" <= c <= "\xa0" or c == "\ufffd" or "\ue000" <= c <= "\uf8ff" or not (c.isalpha() or c in "’'-") for c in word) or _LOST.search(word):
        return 0.0
    kinds = _kinds(word)
    if len(kinds) > 1 or "o" in kinds:
        return 0.0
    letters = [c for c in word if ord(c) > 127]
    if kinds == {"l"} and len(letters) > 2 and len(letters) * 2 > len(word):
        return 0.0
    return 0.0 if kinds == {"c"} and any(c.isupper() for c in word[1:]) else 1.0


def _familiar(text: str) -> float:
    """Share of characters that text of any of the scripts at hand is made of."""
    return sum(c < "\x7f" or "\xa1" <= c <= "\xff" or "\u0400" <= c <= "\u04ff" or "\uac00" <= c <= "\ud7a3" or "\u2010" <= c <= "\u2026" for c in text) / max(1, len(text))


N_CHAINS = len(CHAINS) + len(TWICE)
UNIFORM = math.log(0.5 / N_CHAINS)


SIZE = 2 * WORDS + PAIRS + SINGLES + POOLS * (N_CHAINS + 1)  # words, words as they stand, pairs, singles, chains by pool (sound first)


def _shares(flat: np.ndarray) -> np.ndarray:
    """Log prior of sound and of each chain in each pool; chains not met there keep a little."""
    counts = flat[2 * WORDS + PAIRS + SINGLES :].reshape(POOLS, N_CHAINS + 1).astype(np.float64)
    total = counts.sum(axis=1, keepdims=True)
    share = counts / (total + 20.0)
    share[:, 0] += 20.0 * SOUND_PRIOR / (total[:, 0] + 20.0)
    known = np.log(np.maximum(share, 0.02 / N_CHAINS))
    blank = np.full(N_CHAINS + 1, UNIFORM)
    blank[0] = math.log(0.5)
    return np.where(total > 0, known, blank).astype(np.float32)


def _sums(vocabulary: DataFrame, known) -> DataFrame:
    """One E step: (place, weight), sums by bucket and by pool and chain. In the first round (nothing known) words count as first
    guessed. A task adds up in one array of fixed size and emits what of it is not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(SIZE)
        model, shares = (None, None) if known is None else known.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            pools, options = batch.column("pools"), batch.column("options")
            word_of_pool = np.repeat(np.arange(len(words)), np.diff(pools.offsets.to_numpy()))
            slot, n = (pools.flatten().field(i).to_numpy() for i in (0, 1))
            times = np.bincount(word_of_pool, n, minlength=len(words))
            own = np.fromiter((_bucket(w, WORDS) for w in words), dtype=np.int64, count=len(words))
            flat += np.bincount(WORDS + own, times, minlength=SIZE)
            if model is None:
                texts, weight = words, times * np.fromiter(map(first_guess, words), dtype=float, count=len(words))
            else:
                heard = np.array(["\ufffd" not in w and not _LOST.search(w) for w in words])
                # the options of each word, itself first, then each of its pools with each of these
                n_options = np.diff(options.offsets.to_numpy()) + 1
                starts = np.cumsum(n_options) - n_options
                texts, chain = np.empty(n_options.sum(), dtype=object), np.zeros(n_options.sum(), dtype=np.int64)
                texts[starts] = words
                rest = np.ones(len(texts), dtype=bool)
                rest[starts] = False
                texts[rest], chain[rest] = options.flatten().field(1).to_pylist(), options.flatten().field(0).to_numpy() + 1
                texts = list(texts)
                fit = model.log_p(texts)
                count = n_options[word_of_pool]
                row = np.repeat(np.arange(len(slot)), count)
                option = starts[word_of_pool][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                score = fit[option] + shares[slot[row], chain[option]]
                top = np.full(len(slot), -np.inf)
                np.maximum.at(top, row, score)
                p = np.exp(score - top[row])
                p *= (n * heard[word_of_pool])[row] / np.bincount(row, p, minlength=len(slot))[row]
                flat += np.bincount(2 * WORDS + PAIRS + SINGLES + slot[row] * (N_CHAINS + 1) + chain[option], p, minlength=SIZE)
                weight = np.bincount(option, p, minlength=len(texts))
                own = np.fromiter((_bucket(t, WORDS) for t in texts), dtype=np.int64, count=len(texts))
            first, second, of = pairs_of(texts)
            flat += np.bincount(own, weight, minlength=SIZE)
            flat += np.bincount(2 * WORDS + _mixed(first, second, PAIRS), weight[of], minlength=SIZE)
            flat += np.bincount(2 * WORDS + PAIRS + _mixed(first, 0, SINGLES), weight[of], minlength=SIZE)
        place = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat[place])], names=["place", "weight"])

    return vocabulary.mapInArrow(run, "place long, weight double").groupBy("place").agg(F.sum("weight").alias("weight"))


def learn(vocabulary: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The language model's buckets and the chains' sums by pool, in one array of fixed size, from (word, pools, options): a
    first guess, then `rounds` rounds. Words stay distributed; the driver adds nothing up and holds one such array."""
    sc = vocabulary.sparkSession.sparkContext
    known, flat = None, np.zeros(SIZE, dtype=np.float32)
    for _ in range(rounds + 1):
        got = _sums(vocabulary, known).toArrow()
        flat = np.zeros(SIZE, dtype=np.float32)
        flat[got.column("place").to_numpy()] = got.column("weight").to_numpy()
        known = sc.broadcast((SoundModel(flat), _shares(flat)))  # some 13 MB whatever the input
    return flat


# log odds that a word can add at most, by what it would be restored to: the rate at which sound words that the model finds odd
# turn up (names, loan words) is e to the minus this
KNOWN, ONE_SCRIPT, UNKNOWN, MIXED, LONE = 14.0, 4.0, 2.0, 1.0, 0.5
LEAST_PRIOR = -4.0  # log prior that a record keeps for a chain which its pool has not shown
SURE = 0.73  # posterior of being garbled from which on a record is repaired


class Repairer:
    """Repairs records by the posterior of the chains. A record's prior is its pool's; each of its words adds the log odds of what
    the chain would restore it to, against the word as it stands: sound by the language model, or odd at the rate of its kind."""

    def __init__(self, flat: np.ndarray):
        self.model, self.shares = SoundModel(flat), _shares(flat)
        self.kept: dict[str, dict[int, tuple[str, float]]] = {}

    def _rate(self, word: str, chain: int, text: str) -> float:
        written = (CHAINS + TWICE)[chain][1]
        if self.model.known(text, word):
            return KNOWN
        if written.startswith("utf-16"):
            return min(KNOWN, 3.0 * len(word)) if len(word) >= 2 and _familiar(text) >= 0.95 and _familiar(word) < 0.5 else MIXED
        if written == "utf-8":
            return ONE_SCRIPT if len(_kinds(text)) <= 1 else MIXED
        return UNKNOWN

    def look(self, words: list[str]) -> None:
        """Fill `kept` for these words: chain -> (text, log odds against the word as it stands)."""
        if len(self.kept) > 300_000:
            self.kept.clear()
        new = [w for w in words if w not in self.kept]
        every = [(w, k, t) for w in new for k, t in candidates(w)]
        fit = self.model.log_p(new + [t for _, _, t in every]) if new else []
        sound = dict(zip(new, fit))
        for w in new:
            self.kept[w] = {}
        for (w, k, t), f in zip(every, fit[len(new) :]):
            core = t.strip("¿¡«»…–—")
            single = (CHAINS + TWICE)[k][1] not in ("utf-8", "utf-16-le", "utf-16-be")
            limit = LONE if single and (len(core) < 2 or not core.isalpha()) else self._rate(w, k, t)  # a lone letter or sign is no evidence in a one-byte encoding
            odds = f - sound[w]
            self.kept[w][k] = (t, float(-np.logaddexp(-odds, -limit)))

    def posterior(self, words: set[str], pool: int) -> dict[int, float]:
        """Probability of each chain, and of -1 for sound. A word that a chain would not better is sound under it too."""
        score: dict[int, float] = {}
        for w in words:
            for k, (_, odds) in self.kept[w].items():
                if odds > 0:
                    score[k] = score.get(k, 0.0) + odds
        prior = self.shares[pool]
        logs = {k: v + max(LEAST_PRIOR, float(prior[k + 1])) for k, v in score.items()} | {-1: float(prior[0])}
        top = max(logs.values())
        mass = sum(math.exp(v - top) for v in logs.values())
        return {k: math.exp(v - top) / mass for k, v in logs.items()}

    def record(self, parts: list[str | None], pool: int) -> tuple[list[str | None], str]:
        """(restored parts, mark); mark is '', 'repaired' or 'lossy'."""
        words = {m[1] for t in parts if t and not (t.isascii() and "?" not in t) for m in words_of(t)}
        self.look(sorted(words))
        lossy = any("\ufffd" in w or _LOST.search(w) or any("\x80" <= c <= "\x9f" for c in w) and not self.kept[w] for w in words)
        fixed: dict[str, str] = {}
        left = words
        while left:  # every round takes words away
            p = self.posterior(left, pool)
            if 1 - p.pop(-1) < SURE or not p:
                break
            chain = max(p.items(), key=lambda x: (x[1], -x[0]))[0]
            now = {w: self.kept[w][chain][0] for w in left if chain in self.kept[w] and self.kept[w][chain][1] > 0}
            fixed |= now
            left = left - now.keys()
        mark = "lossy" if lossy else "repaired" if fixed else ""
        if not fixed:
            return parts, mark
        return [None if t is None else _WORD.sub(lambda m: fixed.get(m[1], m[0]) if m[1] else m[0], t) for t in parts], mark


RESULT = StructType([StructField("parts", ArrayType(StringType())), StructField("mark", StringType())])


def vocabulary_of(records: DataFrame) -> DataFrame:
    """(word, pools, options) of (pool, parts): each word that holds anything beyond ASCII, with the number of records of each
    pool that it stands in (at most `POOLS`), and what each chain would restore it to, worked out once for all rounds."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([list({m[1] for t in parts if t and not (t.isascii() and "?" not in t) for m in words_of(t)}) for parts in series], dtype=object)

    @F.pandas_udf("array<struct<chain: int, text: string>>")
    def undone(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([[{"chain": k, "text": t} for k, t in candidates(w)] for w in series], dtype=object)

    words = records.select("pool", F.explode(cut("parts")).alias("word")).groupBy("word", "pool").agg(F.count("*").cast("double").alias("n"))
    return words.groupBy("word").agg(F.collect_list(F.struct("pool", "n")).alias("pools")).withColumn("options", undone("word"))


def _pool(path: Column, field: str) -> Column:
    """Source and field pool: the first two folders of the source and the field, as one of `POOLS` slots."""
    return F.pmod(F.xxhash64(F.lit(field), F.coalesce(F.regexp_extract(path, r"^([^/]*/[^/]*)/", 1), F.lit(""))), F.lit(POOLS)).cast("int")


def records_of(rtf: DataFrame, csv: DataFrame) -> DataFrame:
    """(item_table, item_id, pool, parts): the content of each RTF source, the cells of each CSV source."""
    a = rtf.filter(F.col("content").isNotNull()).select(F.lit("rtf_source_info").alias("item_table"), F.col("source_id").alias("item_id"), _pool(F.col("file_path"), "content").alias("pool"), F.array("content").alias("parts"))
    cells = F.flatten(F.transform("parsed_rows", lambda r: F.coalesce(r, F.array().cast("array<string>"))))
    b = csv.filter(F.col("parsed_rows").isNotNull()).select(F.lit("csv_source_info").alias("item_table"), F.col("csv_id").alias("item_id"), _pool(F.col("file_path"), "cells").alias("pool"), cells.alias("parts"))
    return a.unionByName(b)


def repaired(rtf: DataFrame, csv: DataFrame) -> DataFrame:
    """(item_table, item_id, parts, mark) of every record; mark is null for sound ones. Cells are in row order."""
    records = records_of(rtf, csv)
    known = rtf.sparkSession.sparkContext.broadcast(learn(checkpointed(vocabulary_of(records))))

    @F.pandas_udf(RESULT)
    def fix(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(known.value)
        for series, pools in batches:
            rows = [repairer.record(list(parts), p) for parts, p in zip(series, pools)]
            yield pd.DataFrame([(t, m or None) for t, m in rows], columns=["parts", "mark"])

    return records.select("item_table", "item_id", fix("parts", "pool").alias("r")).select("item_table", "item_id", "r.parts", "r.mark")


def affected(rtf: DataFrame, csv: DataFrame) -> DataFrame:
    """(item_table, item_id) of every record with garbled text, in whole or in part, each once."""
    return repaired(rtf, csv).filter(F.col("mark").isNotNull()).select("item_table", "item_id").distinct()
