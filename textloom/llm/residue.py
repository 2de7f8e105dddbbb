"""Template residue and error-page text in place of subtitles.

A positive-unlabelled naive Bayes model is learned by expectation-maximization. Records of which every passage is mostly a
trusted pattern (a few well-known error messages, placeholders, fillers and script notices) are positive; all others of the
fitting sample are unlabelled mixtures. The E step gives each unlabelled record its posterior of being residue, from its
passages and from what it is like as a whole (how many passages, cues or none); the M step counts features weighted by it. So
passages that no pattern knows become residue if they stand only in records that are like the positive ones.

Then every passage of every record is scored by the learned features; that it shows a trusted pattern is one among some
thirty of them. Decisions are aggregated: a record is excluded if it has a passage of residue and none of real dialogue.

A passage is a line of a subtitle without cue numbers and times. Sound descriptions, adverts and credits are neither
residue nor dialogue, unless the model is sure that they are residue: "[to be filled]" looks like a sound.

The classifier is fitted on at most about `FIT_RECORDS` records and `FIT_CHARACTERS` characters, picked by a hash of their key;
scoring covers all records.

Defined cases: null, empty and blank texts are no cases, nor are texts of only sounds or adverts; a stray residue line beside
dialogue is no case; a text is read up to its first line of dialogue, however long it is; repeated rows are listed once; an
empty table gives no rows; where no record is trusted throughout, those are positive of which half the passages are; with none
of these either there is nothing to learn from, and no record is a case.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_RECORDS = 5_000  # bounds of the sample that the classifier is fitted on
FIT_CHARACTERS = 64_000_000
BUCKETS = 1 << 18
ROUNDS = 10
RESIDUE, NEUTRAL_RESIDUE, DIALOGUE = 1.0, 4.0, -2.0  # log odds from which on a passage is residue, one that looks neutral is, and up to which one is dialogue
MOST = 0.3  # share of a passage that trusted patterns must cover

# fixed values: patterns that are trusted to mark residue, by family
TRUSTED = {
    "placeholder": re.compile(r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%=?[^%\n]+%>|[$#]\{[^{}\n]+\}|%\([\w.]+\)s|__[A-Z][A-Z_0-9]*__|\[INSERT [^\]\n]+\]"),
    "filler": re.compile(r"\blorem ipsum\b|^(?:todo|fixme|tbd)\b|^(?:placeholder|dummy|sample) (?:text|line|caption|subtitle)\b|^your text here\b|^(?:asdf|qwer(?:ty)?|foo bar)\b", re.IGNORECASE),
    "status": re.compile(
        r"\b(?:4[01][0-9]|429|50[0-9])\b\W{0,3}(?:not found|gone|forbidden|unauthori[sz]ed|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|too many requests|internal server error|bad request)"
        r"|^HTTP/[0-9.]+ [0-9]{3}|Traceback \(most recent call|\bpage not found\b|\bseite nicht gefunden\b|\bpage introuvable\b|\bpágina (?:no|não) encontrada\b|페이지를 찾을 수 없습니다",
        re.IGNORECASE,
    ),
    "access": re.compile(r"\bsession has expired\b|^access denied\b|\bplease (?:log|sign) in\b|\btry again later\b|\bdown for maintenance\b|\blimit (?:reached|exceeded)\b", re.IGNORECASE),
    "script": re.compile(r"(?:\b(?:enable|activate|requires?|needs?|without) )?\bjavascript\b(?: is (?:disabled|required|not enabled))?|\benable cookies\b|\bcookies and\b|\bbrowser is not supported\b|\bcaptcha\b", re.IGNORECASE),
}

_TIME = re.compile(r"^\s*[0-9]{1,2}:[0-9]{2}.{0,10}\s*-{1,2}>\s*[0-9]")
_COUNTER = re.compile(r"^(?:[0-9]+|WEBVTT\b.*|NOTE\b.*)$")
_STYLE = re.compile(r"</?(?:i|b|u|s|font|c|v|ruby|rt)\b[^>]*>|\{\\[^}]*\}", re.IGNORECASE)
_SOUND = re.compile(r"^(?:[^\W\d_]{2,30}:?\s*)?(?:\[[^\[\]{}$%@<>]+\]|\([^()]+\)|\{[^{}$%@<>\\]+\}|\*[^*]+\*|[♪♫#][^♪♫]*[♪♫#]|[♪♫\s]+)$")
_ADVERT = re.compile(
    r"www\.|https?://|[\w.-]+@[\w-]+\.\w|\b[\w-]+\.(?:com|net|org|info|tv|example|invalid)\b|\bVIP member\b|\bremove all ads\b|\badvertise your\b|^-= .*=-|\bripped by\b"
    r"|^(?:subtitles?|subs|captions?|transcript|sync(?:ed)?|translated|corrections?|downloaded|untertitel|sous-titres|subtítulos|legendas)\b[^.!?]{0,4}(?: by| from|:| par| von| por)",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_MARKS = re.compile(r"[^\w.,!?;:'’\"…–—-]")
_CODE = re.compile(r"\b(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{4,12}\b")
_DIGITS = re.compile(r"[0-9]+")


def trusted(passage: str, families: dict[str, re.Pattern] = TRUSTED) -> bool:
    """Whether trusted patterns cover enough of a passage, so that it is not one that quotes them."""
    covered = max((sum(m.end() - m.start() for m in p.finditer(passage)) for p in families.values()), default=0)
    return covered > 0 and covered >= MOST * len(passage)


def passages(text: str) -> Iterator[str]:
    """Lines of a subtitle that are neither cue numbers nor times, without styling."""
    for line in text.replace("\r", "\n").split("\n"):
        line = line.strip("﻿ \t​")
        if not line or _COUNTER.match(line) or ("->" in line and _TIME.match(line)):
            continue
        bare = _STYLE.sub("", line).strip() if "<" in line or "{" in line else line
        if bare.startswith("- "):
            bare = bare[2:].strip()
        if bare:
            yield bare


def generic(passage: str) -> str:
    """The passage with reference codes and numbers made equal."""
    return _DIGITS.sub("0", _CODE.sub("code0", passage))


def shape(token: str) -> str:
    """A token with its letters made equal: what is left are its marks."""
    return _WORD.sub(lambda m: "A" if m[0].isupper() else "a", token)


@lru_cache(maxsize=1 << 20)
def _slot(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "replace")) % BUCKETS


def features(passage: str, shown: bool) -> np.ndarray:
    """Hashed features of a generic passage: words, pairs of words with the passage's ends, shapes of tokens with marks and
    the pairs of characters in them, the shape of the whole, whether one word is said over and over, and whether a trusted
    pattern is shown."""
    words = _WORD.findall(passage.lower())
    keys = {"w" + w for w in words}
    ends = ["^", *words, "$"]
    keys.update(f"b{a} {b}" for a, b in zip(ends, ends[1:]))
    for token in _TOKEN.findall(passage):
        s = shape(token)
        if _MARKS.search(s):
            keys.add("t" + s)
            keys.update("g" + s[i : i + 2] for i in range(len(s) - 1))
    whole = shape(passage)
    keys.add("s" + (whole if len(whole) < 30 else str(len(whole) // 10)))
    if len(words) > 1 and len(set(words)) == 1:
        keys.add("r")
    if shown:
        keys.add("p")
    return np.fromiter(map(_slot, keys), dtype=np.int64, count=len(keys))


def is_neutral(passage: str) -> bool:
    """Sound descriptions, adverts and credits, those in which m was read as rn too; and what holds no word."""
    return bool(_SOUND.match(passage) or _ADVERT.search(passage) or ("rn" in passage and _ADVERT.search(passage.replace("rn", "m"))) or not _WORD.search(passage))


LENGTHS, KINDS = (1, 2, 3, 4, 6, 9), 12


def record_kind(lines: int, cues: bool) -> tuple[int, int]:
    """The features of a record as a whole: how many passages it has, and whether it has cues."""
    return sum(lines >= n for n in LENGTHS), 8 + cues


def _shrunk(up: np.ndarray, down: np.ndarray, rate: float, weight: float) -> np.ndarray:
    """Log odds of features, drawn to the rate of residue at large: one that was hardly seen says nothing."""
    return np.log((up + weight * rate) / (down + weight * (1 - rate))) - math.log(rate / (1 - rate))


def fit(texts: list[str], rounds: int = ROUNDS, families: dict[str, re.Pattern] = TRUSTED) -> np.ndarray:
    """float32 log odds of each feature bucket, residue against dialogue; in a second row, for passages that look neutral, the
    same drawn more to the rate at large."""
    place: dict[str, int] = {}
    rows: list[np.ndarray] = []
    marks: list[bool] = []
    counts: list[bool] = []
    records: list[Counter] = []
    kinds: list[tuple[int, int]] = []
    for text in texts:
        own: Counter = Counter()
        for p in passages(text):
            key = generic(p)
            if key not in place:
                place[key] = len(rows)
                marks.append(trusted(p, families))
                rows.append(features(key, marks[-1]))
                counts.append(marks[-1] or not is_neutral(p))
            own[place[key]] += 1
        lines = sum(counts[k] for k in own)
        if lines:  # records of sounds and adverts alone teach nothing
            records.append(own)
            kinds.append(record_kind(lines, "->" in text))
    n = len(records)
    sure = np.array([sum(marks[k] for k in own) / sum(counts[k] for k in own) for own in records])
    positive = sure == 1 if (sure == 1).any() else sure >= 0.5
    if not positive.any():
        return np.zeros((2, BUCKETS), dtype=np.float32)
    lengths = np.array([len(r) for r in rows])
    flat, row_of = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    record_of = np.repeat(np.arange(n), [len(r) for r in records])
    line_of = np.array([k for own in records for k in own], dtype=np.int64)
    times = np.minimum(np.array([v for own in records for v in own.values()], dtype=np.float64), 3)
    telling = times * np.array(counts)[line_of]
    size = np.maximum(np.bincount(record_of, telling, minlength=n), 1)
    kind = np.array(kinds)
    q = positive.astype(float)  # unlabelled records start as dialogue; the E step moves those that are like the positive ones
    odds = cautious = np.zeros(BUCKETS)
    often = np.bincount(flat, np.bincount(line_of, minlength=len(rows))[row_of], minlength=BUCKETS) > 1  # what one record alone has says nothing about others
    for _ in range(rounds):
        rate = (q.sum() + 1) / (n + 2)
        kind_up, kind_down = (sum(np.bincount(kind[:, j], w, minlength=KINDS) for j in range(kind.shape[1])) for w in (q, 1 - q))
        mass = np.bincount(line_of, times * q[record_of], minlength=len(rows))
        rest = np.bincount(line_of, times * (1 - q[record_of]), minlength=len(rows))
        up, down = np.bincount(flat, mass[row_of], minlength=BUCKETS), np.bincount(flat, rest[row_of], minlength=BUCKETS)
        share = (mass.sum() + 0.5) / (mass.sum() + rest.sum() + 1)
        odds, cautious = np.where(often, _shrunk(up, down, share, 1.0), 0), np.where(often, _shrunk(up, down, share, 10.0), 0)
        line = np.bincount(row_of, odds[flat], minlength=len(rows)) / lengths**0.75
        total = np.bincount(record_of, telling * line[line_of], minlength=n) / np.sqrt(size) + _shrunk(kind_up, kind_down, rate, 5.0)[kind].sum(axis=1) + math.log(rate / (1 - rate))
        q = np.where(positive, 1.0, 1 / (1 + np.exp(-np.clip(total, -40, 40))))
    return np.stack([odds, cautious]).astype(np.float32)


class Judge:
    """Scores passages by a fitted model and decides on records."""

    def __init__(self, weight: np.ndarray, families: dict[str, re.Pattern] = TRUSTED):
        self.weight, self.families = weight, families
        self.kept: dict[str, str] = {}

    def score(self, passage: str) -> float:
        """Log odds of residue against dialogue. The features of a passage say much the same, so their sum is damped."""
        f = features(generic(passage), trusted(passage, self.families))
        return float(self.weight[int(is_neutral(passage)), f].sum() / max(1, len(f)) ** 0.75)

    def kind(self, passage: str) -> str:
        """residue, dialogue, or neutral for what is neither or undecided"""
        found = self.kept.get(passage)
        if found is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            neutral, score = is_neutral(passage), self.score(passage)
            found = self.kept[passage] = "residue" if score > (NEUTRAL_RESIDUE if neutral else RESIDUE) else "dialogue" if score < DIALOGUE and not neutral else "neutral"
        return found

    def is_residue(self, text: str | None) -> bool:
        """Whether a record has residue and no dialogue."""
        sure = False
        for p in passages(text or ""):
            kind = self.kind(p)
            if kind == "dialogue":
                return False
            sure |= kind == "residue"
        return sure


def fitted(documents: DataFrame, key: str = "doc_id", text: str = "text", records: int = FIT_RECORDS, characters: int = FIT_CHARACTERS) -> np.ndarray:
    """The model of a hash sample of at most about `records` records and `characters` characters (all records where there are
    fewer). A record longer than a hundredth of that is not taken, so the driver's share has a bound in bytes too."""
    known = documents.filter(F.length(text) <= characters // 100)
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    share = min(1.0, records / max(1, n), characters / max(1, size))
    sample = known.filter(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40))).select(key, text) if share < 1 else known.select(key, text)
    return fit([r[1] for r in sorted(sample.collect(), key=lambda r: r[0])])


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text", records: int = FIT_RECORDS) -> DataFrame:
    """(key, residue) of every record."""
    model = documents.sparkSession.sparkContext.broadcast(fitted(documents, key, text, records))  # 2 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([judge.is_residue(t) for t in batch.column(1).to_pylist()], type=pa.bool_())], names=["key", "residue"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, residue boolean").withColumnRenamed("key", key)
