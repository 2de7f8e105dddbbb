"""Union-free regular expressions of markup, inferred by aligning the token streams of one host.

A stream is what a block of text is made of, in neutral tokens that know nothing of markup: runs of one mark, blanks, and
slots for text between them. A word stands for itself only where its place and its name say so (an element's name behind `<`,
a command's behind a backslash, an entity's, a protocol's); every other one is part of a slot. Inference goes through a host's
distinct streams, the most frequent first. Inside a stream, a group that repeats side by side becomes `( ... )+`. A stream is
then aligned with each wrapper so far; where enough of them agree, what only one of them has becomes optional, `( ... )?`, and
the wrapper is generalised; else the stream opens a wrapper of its own. A wrapper has no alternatives, so it reads as the
template that its blocks were written by.

Only wrappers are read by the grammar of the markup dialects, each once, with plain words in its slots. What of a wrapper is
markup are the constants that the grammar finds there; a block is markup if it fills all constants of one such place.

Only distinct streams are gathered, never texts, and all of a host's take part in the alignment, so each has a wrapper. One task
does a host: its time grows with the square of the host's distinct streams.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textloom.llm.markup import ELEMENTS, ENTITIES, OWN_TAG, tokens

AGREE = 0.6  # share of tokens that must agree for two streams to have one wrapper
WORD, PHRASE, NUMBER = "#T", "#P", "#N"  # slots: one word, several, a number
PLAIN = {WORD, PHRASE, NUMBER, " ", "\n"}
ESCAPED = {"+": "`+", "?": "`?"}  # marks that stand for groups in a wrapper
SAMPLES = {WORD: "x", PHRASE: "x x", NUMBER: "0", "`+": "+", "`?": "?"}
JOIN = "\x1f"  # between the tokens of a stream as a string

_OWN = re.compile(OWN_TAG, re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_ELEMENTS = frozenset(ELEMENTS)
# marks; what is not one of these is punctuation of sentences, and text
_MARK = re.compile(r"[<>&\\{}\[\]()|*#=`~_^$\"%@/+]|''|--|::|;;|\n[ \t]*[-:;][ \t]")
_ATOM = re.compile(r"[ \t]*\n\s*|[ \t\u00a0]+|([^\s])\1*|\s+")
_BLANK = re.compile(r"\n[ \t]*\n")
_OPEN_TAG = re.compile(r"<[A-Za-z!/][^<>]*$")
_UNDERLINE = re.compile(r"(?:={3,}|-{3,})[ \t]*$")
_SENTENCE = re.compile(r"[.!?…。！？]\s")
_SENTENCES = re.compile(r"[^\W_][^\w\s]*?[.!?…。！？]\s[\W_]*(?=[^\W_])")
_ENDING = re.compile(r"^(?:[.,?…’]+|'(?!')|[!:;]+(?=\s))+")


def _literal(block: str, m: re.Match) -> str | None:
    """The word as a token of its own, None if it is part of a slot."""
    word, at = m[0], m.start()
    before = block[at - 1] if at else ""
    if before == "\\":
        return word if word == "item" or (word.isascii() and word.isalpha() and block[m.end() : m.end() + 1] in ("{", "[", "*")) else None
    if before == "<" or block[max(0, at - 2) : at] == "</":
        return word.lower() if word.lower() in _ELEMENTS else None
    if before == "&":
        return word if word in ENTITIES and block.startswith(";", m.end()) else None
    return word if word in ("http", "https", "ftp") and block.startswith("://", m.end()) else None


def units_of(block: str) -> Iterator[str]:
    """The lines of a block; those of a construct that spans lines, and a line with what underlines it, stay together."""
    lines = block.split("\n")
    held: list[str] = []
    display = brackets = 0
    for line, after in zip(lines, [*lines[1:], ""]):
        held.append(line)
        display ^= line.count("$$") & 1
        brackets += sum(line.count(x) for x in ("\\[", "\\(")) - sum(line.count(x) for x in ("\\]", "\\)"))
        if display or brackets > 0 or _OPEN_TAG.search(line) or _UNDERLINE.match(after):
            continue
        yield "\n".join(held)
        held, brackets = [], 0
    if held:
        yield "\n".join(held)


def streams_of_unit(unit: str) -> Iterator[list[str]]:
    """The streams of one unit: it is parted where a sentence ends in plain text and nothing is left open."""
    out: list[str] = []
    at, text, named = 0, None, False  # where the last word ended; the slot that is open; whether the last word was a name
    parts: list[list[str]] = []

    def gap(part: str, first: bool) -> None:
        """What stands between two words: marks close the slot that is open, anything else joins it."""
        nonlocal text, out
        if named:
            part = part[:1] + _ENDING.sub("", part[1:]) if part[:1] == ";" else part
        elif not _MARK.search("\n" + part if first else part):
            if text is None:
                if not first and part and out:
                    out.append("\n" if "\n" in part else " ")
                return
            text = PHRASE if text == PHRASE or any(map(str.isspace, part)) else WORD
            if _SENTENCE.search(part) and well_formed(out):
                parts.append([*out, text])
                out = []
            return
        if text is not None:
            out.append(text)
            text = None
        if not first and not named:
            part = _ENDING.sub("", part)
        out.extend("\n" if "\n" in a[0] else " " if a[0].isspace() else ESCAPED.get(a[0], a[0][:6]) for a in _ATOM.finditer(part))

    for m in _WORD.finditer(unit):
        gap(unit[at : m.start()], not at)
        literal = _literal(unit, m)
        if literal is not None:
            if text is not None:
                out.append(text)
                text = None
            out.append(literal)
        elif text is None:
            text = NUMBER if m[0].isdigit() and m[0].isascii() else WORD
        at, named = m.start() + len(literal) if literal is not None else m.end(), literal is not None
    if at < len(unit):
        gap(unit[at:], not at)
    if text is not None:
        out.append(text)
    yield from parts
    if out:
        yield out


def plain_streams(unit: str) -> list[list[str]]:
    """The streams of a unit without any mark, as `streams_of_unit` has them: a slot a sentence."""
    first = _WORD.search(unit)
    if first is None:
        return []
    sentences = len(_SENTENCES.findall(unit))
    if sentences or any(map(str.isspace, unit[first.start() :])):
        return [[PHRASE]] * (sentences + 1)
    return [[NUMBER]] if first[0].isdigit() and first[0].isascii() and first.end() == len(unit) else [[WORD]]


def streams_of(text: str) -> list[list[str]]:
    """Streams of the units of a text, without the project's own tags; blocks end at blank lines."""
    out = []
    for block in _BLANK.split(_OWN.sub("x", text) if "[" in text or "<" in text else text):
        if not block.strip():
            continue
        block = block.strip("\n")
        units = units_of(block) if _MARK.search("\n" + block) else block.split("\n")
        for unit in units:
            out += streams_of_unit(unit) if _MARK.search("\n" + unit) else plain_streams(unit)
    return out


def sample_of(wrapper: list, leave_out: frozenset[str] = frozenset(), groups: bool = True) -> tuple[str, list[tuple[str, int, int]]]:
    """A wrapper as the text of one block that fills all of it, but for optional slots and blanks that are left out (unless a
    line begins with them) and, without `groups`, all that is optional; and where in it each of its tokens stands."""
    out: list[str] = []
    places: list[tuple[str, int, int]] = []
    at = 0

    def add(x) -> None:
        nonlocal at
        if isinstance(x, str):
            s = SAMPLES.get(x, x)
            out.append(s)
            places.append((x, at, at + len(s)))
            at += len(s)
        elif x[:1] in (["+"], ["?"]):
            inside = _inside(x[1])
            plain = all(isinstance(y, str) and y in PLAIN for y in inside)
            begins = not out or out[-1].endswith("\n")
            if x[0] == "?" and (plain and all(y in leave_out for y in inside) and not begins or not plain and not groups):
                return
            for y in inside:
                add(y)
        else:
            for y in x:
                add(y)

    add(wrapper)
    return "".join(out), places


def markup_of(wrapper: list) -> list[list[str]]:
    """The constants of each place of a wrapper that is markup, in order: as the grammar finds them with everything filled,
    without optional blanks, without optional slots too, and without anything optional."""
    out = []
    for leave_out, groups in ((frozenset(), True), (frozenset(" \n"), True), (frozenset(PLAIN), True), (frozenset(), False), (frozenset(PLAIN), False)):
        text, places = sample_of(wrapper, leave_out, groups)
        for _, start, end in tokens(text):
            constants = [x for x, a, b in places if x not in PLAIN and a < end and b > start]
            if constants and constants not in out:
                out.append(constants)
    return out


def fills(stream: list[str], constants: list[str]) -> bool:
    """Whether a stream has these constants, in order."""
    rest = iter(stream)
    return all(c in rest for c in constants)


def folded(stream: list[str]) -> list:
    """The stream with groups that stand side by side more than once as ["+", group], short groups first."""
    out: list = list(stream)
    for width in range(1, 9):
        i, kept = 0, []
        while i < len(out):
            group = out[i : i + width]
            n = 1
            while len(group) == width and out[i + n * width : i + (n + 1) * width] == group:
                n += 1
            if n > 1 and not (width == 1 and isinstance(group[0], list)):
                kept.append(["+", group[0] if width == 1 else group])
                i += n * width
            else:
                kept.append(out[i])
                i += 1
        out = kept
    return out


def parts_of(wrapper: list) -> list[str]:
    """The parts of a wrapper or folded stream as text, whether optional or not, for alignment."""
    return [str(x[1] if x[:1] == ["?"] else x) for x in wrapper]


def _constant(x) -> bool:
    """Whether a part of a wrapper holds anything but slots and blanks."""
    if isinstance(x, str):
        return x not in PLAIN
    return any(map(_constant, x[1:] if x[:1] in (["+"], ["?"]) else x))


def constants_of(parts: list[str]) -> Counter:
    return Counter(x for x in parts if x not in PLAIN)


def may_align(a: Counter, n_a: int, b: Counter, n_b: int) -> bool:
    """Whether parts with these constants, so many in all, can agree in enough for one wrapper, whatever their order. Spares
    `aligned` its work on most pairs and never turns one away that it would take."""
    need = AGREE * (n_a if n_a > n_b else n_b)
    return n_a >= need and n_b >= need and sum(n if n < b[x] else b[x] for x, n in a.items() if x in b) >= need


_PAIRED = {"(": ")", "[": "]", "{": "}", "<": ">", "[[": "]]", "{{": "}}"}
_TWICE = {"$", "$$", "**", "__", "~~", "''", "'''", "`", '"', "==", "===", "===="}


def _flat(x) -> Iterator[str]:
    if isinstance(x, str):
        yield x
    else:
        for y in x[1:] if x[:1] in (["+"], ["?"]) else x:
            yield from _flat(y)


def well_formed(part: list) -> bool:
    """Whether a part can be optional: its brackets are closed, marks that come in pairs do, and no name lacks what is before it."""
    open_, before = Counter(), ""
    for x in _flat(part):
        if x in _TWICE:
            open_[x] ^= 1
        elif x in _PAIRED:
            open_[_PAIRED[x]] += 1
        elif x in open_ or x in _CLOSING:
            open_[x] -= 1
            if open_[x] < 0:
                return False
        elif x[0].isalpha() and not before:
            return False
        before = x
    return not any(open_.values())


_CLOSING = frozenset(_PAIRED.values())


def balance(wrapper: list) -> frozenset:
    """What of a wrapper's brackets and paired marks is left open. It is the same for all that align, since what is optional
    leaves nothing open."""
    count = Counter(_flat(wrapper))
    open_ = {(x, count[x] - count[y]) for x, y in _PAIRED.items() if count[x] != count[y]}
    return frozenset(open_ | {(x, 0) for x in _TWICE if count[x] & 1})


def _optional(part: list) -> list:
    """A part as one optional group; slots and blanks at its ends are optional by themselves."""
    if not any(map(_constant, part)) or len(part) < 2:
        return [x if x[:1] == ["?"] else ["?", x] for x in part]
    return [["?", part]]


def aligned(wrapper: list, stream: list) -> list | None:
    """The wrapper generalised so that it fits the stream too, None if their constants agree in too little, or if only a union
    would fit both. What a line begins with is its role and never optional."""
    right = stream
    a, b = parts_of(wrapper), [str(x) for x in right]
    if a[0] != b[0] and not (a[0] in PLAIN and b[0] in PLAIN):
        return None
    matcher = SequenceMatcher(None, a, b, autojunk=False)
    operations = matcher.get_opcodes()
    same = sum(x not in PLAIN for op, a0, a1, _, _ in operations if op == "equal" for x in a[a0:a1])
    most = max(constants_of(a).total(), constants_of(b).total())
    if same < AGREE * most or not most and (len(a) > 1 or len(b) > 1):
        return None
    out: list = []
    for op, a0, a1, b0, b1 in operations:
        if op == "equal":
            out += wrapper[a0:a1]
        elif op == "replace" and any(map(_constant, wrapper[a0:a1])) and any(map(_constant, right[b0:b1])):
            return None  # one or the other: only a union would fit both
        elif not well_formed(wrapper[a0:a1]) or not well_formed(right[b0:b1]):
            return None  # what is optional is so as a whole
        elif (a0 == 0 or a[a0 - 1] == "\n") and (any(map(_constant, wrapper[a0:a1])) or any(map(_constant, right[b0:b1]))):
            return None
        else:
            out += [*_optional(wrapper[a0:a1]), *_optional(right[b0:b1])]
    return out


def _inside(group) -> list:
    """What a group holds: one part, or a sequence of them."""
    return [group] if isinstance(group, str) or group[:1] in (["+"], ["?"]) else group


def shown(x) -> str:
    """A wrapper as text."""
    if isinstance(x, str):
        return {" ": "␣", "\n": "⏎"}.get(x, x)
    if x[:1] in (["+"], ["?"]):
        return f"( {' '.join(map(shown, _inside(x[1])))} ){x[0]}"
    return " ".join(map(shown, x))


class Matcher:
    """Tells whether a wrapper fits a stream, in time linear in both: the places that a match can have reached are the bits of
    one number, and each part of the wrapper moves all of them at once. Nothing is tried twice, so optional parts cost
    no backtracking."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        self.parts = constants_of(parts_of(wrapper))
        self.size = self.parts.total()
        self.needed, self.allowed = frozenset(self._tokens(wrapper, False)), frozenset(self._tokens(wrapper, True))

    def _tokens(self, x, optional: bool) -> Iterator[str]:
        if isinstance(x, str):
            yield x
        elif x[:1] in (["+"], ["?"]):
            if x[0] == "+" or optional:
                yield from self._tokens(_inside(x[1]), optional)
        else:
            for y in x:
                yield from self._tokens(y, optional)

    def _reach(self, x, places: int, at: dict[str, int]) -> int:
        if not places:
            return 0
        if isinstance(x, str):
            return (places & at.get(x, 0)) << 1
        if x[:1] == ["?"]:
            return places | self._reach(_inside(x[1]), places, at)
        if x[:1] == ["+"]:
            inside, reached = _inside(x[1]), 0
            while places:
                places = self._reach(inside, places, at) & ~reached
                reached |= places
            return reached
        for y in x:
            places = self._reach(y, places, at)
        return places

    def fits(self, stream: list[str], kinds: frozenset[str]) -> bool:
        if not (self.needed <= kinds <= self.allowed):
            return False
        at: dict[str, int] = {}
        for i, t in enumerate(stream):
            at[t] = at.get(t, 0) | 1 << i
        return bool(self._reach(self.wrapper, 1, at) >> len(stream) & 1)


def infer(streams: list[list[str]]) -> list[list]:
    """Wrappers of a host's streams, which come the most frequent first. Wrappers are looked up by their rarest constants: two
    that agree in a share of `AGREE` have one in common among the rarest of each, so no pair is missed that may align."""
    rank = {x: i for i, (x, _) in enumerate(sorted(Counter(x for s in streams for x in set(s)).items(), key=lambda e: (e[1], e[0])))}
    matchers: list[Matcher] = []
    held: dict[tuple, set[int]] = {}

    def rarest(parts: Counter, size: int) -> list[tuple[str, int]]:
        every = sorted(((x, k) for x, n in parts.items() for k in range(n)), key=lambda e: (rank.get(e[0], -1), e))
        return every[: size - math.ceil(AGREE * size - 1e-9) + 1] if size else [("", 0)]

    def hold(i: int, m: Matcher) -> None:
        for e in rarest(m.parts, m.size):
            held.setdefault((balance(m.wrapper), e), set()).add(i)

    for stream in streams:
        kinds = frozenset(stream)
        if any(m.fits(stream, kinds) for m in matchers):
            continue
        short = folded(stream)
        parts = constants_of(parts_of(short))
        size = parts.total()
        open_ = balance(short)
        for i in sorted(set().union(*(held.get((open_, e), ()) for e in rarest(parts, size)))):
            m = matchers[i]
            if not may_align(parts, size, m.parts, m.size):
                continue
            general = aligned(m.wrapper, short)
            if general is not None and len(general) <= 2 * max(len(m.wrapper), len(short)) and (new := Matcher(general)).fits(stream, kinds):
                matchers[i] = new
                hold(i, new)
                break
        else:
            matchers.append(Matcher(short))
            hold(len(matchers) - 1, matchers[-1])
    return [m.wrapper for m in matchers]


@F.pandas_udf(ArrayType(StringType()))
def _streams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[] if t is None else list(dict.fromkeys(JOIN.join(s) for s in streams_of(t))) for t in texts], dtype=object)


def with_streams(items: DataFrame, text: str = "text") -> DataFrame:
    """Items by block: one row for each distinct stream of each item."""
    return items.withColumn("stream", F.explode(_streams(F.col(text)))).drop(text)


def assigned(streams: list[list[str]]) -> Iterator[tuple[str, str, bool]]:
    """(stream, wrapper, is_markup) of each of a host's streams, which come the most frequent first. A stream is markup if it
    fills the constants of a place of its wrapper that is; where all of that is optional and the stream has none, it is plain."""
    matchers = [Matcher(w) for w in infer(streams)]
    texts, marked = [shown(m.wrapper) for m in matchers], [markup_of(m.wrapper) for m in matchers]
    for stream in streams:
        kinds = frozenset(stream)
        i = next(i for i, m in enumerate(matchers) if m.fits(stream, kinds))
        yield JOIN.join(stream), texts[i], any(fills(stream, c) for c in marked[i])


def infer_wrappers(streams: DataFrame) -> DataFrame:
    """(host, stream, wrapper, is_markup) of (host, stream, ...), each distinct stream of a host once. Rows are counted by
    stream before anything is grouped by host, so a host with a third of all rows sends its distinct streams only."""
    counts = streams.groupBy("host", "stream").agg(F.count("*").alias("n"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["n", "stream"], ascending=[False, True])["stream"]
        out = pd.DataFrame(assigned([s.split(JOIN) for s in ordered]), columns=["stream", "wrapper", "is_markup"])
        return out.assign(host=frame["host"].iloc[0])

    return counts.groupBy("host").applyInPandas(learn, "host string, stream string, wrapper string, is_markup boolean")
