"""Recursive splitting of plain text and code by ever weaker separators, with overlap."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

PLAIN = ("\n\n", "\n", " ", "")
# fixed values: separators of languages, strongest first
CODE = {
    "py": ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""),
    "js ts jsx tsx": ("\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""),
    "java": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""),
    "c cpp": ("\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""),
    "go": ("\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""),
    "rs": ("\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch ", "\n\n", "\n", " ", ""),
    "php": ("\nfunction ", "\nclass ", "\nif ", "\nforeach ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""),
    "rb": ("\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ", "\nbegin ", "\nrescue ", "\n\n", "\n", " ", ""),
    "cs": ("\ninterface ", "\nenum ", "\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nforeach ", "\nwhile ", "\nswitch ", "\n\n", "\n", " ", ""),
    "swift": ("\nfunc ", "\nclass ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\n\n", "\n", " ", ""),
    "kt": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\ninternal ", "\nfun ", "\nval ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nwhen ", "\n\n", "\n", " ", ""),
    "scala": ("\nclass ", "\nobject ", "\ndef ", "\nval ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nmatch ", "\n\n", "\n", " ", ""),
    "html": ("<body", "<div", "<p", "<br", "<li", "<h1", "<h2", "<h3", "<h4", "<h5", "<h6", "<span", "<table", "<tr", "<td", "<th", "<ul", "<ol", "<header", "<footer", "<nav", "<head", "<style", "<script", "<meta", "<title", ""),
}
LANGUAGE = {ext: seps for exts, seps in CODE.items() for ext in exts.split()}


def _pieces(text: str, separators: tuple[str, ...], size: int) -> Iterator[list[str]]:
    """Runs of pieces below the size, in order; an oversized piece is cut further and its runs stand alone."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, weaker = separators[at], separators[at + 1 :]
    if separator == "":
        parts = list(text)
    else:
        cut = text.split(separator)
        parts = [p for p in [cut[0], *(separator + c for c in cut[1:])] if p]
    run: list[str] = []
    for part in parts:
        if len(part) < size:
            run.append(part)
            continue
        if run:
            yield run
            run = []
        if weaker:
            yield from _pieces(part, weaker, size)
        else:
            yield [part]
    if run:
        yield run


def _merge(run: list[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy chunks of a run; each next one starts with the last pieces that fit the overlap."""
    window: deque[str] = deque()
    held = 0
    for piece in run:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = PLAIN) -> list[str]:
    """Stripped, non-empty chunks. Raises ValueError if the overlap exceeds the size."""
    if overlap > size:
        raise ValueError(f"overlap {overlap} exceeds size {size}")
    if not text or not text.strip():
        return []
    return [c for run in _pieces(text, separators, size) for chunk in _merge(run, size, overlap) if (c := chunk.strip())]


def split_code(text: str, extension: str, size: int = 1500, overlap: int = 300) -> list[str]:
    return split_recursive(text, size, overlap, LANGUAGE.get(extension.lower().lstrip("."), PLAIN))


_FENCE = re.compile(r"```html\s*(?:.*?)\s*```", re.DOTALL)


def split_plain(text: str, size: int, overlap: int) -> list[str]:
    """Plain text; fenced HTML blocks are kept whole."""
    out, at = [], 0
    for m in _FENCE.finditer(text) if "```html" in text else ():
        out += split_recursive(text[at : m.start()].strip(), size, overlap)
        out.append(m[0])
        at = m.end()
    rest = text[at:].strip() if at else text
    return out + split_recursive(rest, size, overlap)
