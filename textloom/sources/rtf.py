"""RTF: a tokenizer with a group stack; text, tables in place, metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape

# fixed values: destinations whose text is no document text
HIDDEN = set("fonttbl colortbl stylesheet listtable listoverridetable revtbl rsidtbl generator themedata colorschememapping datastore latentstyles xmlnstbl pict object info header headerl headerr headerf footer footerl footerr footerf footnote bkmkstart bkmkend fldinst shpinst nonshppict listtext pntext filetbl mmathPr".split())
SPECIAL = {"tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " "}
_TOKEN = re.compile(rb"\\([A-Za-z]+)(-?\d+)? ?|\\'([0-9A-Fa-f]{2})|\\([^A-Za-z'])|([{}])|([\r\n]+)|([^\\{}\r\n]+)")
CODE_PAGES = {65001: "utf-8", 10000: "mac-roman", 936: "gbk", 949: "cp949", 932: "cp932", 950: "cp950"}


def codec_of(data: bytes, default: str = "cp949") -> str:
    """Codec of \\ansicpg; the default where there is none."""
    m = re.search(rb"\\ansicpg(\d+)", data)
    if m is None:
        return default
    n = int(m[1])
    return CODE_PAGES.get(n, f"cp{n}")


def strip_binary(data: bytes) -> bytes:
    """Without the raw bytes behind \\binN."""
    out, at = [], 0
    for m in re.finditer(rb"\\bin(\d+) ?", data):
        if m.start() >= at:
            out.append(data[at : m.start()])
            at = m.end() + int(m[1])
    return b"".join([*out, data[at:]])


@dataclass
class _Cell:
    text: str = ""
    first_across: bool = False
    on_across: bool = False
    first_down: bool = False
    on_down: bool = False


@dataclass
class _State:
    hidden: bool = False
    skip: int = 1


@dataclass
class RtfText:
    parts: list[str] = field(default_factory=list)
    tables: int = 0
    metadata: dict[str, str] = field(default_factory=dict)


def _table(rows: list[list[_Cell]]) -> str:
    lines = ["<table border='1'>"]
    for i, row in enumerate(rows):
        cells = []
        for j, c in enumerate(row):
            if c.on_across or c.on_down:
                continue
            across = down = 1
            while j + across < len(row) and row[j + across].on_across:
                across += 1
            while c.first_down and i + down < len(rows) and j < len(rows[i + down]) and rows[i + down][j].on_down:
                down += 1
            a = (f" colspan='{across}'" if across > 1 else "") + (f" rowspan='{down}'" if down > 1 else "")
            cells.append(f"<td{a}>{escape(' '.join(c.text.split()), quote=False)}</td>")
        lines.append("<tr>" + "".join(cells) + "</tr>")
    return "\n".join([*lines, "</table>"])


def _time(group: bytes) -> str | None:
    v = {k.decode(): int(n) for k, n in re.findall(rb"\\(yr|mo|dy|hr|min|sec)(\d+)", group)}
    if not v.get("yr"):
        return None
    return f"{v['yr']:04d}-{v.get('mo', 1):02d}-{v.get('dy', 1):02d} {v.get('hr', 0):02d}:{v.get('min', 0):02d}:{v.get('sec', 0):02d}"


def metadata_of(data: bytes, codec: str) -> dict[str, str]:
    names = {"title": "title", "subject": "subject", "author": "author", "keywords": "keywords", "doccomm": "comments", "operator": "last_saved_by"}
    out: dict[str, str] = {}
    for key, name in names.items():
        if m := re.search(rb"\{\\(?:\*\\)?" + key.encode() + rb"[ \r\n]((?:[^{}\\]|\\.)*)\}", data):
            if text := "".join(_plain(m[1], codec)).strip():
                out[name] = text
    for key, name in ((b"creatim", "create_time"), (b"revtim", "last_saved_time")):
        if (m := re.search(rb"\{\\" + key + rb"([^{}]*)\}", data)) and (t := _time(m[1])):
            out[name] = t
    return out


def _plain(data: bytes, codec: str) -> list[str]:
    r = _read(data, codec)
    return r.parts


def _read(data: bytes, codec: str) -> RtfText:
    out = RtfText()
    text: list[str] = []
    pending = bytearray()  # bytes of \'XX escapes, decoded together
    stack: list[_State] = [_State()]
    rows: list[list[_Cell]] = []
    shapes: list[_Cell] = []
    row: list[str] | None = None
    shape = _Cell()
    skip = 0
    fresh = False  # right behind an opening brace
    high = 0

    def flush() -> None:
        if pending:
            text.append(bytes(pending).decode(codec, "replace"))
            pending.clear()

    def end_text() -> None:
        flush()
        body = "".join(text)
        text.clear()
        if body.strip():
            out.parts.append(body)

    def end_table() -> None:
        if rows:
            out.parts.append("\n" + _table(rows) + "\n")
            out.tables += 1
            rows.clear()

    for m in _TOKEN.finditer(data):
        word, number, hexa, symbol, brace, _, plain = m.groups()
        s = stack[-1]
        was_fresh, fresh = fresh, False
        if brace == b"{":
            flush()
            stack.append(_State(s.hidden, s.skip))
            fresh = True
        elif brace == b"}":
            flush()
            if len(stack) > 1:
                stack.pop()
        elif symbol is not None:
            if symbol == b"*":
                s.hidden = True
            elif not s.hidden:
                flush()
                text.append({b"~": "\u00a0", b"-": "\u00ad", b"_": "\u2011"}.get(symbol, symbol.decode("latin-1")) if symbol not in b"\r\n" else "\n")
        elif word is not None:
            name, n = word.decode(), int(number) if number else None
            if name in HIDDEN and was_fresh:
                s.hidden = True
            if s.hidden:
                continue
            if name == "u" and n is not None:
                flush()
                code = n % 65536
                if 0xD800 <= code < 0xDC00:
                    high = code
                elif 0xDC00 <= code < 0xE000 and high:
                    text.append(chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00))
                    high = 0
                else:
                    text.append(chr(code))
                skip = s.skip
            elif name == "uc":
                s.skip = n or 0
            elif name in ("par", "line", "sect", "page"):
                flush()
                if row is None:
                    end_table() if name == "par" and rows and "".join(text).strip() else None
                text.append("\n" if row is None else " ")
            elif name in SPECIAL:
                flush()
                text.append(SPECIAL[name])
            elif name == "trowd":
                if row is None:
                    if "".join(text).strip():
                        end_table()
                    end_text()
                    row = []
                shapes, shape = [], _Cell()
            elif name in ("clmgf", "clmrg", "clvmgf", "clvmrg"):
                setattr(shape, {"clmgf": "first_across", "clmrg": "on_across", "clvmgf": "first_down", "clvmrg": "on_down"}[name], True)
            elif name == "cellx":
                shapes.append(shape)
                shape = _Cell()
            elif name == "cell" and row is not None:
                flush()
                row.append("".join(text))
                text.clear()
            elif name == "row" and row is not None:
                cells = [_Cell(t, *((shapes[i].first_across, shapes[i].on_across, shapes[i].first_down, shapes[i].on_down) if i < len(shapes) else ())) for i, t in enumerate(row)]
                rows.append(cells)
                row = None
                text.clear()
        elif hexa is not None and not s.hidden:
            if skip:
                skip -= 1
            else:
                pending.append(int(hexa, 16))
        elif plain is not None and not s.hidden:
            flush()
            piece = plain.decode(codec, "replace")
            if skip:
                piece, skip = piece[skip:], max(0, skip - len(piece))
            text.append(piece)
    end_table() if not "".join(text).strip() else None
    tail = "".join(text)
    end_table()
    text[:] = [tail]
    end_text()
    return out


def read_rtf(data: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata): page tag 1, then text and tables in order. Within text, all white space becomes one space, and
    lone ` -N ` numbers that shapes leave behind go."""
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ValueError("no RTF")
    codec = codec_of(data)
    try:
        "".encode(codec)
    except LookupError:
        codec = "cp1252"
    read = _read(strip_binary(data), codec)
    body = []
    for p in read.parts:
        body.append(p.strip() if p.lstrip().startswith("<table") else re.sub(r"\s+", " ", re.sub(r"\s*-\d+\s*", " ", p)).strip())
    return "\n\n".join(["[Page Number: 1]", *[b for b in body if b]]), metadata_of(data, codec)
