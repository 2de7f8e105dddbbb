"""XLS (BIFF8): cells of the sheets of a workbook stream; tables are rendered as for XLSX."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

from textloom.sources.ole import CompoundFile, summary
from textloom.sources.ooxml import _sheet_tables

# fixed values: record numbers, and the built-in number formats that are dates
BOF, EOF, BOUNDSHEET, SST, CONTINUE, LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR, MERGED, XF, FORMAT, DATEMODE = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205, 0xE5, 0xE0, 0x41E, 0x22
DATES = {14, 15, 16, 17, 22}


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield at, kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def _strings(parts: list[bytes]) -> list[str]:
    """The shared strings. A string may go on in the next record, which then begins with its width flag again."""
    if not parts:
        return []
    count = struct.unpack_from("<I", parts[0], 4)[0]
    part, at, out = 0, 8, []

    def more() -> None:
        nonlocal part, at
        while part < len(parts) - 1 and at >= len(parts[part]):
            part, at = part + 1, 0

    for _ in range(count):
        more()
        if at + 3 > len(parts[part]):
            break
        n, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        runs = extra = 0
        if flags & 8:
            runs, = struct.unpack_from("<H", parts[part], at)
            at += 2
        if flags & 4:
            extra, = struct.unpack_from("<I", parts[part], at)
            at += 4
        text, wide = "", flags & 1
        while n:
            if at >= len(parts[part]):
                if part >= len(parts) - 1:
                    break
                part, at = part + 1, 1
                wide = parts[part][0] & 1
            k = min(n, (len(parts[part]) - at) // (2 if wide else 1))
            raw = parts[part][at : at + k * (2 if wide else 1)]
            text += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            at += len(raw)
            n -= k
            if k == 0:
                at = len(parts[part])
        left = 4 * runs + extra
        while left > 0 and part < len(parts):
            step = min(left, len(parts[part]) - at)
            at, left = at + step, left - step
            if left and part < len(parts) - 1:
                part, at = part + 1, 0
            elif left:
                break
        out.append(text)
    return out


def _rk(n: int) -> float:
    value = float(n >> 2 if n < 1 << 31 else (n >> 2) - (1 << 30)) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return value / 100 if n & 1 else value


def _short(data: bytes) -> str:
    n, flags = struct.unpack_from("<HB", data, 0)
    return data[3 : 3 + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def read_xls(data: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata): the sheets with their tag and tables. Whole numbers have no point, dates read yyyy-mm-dd."""
    ole = CompoundFile(data)
    book = ole.read("Workbook") or ole.read("Book") or b""
    sheets: list[tuple[str, int]] = []
    shared: list[bytes] = []
    formats: list[int] = []
    custom: set[int] = set()
    base = datetime.datetime(1899, 12, 30)
    last = 0
    for _, kind, body in _records(book):
        if kind == BOUNDSHEET:
            at, = struct.unpack_from("<I", body)
            n, flags = body[6], body[7]
            sheets.append((body[8 : 8 + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1"), at))
        elif kind == SST or (kind == CONTINUE and last == SST):
            shared.append(body)
            kind = SST
        elif kind == XF:
            formats.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == FORMAT and any(c in _short(body[2:]).lower().split(";")[0] for c in "dy"):
            custom.add(struct.unpack_from("<H", body)[0])
        elif kind == DATEMODE and body[:1] == b"\x01":
            base = datetime.datetime(1904, 1, 1)
        elif kind == EOF:
            break
        last = kind
    strings = _strings(shared)

    def shown(v: float, xf: int) -> str:
        if xf < len(formats) and formats[xf] in DATES | custom:
            return (base + datetime.timedelta(days=v)).strftime("%Y-%m-%d")
        return str(int(v)) if v == int(v) else str(v)

    out = []
    for name, start in sheets:
        cells: dict[tuple[int, int], str] = {}
        merges: list[tuple[int, int, int, int]] = []
        waiting: tuple[int, int] | None = None
        for _, kind, body in _records(book, start):
            if kind == EOF:
                break
            if kind in (LABELSST, NUMBER, RK, FORMULA, LABEL, BOOLERR):
                r, c, xf = struct.unpack_from("<HHH", body)
                place = (r + 1, c + 1)
                if kind == LABELSST:
                    i, = struct.unpack_from("<I", body, 6)
                    cells[place] = strings[i].strip() if i < len(strings) else ""
                elif kind == NUMBER:
                    cells[place] = shown(struct.unpack_from("<d", body, 6)[0], xf)
                elif kind == RK:
                    cells[place] = shown(_rk(struct.unpack_from("<I", body, 6)[0]), xf)
                elif kind == LABEL:
                    cells[place] = _short(body[6:]).strip()
                elif kind == BOOLERR:
                    cells[place] = ("True" if body[6] else "False") if body[7] == 0 else ""
                elif body[12:14] == b"\xff\xff":
                    waiting = place if body[6] == 0 else None
                else:
                    cells[place] = shown(struct.unpack_from("<d", body, 6)[0], xf)
            elif kind == STRING and waiting:
                cells[waiting], waiting = _short(body).strip(), None
            elif kind == MULRK:
                r, c = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    xf, n = struct.unpack_from("<HI", body, 4 + 6 * k)
                    cells[r + 1, c + 1 + k] = shown(_rk(n), xf)
            elif kind == MERGED:
                for k in range(struct.unpack_from("<H", body)[0]):
                    r0, r1, c0, c1 = struct.unpack_from("<HHHH", body, 2 + 8 * k)
                    merges.append((r0 + 1, c0 + 1, r1 + 1, c1 + 1))
        tables = _sheet_tables({p: v for p, v in cells.items() if v}, merges)
        parts = [f"[Sheet: {name}]"]
        for i, t in enumerate(tables):
            parts += [f"[Table {i + 1}]", t] if len(tables) > 1 else [t]
        out.append("\n\n".join(parts))
    return "\n\n".join(out), summary(ole.read("\x05SummaryInformation") or b"")
