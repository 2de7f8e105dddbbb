"""Compound files (OLE): the container, and the text of DOC and HWP files in it."""

from __future__ import annotations

import re
import struct
import zlib

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF


class CompoundFile:
    """Streams of a compound file by path."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC):
            raise ValueError("no compound file")
        self.data = data
        self.sector = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, = struct.unpack_from("<I", data, 48)
        self.cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
        difat = list(struct.unpack_from("<109I", data, 76))
        seen = 0
        while first_difat < _END and seen < n_difat:
            block = struct.unpack(f"<{self.sector // 4}I", self._at(first_difat))
            difat += block[:-1]
            first_difat, seen = block[-1], seen + 1
        self.fat: list[int] = []
        for s in difat:
            if s < _END:
                self.fat += struct.unpack(f"<{self.sector // 4}I", self._at(s))
        self.minifat = [x for x in struct.iter_unpack("<I", self._chain(first_mini))] if n_mini else []
        self.minifat = [x[0] for x in self.minifat]
        raw = self._chain(first_dir)
        self.entries = []
        for i in range(0, len(raw) - 127, 128):
            size, = struct.unpack_from("<H", raw, i + 64)
            left, right, child = struct.unpack_from("<III", raw, i + 68)
            start, = struct.unpack_from("<I", raw, i + 116)
            length, = struct.unpack_from("<Q", raw, i + 120)
            self.entries.append((raw[i : i + max(0, size - 2)].decode("utf-16-le", "replace"), raw[i + 66], left, right, child, start, length & 0xFFFFFFFF))
        self.ministream = self._chain(self.entries[0][5])[: self.entries[0][6]] if self.entries else b""
        self.paths: dict[str, int] = {}
        if self.entries:
            self._walk(self.entries[0][4], "", set())

    def _at(self, s: int) -> bytes:
        start = (s + 1) * self.sector
        return self.data[start : start + self.sector].ljust(self.sector, b"\0")

    def _chain(self, s: int) -> bytes:
        out, seen = [], set()
        while s < _END and s not in seen and s < len(self.fat):
            seen.add(s)
            out.append(self._at(s))
            s = self.fat[s]
        return b"".join(out)

    def _walk(self, i: int, prefix: str, seen: set[int]) -> None:
        todo = [(i, prefix)]
        while todo:
            i, prefix = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            name, kind, left, right, child, _, _ = self.entries[i]
            self.paths[prefix + name] = i
            todo += [(left, prefix), (right, prefix)]
            if kind == 1:
                todo.append((child, prefix + name + "/"))

    def read(self, path: str) -> bytes | None:
        i = self.paths.get(path)
        if i is None:
            return None
        *_, start, length = self.entries[i]
        if length >= self.cutoff:
            return self._chain(start)[:length]
        out, seen = [], set()
        while start < _END and start not in seen and start < len(self.minifat):
            seen.add(start)
            out.append(self.ministream[start * self.mini : (start + 1) * self.mini])
            start = self.minifat[start]
        return b"".join(out)[:length]


def write_compound(streams: dict[str, bytes]) -> bytes:
    """A small compound file of top streams and storages one level deep, for tests and exports."""
    sector = 512
    names: list[tuple[str, int, bytes | None]] = [("Root Entry", 5, None)]
    storages: dict[str, list[int]] = {}
    tops: list[int] = []
    for path, data in streams.items():
        folder, _, name = path.rpartition("/")
        if folder and folder not in storages:
            storages[folder] = []
            tops.append(len(names))
            names.append((folder, 1, None))
        (storages[folder] if folder else tops).append(len(names))
        names.append((name, 2, data))
    body, fat, starts = [], [], {}
    for i, (_, kind, data) in enumerate(names):
        if kind == 2:
            padded = (data or b"").ljust(max(4096, -(-len(data or b"") // sector) * sector), b"\0")
            starts[i] = len(body)
            n = len(padded) // sector
            body += [padded[k * sector : (k + 1) * sector] for k in range(n)]
            fat += [*range(len(fat) + 1, len(fat) + n), _END]

    def chain(ids: list[int]) -> tuple[int, dict[int, int]]:
        return (ids[0] if ids else _FREE), {a: b for a, b in zip(ids, ids[1:])}

    first, right = chain(tops)
    child = {0: first}
    for folder, ids in storages.items():
        at = next(i for i, n in enumerate(names) if n[0] == folder and n[1] == 1)
        child[at], more = chain(ids)
        right |= more
    raw = b""
    for i, (name, kind, data) in enumerate(names):
        text = name.encode("utf-16-le")
        size = max(4096, len(data)) if kind == 2 else 0
        raw += text.ljust(64, b"\0") + struct.pack("<HBB", len(text) + 2, kind, 1) + struct.pack("<III", _FREE, right.get(i, _FREE), child.get(i, _FREE)) + bytes(36) + struct.pack("<IQ", starts.get(i, _END), size)
    raw = raw.ljust(-(-len(raw) // sector) * sector, b"\0")
    first_dir, n = len(body), len(raw) // sector
    body += [raw[k * sector : (k + 1) * sector] for k in range(n)]
    fat += [*range(len(fat) + 1, len(fat) + n), _END]
    n_fat = 1
    while (len(fat) + n_fat) * 4 > n_fat * sector:
        n_fat += 1
    fat_at = len(body)
    fat += [0xFFFFFFFD] * n_fat
    fat += [_FREE] * (n_fat * sector // 4 - len(fat))
    packed = struct.pack(f"<{len(fat)}I", *fat)
    header = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, first_dir, 0, 4096, _END, 0, _END, 0)
    header += struct.pack(f"<{n_fat}I", *range(fat_at, fat_at + n_fat)) + struct.pack(f"<{109 - n_fat}I", *[_FREE] * (109 - n_fat))
    return header + b"".join(body) + packed


_RUN = re.compile("[\u0009\u000a\u000d\u0020-\u007e\u00a0-\u024f\u0370-\u04ff\u1100-\u11ff\u2010-\u2027\u3000-\u318f\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff5e]{4,}")


def doc_text(data: bytes) -> str:
    """Runs of at least four plausible characters of a WordDocument stream, each once."""
    ole = CompoundFile(data)
    word = ole.read("WordDocument") or b""
    if word[:2] not in (b"\xec\xa5", b"\xdc\xa5"):
        return ""
    out: dict[str, None] = {}
    for m in _RUN.finditer(word[512:].decode("utf-16-le", "replace")):
        if text := m[0].replace("\r", "\n").strip():
            out.setdefault(text)
    return "\n".join(out)


def inflate(data: bytes) -> bytes:
    for bits in (-15, 15):
        try:
            return zlib.decompress(data, bits)
        except zlib.error:
            continue
    return data


def records(data: bytes) -> list[tuple[int, int, bytes]]:
    """(tag, level, payload) of the records of an HWP stream."""
    out, at = [], 0
    while at + 4 <= len(data):
        head, = struct.unpack_from("<I", data, at)
        tag, depth, size = head & 0x3FF, head >> 10 & 0x3FF, head >> 20
        at += 4
        if size == 0xFFF:
            if at + 4 > len(data):
                break
            size, = struct.unpack_from("<I", data, at)
            at += 4
        out.append((tag, depth, data[at : at + size]))
        at += size
    return out


def paragraph_text(payload: bytes) -> str:
    """Text of a paragraph record. Controls: 10 and 13 break the line, 9 is a tab, extended ones take eight units."""
    units = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2])
    out, i = [], 0
    while i < len(units):
        c = units[i]
        if c >= 32:
            out.append(c)
            i += 1
        elif c in (10, 13):
            out.append(10)
            i += 1
        elif c == 9:
            out.append(9)
            i += 8
        elif 1 <= c <= 8 or c in (11, 12) or 14 <= c <= 23:
            i += 8
        else:
            i += 1
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace")


BIN_DATA, PARA_TEXT, CTRL_HEADER, LIST_HEADER, TABLE, PICTURE = 18, 67, 71, 72, 77, 85
_PICTURE_SPOTS = (79, 8, 71)  # fixed values: where a picture's record may hold the number of its data, in order


def pictures(doc_info: bytes) -> list[str]:
    """Names of the embedded streams, in the order in which pictures number them."""
    out = []
    for tag, _, payload in records(doc_info):
        if tag == BIN_DATA and len(payload) >= 2:
            kind = struct.unpack_from("<H", payload)[0] & 0xF
            if kind == 1 and len(payload) >= 6:
                number, size = struct.unpack_from("<HH", payload, 2)
                ext = payload[6 : 6 + 2 * size].decode("utf-16-le", "replace")
                out.append(f"BIN{number:04X}.{ext}")
            else:
                out.append("")
    return out


def picture_of(payload: bytes, names: list[str]) -> str:
    """The stream that a picture record points to, empty if none is in range."""
    for at in (*_PICTURE_SPOTS, *range(0, max(0, len(payload) - 1), 2)):
        if at + 2 <= len(payload):
            n, = struct.unpack_from("<H", payload, at)
            if 1 <= n <= len(names) and names[n - 1]:
                return names[n - 1]
    return ""


def picture_bytes(ole: CompoundFile, name: str) -> bytes:
    """A picture's bytes, inflated where they are packed."""
    path = next((p for p in ole.paths if p.lower() == f"bindata/{name}".lower()), None)
    raw = (ole.read(path) or b"") if path else b""
    known = (b"\xff\xd8", b"\x89PNG", b"GIF8", b"BM")
    return raw if raw.startswith(known) else inflate(raw)


def hwp_section(data: bytes, names: list[str] | None = None, used: set[str] | None = None) -> list[str]:
    """Paragraphs of a body section in order; tables as HTML, pictures as tags."""
    out: list[str] = []
    table: dict[tuple[int, int], tuple[list[str], int, int]] | None = None
    cell: list[str] | None = None
    table_level = 0

    def close() -> None:
        nonlocal table, cell
        if table:
            rows: dict[int, list[str]] = {}
            for (r, c), (texts, down, across) in sorted(table.items()):
                a = (f" rowspan='{down}'" if down > 1 else "") + (f" colspan='{across}'" if across > 1 else "")
                rows.setdefault(r, []).append(f"<td{a}>{'<br>'.join(texts)}</td>")
            if len(table) == 1:
                out.append("\n".join(next(iter(table.values()))[0]))
            else:
                out.append("\n".join(["<table border='1'>", *("<tr>" + "".join(rows[r]) + "</tr>" for r in sorted(rows)), "</table>"]))
        table, cell = None, None

    for tag, depth, payload in records(data):
        if table is not None and depth <= table_level and tag != LIST_HEADER:
            close()
        if tag == CTRL_HEADER and payload[:4][::-1] == b"tbl ":
            close()
            table, table_level = {}, depth
        elif tag == LIST_HEADER and table is not None and len(payload) >= 16:
            col, row, across, down = struct.unpack_from("<HHHH", payload, 8)
            cell = []
            table[row, col] = (cell, max(1, down), max(1, across))
        elif tag == PARA_TEXT and (text := paragraph_text(payload).strip()):
            (cell if cell is not None else out).append(text)
        elif tag == PICTURE and names and (name := picture_of(payload, names)):
            (cell if cell is not None else out).append(f"[Image:{name}]")
            if used is not None:
                used.add(name)
    close()
    return out


def recovered_text(data: bytes, least: int = 50) -> str:
    """What a damaged file still shows: text runs of its inflated streams, then of its raw bytes."""
    found: dict[str, None] = {}
    pieces = [data]
    for m in re.finditer(rb"\x78[\x01\x9c\xda]", data):
        try:
            pieces.append(zlib.decompressobj().decompress(data[m.start() :]))
        except zlib.error:
            continue
    for piece in reversed(pieces):
        for run in _RUN.finditer(piece[: len(piece) // 2 * 2].decode("utf-16-le", "replace")):
            if text := run[0].strip():
                found.setdefault(text)
    joined = "\n".join(found)
    return joined if len(joined) >= least else ""


def read_hwp(data: bytes) -> tuple[str, dict[str, str]]:
    """(text, metadata): the body's sections, pictures in place and those that stand nowhere at the end. A file whose
    container is damaged gives what can be recovered."""
    try:
        ole = CompoundFile(data)
    except (ValueError, struct.error, IndexError):
        if text := recovered_text(data):
            return text, {}
        raise
    head = ole.read("FileHeader") or b""
    packed = len(head) > 36 and bool(head[36] & 1)

    def stream(name: str) -> bytes:
        raw = ole.read(name) or b""
        return inflate(raw) if packed else raw

    names, used = pictures(stream("DocInfo")), set()
    sections = sorted((n for n in ole.paths if re.fullmatch(r"BodyText/Section\d+", n)), key=lambda n: int(re.search(r"\d+$", n)[0]))
    out: list[str] = []
    for n in sections:
        out += hwp_section(stream(n), names, used)
    if rest := [n for n in names if n and n not in used]:
        out += ["=== Extracted Images (Not Inline) ===", *(f"[Image:{n}]" for n in rest)]
    return "\n".join(out), summary(ole.read("\x05HwpSummaryInformation") or b"")


def summary(data: bytes) -> dict[str, str]:
    """Properties of an OLE property set."""
    names = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 8: "last_saved_by", 12: "create_time", 13: "last_saved_time"}
    out: dict[str, str] = {}
    if len(data) < 48:
        return out
    offset, = struct.unpack_from("<I", data, 44)
    try:
        _, n = struct.unpack_from("<II", data, offset)
        for i in range(min(n, len(data) // 8)):
            key, at = struct.unpack_from("<II", data, offset + 8 + 8 * i)
            kind, = struct.unpack_from("<I", data, offset + at)
            at += offset + 4
            if key not in names:
                continue
            if kind == 31:
                size, = struct.unpack_from("<I", data, at)
                value = data[at + 4 : at + 4 + 2 * size].decode("utf-16-le", "replace")
            elif kind == 30:
                size, = struct.unpack_from("<I", data, at)
                value = data[at + 4 : at + 4 + size].decode("cp949", "replace")
            elif kind == 64:
                ticks, = struct.unpack_from("<Q", data, at)
                import datetime

                value = str(datetime.datetime(1601, 1, 1) + datetime.timedelta(microseconds=ticks // 10)) if ticks else ""
            else:
                continue
            if value := value.rstrip("\0").strip():
                out[names[key]] = value
    except struct.error:
        pass
    return out
