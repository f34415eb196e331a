"""The text of binary Word files (97 to 2003): compound file, piece table, characters, table marks.

A compound file is a small file system: a header, chains of sectors in an allocation table, a directory, and
a second table of small sectors for short streams.  The stream WordDocument begins with a block that names
the table stream and where the piece table lies in it; each piece is a run of characters of eight bits
(Windows-1252) or sixteen.  Paragraph properties tell which cell marks end a table row.
"""

from __future__ import annotations

import struct
from bisect import bisect_right

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
_LAST_SECTOR, _SECTORS = 0xFFFFFFFE, 0xFFFFFFFA  # end of a chain; numbers from here on are no sectors
_ROW_END, _IN_TABLE = b"\x17\x24\x01", b"\x16\x24\x01"  # paragraph properties: this mark ends a row; it lies in a table
# Characters that stand for something else; what is not named here and below a space is dropped.
_SHOWN = {"\t": "\t", "\x0b": "\n", "\x0e": "\n", "\x1e": "-", "\xa0": "\xa0"}


def _u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0]


def _u32(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at)[0]


class Compound:
    """Streams of a compound file by name.  ValueError where it is damaged."""

    def __init__(self, data: bytes):
        if not data.startswith(SIGNATURE) or len(data) < 512:
            raise ValueError("no compound file")
        self.data, self.size, self.small = data, 1 << _u16(data, 30), 1 << _u16(data, 32)
        if self.size not in (512, 4096) or self.small != 64:
            raise ValueError("unknown sector size")
        places = list(struct.unpack_from("<109I", data, 76))
        more, seen = _u32(data, 68), 0
        while more < _SECTORS and seen <= len(data) // self.size:
            block = self._sector(more)
            places += struct.unpack(f"<{self.size // 4 - 1}I", block[:-4])
            more, seen = _u32(block, self.size - 4), seen + 1
        self.next = [n for p in places if p < _SECTORS for n in struct.unpack(f"<{self.size // 4}I", self._sector(p))]
        self.entries = {}
        directory, root = self._chain(_u32(data, 48)), None
        for at in range(0, len(directory) - 127, 128):
            length, kind = _u16(directory, at + 64), directory[at + 66]
            if kind in (2, 5) and 2 <= length <= 64:
                name = directory[at : at + length - 2].decode("utf-16-le", "replace")
                self.entries[name] = (_u32(directory, at + 116), _u32(directory, at + 120))
                root = self.entries[name] if kind == 5 else root
        table = self._chain(_u32(data, 60)) if _u32(data, 60) < _SECTORS else b""
        self.next_small = struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4])
        self.short = self._chain(root[0])[: root[1]] if root and root[0] < _SECTORS else b""
        self.cutoff = _u32(data, 56)

    def _sector(self, k: int) -> bytes:
        block = self.data[(k + 1) * self.size : (k + 2) * self.size]
        if len(block) < self.size and not block:
            raise ValueError("a sector is missing")
        return block.ljust(self.size, b"\0")

    def _walk(self, first: int, after) -> list[int]:
        out, seen = [], set()
        while first < _SECTORS:
            if first in seen or first >= len(after):
                raise ValueError("a chain of sectors is damaged")
            seen.add(first)
            out.append(first)
            first = after[first]
        return out

    def _chain(self, first: int) -> bytes:
        return b"".join(map(self._sector, self._walk(first, self.next)))

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ValueError(f"no stream {name}")
        first, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(first)[:size]
        return b"".join(self.short[k * self.small : (k + 1) * self.small] for k in self._walk(first, self.next_small))[:size]


class Marks:
    """Which places of the document stream have a paragraph property."""

    def __init__(self, document: bytes, table: bytes):
        at, size = _u32(document, 0x102), _u32(document, 0x106)
        n = (size - 4) // 8
        runs = []
        for k in range(max(n, 0)):
            page = document[512 * _u32(table, at + 4 * (n + 1) + 4 * k) :][:512]
            for r in range(page[511] if len(page) == 512 else 0):
                where = 2 * page[4 * (page[511] + 1) + 13 * r]
                words = page[where] if where else 0
                properties = page[where + 3 : where + 2 * words] if words else page[where + 4 : where + 2 + 2 * page[where + 1]] if where else b""
                runs.append((_u32(page, 4 * r), _u32(page, 4 * r + 4), properties))
        self.runs = sorted(runs)

    def has(self, place: int, wanted: bytes) -> bool:
        k = bisect_right(self.runs, (place, 1 << 40)) - 1
        return k >= 0 and place < self.runs[k][1] and wanted in self.runs[k][2]


def _pieces(document: bytes, table: bytes) -> list[tuple[int, int, bool]]:
    """Place in the document stream, number of characters, and whether they have eight bits, in order of the text."""
    at, size = _u32(document, 0x1A2), _u32(document, 0x1A6)
    block = table[at : at + size]
    p = 0
    while p < len(block) and block[p] == 1:  # formatting that pieces refer to
        p += 3 + _u16(block, p + 1)
    if p + 5 > len(block) or block[p] != 2:
        raise ValueError("no piece table")
    n = (_u32(block, p + 1) - 4) // 12
    first = struct.unpack_from(f"<{n + 1}I", block, p + 5)
    out = []
    for k in range(n):
        place = _u32(block, p + 5 + 4 * (n + 1) + 8 * k + 2)
        narrow = bool(place & 0x40000000)
        out.append(((place & 0x3FFFFFFF) // (2 if narrow else 1), first[k + 1] - first[k], narrow))
    return out


def _characters(document: bytes, table: bytes, limit: int) -> list[tuple[str, int]]:
    """The first `limit` characters of the text (notes and headers come behind them), each with its place."""
    out: list[tuple[str, int]] = []
    for place, n, narrow in _pieces(document, table):
        n = min(n, limit - len(out))
        width = 1 if narrow else 2
        data = document[place : place + n * width]
        if len(data) < n * width:
            raise ValueError("a piece lies outside the file")
        if narrow:
            text = data.decode("cp1252", "replace")
        else:  # one character for each unit, pairs are joined when the text is put together
            text = "".join(map(chr, struct.unpack(f"<{n}H", data)))
        out += zip(text, range(place, place + n * width, width), strict=True)
    return out


def contents(data: bytes) -> tuple[list[list[str]], list[str]]:
    """The cells of its table rows, and its paragraphs, also those inside cells.  ValueError if it is no readable document."""
    try:
        file = Compound(data)
        document = file.stream("WordDocument")
        if _u16(document, 0) != 0xA5EC:
            raise ValueError("no binary Word document")
        flags = _u16(document, 10)
        if flags & 0x100:
            raise ValueError("the document is encrypted")
        table = file.stream("1Table" if flags & 0x200 else "0Table")
        characters, marks = _characters(document, table, _u32(document, 0x4C)), Marks(document, table)
    except (struct.error, IndexError) as error:
        raise ValueError(f"damaged document: {error}") from error
    rows, paragraphs, row, cell, part = [], [], [], [], []
    fields: list[bool] = []  # open fields; whether their instruction is being read

    def close() -> str:
        text = "".join(part).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        part.clear()
        return text

    for c, place in characters:
        if c == "\x13":
            fields.append(True)
        elif c == "\x14":
            fields[-1:] = [False] if fields else []
        elif c == "\x15":
            del fields[-1:]
        elif any(fields):
            continue
        elif c == "\x07" and marks.has(place, _ROW_END):
            rows.append(row)
            row, cell = [], []
            part.clear()
        elif c in "\r\x0c\x07":
            paragraphs.append(close())
            cell.append(paragraphs[-1])
            if c == "\x07":
                row.append("\n".join(cell))
            if c == "\x07" or not marks.has(place, _IN_TABLE):
                cell = []
        elif c >= " " or c in _SHOWN:
            part.append(_SHOWN.get(c, c))
    if part:
        paragraphs.append(close())
    return rows, paragraphs
