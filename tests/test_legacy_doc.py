"""Binary Word files made by the test, read back."""

from __future__ import annotations

import random
import struct

import pytest

from vellum.sources import legacy_doc, word


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with 512-byte sectors; short streams go into the mini stream."""
    sectors, table, mini, mini_table, places = [], [], b"", [], {}

    def put(data: bytes, end: int = 0xFFFFFFFE) -> int:
        first, n = len(sectors), -(-len(data) // 512)
        sectors.extend(data[512 * k : 512 * (k + 1)].ljust(512, b"\0") for k in range(n))
        table.extend([*range(first + 1, first + n), end] if n else [])
        return first if n else 0xFFFFFFFE

    for name, data in streams.items():
        if len(data) >= 4096:
            places[name] = put(data)
        else:
            first, n = len(mini) // 64, -(-len(data) // 64)
            mini += data.ljust(64 * n, b"\0")
            mini_table += [*range(first + 1, first + n), 0xFFFFFFFE] if n else []
            places[name] = first if n else 0xFFFFFFFE
    root, first_mini = put(mini), put(struct.pack(f"<{len(mini_table)}I", *mini_table)) if mini_table else 0xFFFFFFFE
    entry = lambda name, kind, first, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I36xIQ", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF, first, size)
    directory = put(entry("Root Entry", 5, root, len(mini)) + b"".join(entry(n, 2, places[n], len(d)) for n, d in streams.items()))
    n_fat = 1
    while (len(table) + n_fat) > 128 * n_fat:
        n_fat += 1
    fat_at = len(sectors)
    table += [0xFFFFFFFD] * n_fat
    table += [0xFFFFFFFF] * (128 * n_fat - len(table))
    packed = struct.pack(f"<{len(table)}I", *table)
    sectors.extend(packed[512 * k : 512 * (k + 1)] for k in range(n_fat))
    head = legacy_doc.SIGNATURE + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, directory, 0, 4096, first_mini, bool(mini_table), 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *range(fat_at, fat_at + n_fat), *[0xFFFFFFFF] * (109 - n_fat)) + b"".join(sectors)


def document(paragraphs: list[tuple[str, bytes]], rng, pad: int = 0) -> bytes:
    """A binary document of paragraphs (text with its mark, properties), in random pieces of eight and sixteen bits."""
    text, stream, pieces, places = "".join(t for t, _ in paragraphs), bytearray(1024), [], []
    at = 0
    while at < len(text):
        end = min(len(text), at + rng.randrange(1, 12))
        part = text[at:end]
        try:
            data, narrow = part.encode("cp1252"), rng.random() < 0.7
        except UnicodeEncodeError:
            narrow = False
        if narrow:
            pieces.append((len(part), 2 * len(stream) | 0x40000000))
            places += range(len(stream), len(stream) + len(part))
            stream += data
        else:
            if len(stream) % 2:
                stream += b"\0"
            units = part.encode("utf-16-le")
            pieces.append((len(units) // 2, len(stream)))
            places += range(len(stream), len(stream) + len(units), 2)
            stream += units
        at = end
    ends, seen = [], 0
    for t, _ in paragraphs:
        seen += len(t.encode("utf-16-le")) // 2
        ends.append((places[seen - 1] + 1) if seen < len(places) + 1 else len(stream))
    stream += bytes(-len(stream) % 512 + pad * 512)
    pages, first = [], 1024
    for k in range(0, len(paragraphs), 8):
        some = list(zip(ends[k : k + 8], paragraphs[k : k + 8], strict=True))
        page, offset = bytearray(512), 510
        page[511] = len(some)
        struct.pack_into("<I", page, 0, first)
        for r, (end, (_, properties)) in enumerate(some):
            grp = struct.pack("<H", 0) + properties
            data = bytes([(len(grp) + 1) // 2]) + grp if len(grp) % 2 else bytes([0, len(grp) // 2]) + grp
            offset = (offset - len(data)) // 2 * 2
            page[offset : offset + len(data)] = data
            struct.pack_into("<I", page, 4 * (r + 1), end)
            page[4 * (len(some) + 1) + 13 * r] = offset // 2
        pages.append((first, len(stream) // 512))
        first = some[-1][0]
        stream += page
    bins = struct.pack(f"<{len(pages) + 1}I", *[f for f, _ in pages], first) + struct.pack(f"<{len(pages)}I", *[p for _, p in pages])
    starts = [0]
    for n, _ in pieces:
        starts.append(starts[-1] + n)
    plc = struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<HIH", 0, fc, 0) for _, fc in pieces)
    clx = b"\x01\x02\x00ab\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<HHHHHH", stream, 0, 0xA5EC, 0xC1, 0, 0, 0, 0x200)
    struct.pack_into("<I", stream, 0x4C, starts[-1])
    struct.pack_into("<II", stream, 0x102, 0, len(bins))
    struct.pack_into("<II", stream, 0x1A2, len(bins), len(clx))
    return compound({"1Table": bins + clx, "WordDocument": bytes(stream), "Other": b"x" * 100})


IN_TABLE, ROW_END = legacy_doc._IN_TABLE, legacy_doc._IN_TABLE + legacy_doc._ROW_END + b"\0"


def table_row(cells: list[str]) -> list[tuple[str, bytes]]:
    out = []
    for cell in cells:
        *first, last = cell.split("\n")
        out += [(x + "\r", IN_TABLE) for x in first] + [(last + "\x07", IN_TABLE)]
    return [*out, ("\x07", ROW_END)]


TEXTS = ["plain", "", "naïve – “quoted”", "தமிழ் உரை", "日本語", "😀 pair", "two\nparagraphs", "Tab\there"]


@pytest.mark.parametrize("seed", range(6))
def test_paragraphs_and_tables(seed):
    rng = random.Random(seed)
    want_rows, want, paragraphs = [], [], []
    for _ in range(rng.randrange(1, 40)):
        if rng.random() < 0.4:
            cells = [rng.choice(TEXTS) for _ in range(rng.randrange(1, 6))]
            want_rows.append(cells)
            want += [x for c in cells for x in c.split("\n")]
            paragraphs += table_row(cells)
        else:
            text = rng.choice(TEXTS[:6])
            want.append(text)
            paragraphs.append((text + "\r", b""))
    rows, found = legacy_doc.contents(document(paragraphs, rng, pad=seed * 3))
    assert rows == want_rows and found == want


def test_fields_and_breaks():
    made = document([("see \x13 HYPERLINK \"x\" \x14the \x13 A \x14link\x15\x15 now\x0bnext\x1epart\x1f\x01\r", b"")], random.Random(1))
    assert legacy_doc.contents(made) == ([], ["see the link now\nnext-part"])


def test_items_like_docx(spark):
    titles = ["Tags", "Ch", "Vs", "Sub-Tags", "English", "Translation"]
    rows = [titles, ["\\f", "3", "16", "", "A note", "ஒரு குறிப்பு"], ["\\s1", "4", "1", "N/A", "Head", ""]]
    made = document([("MAT\r", b""), *[p for r in rows for p in table_row(r)]], random.Random(2))
    broken = [made[:700], made[:512] + bytes(len(made) - 512), legacy_doc.SIGNATURE, made.replace(b"W\0o\0r\0d\0D", b"X\0o\0r\0d\0D")]
    files = spark.createDataFrame([("a.doc", made), *[(f"bad{k}.doc", b) for k, b in enumerate(broken)]], "file string, content binary")
    got = {}
    for r in word.parse_docx(files).collect():
        got.setdefault(r.file, []).append((r.content_type, r.book_code, r.chapter, r.verse, r.language_role, r.current_text))
    assert got.pop("a.doc") == [("footnote", "MAT", 3, "16", "source", "A note"), ("footnote", "MAT", 3, "16", "target", "ஒரு குறிப்பு"), ("section_heading", "MAT", 4, "1", "source", "Head"), ("section_heading", "MAT", 4, "1", "target", "")]
    assert {f: rows[0][0] for f, rows in got.items()} == {f"bad{k}.doc": "unreadable" for k in range(4)}
