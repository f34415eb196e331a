"""Archives joined from chunks, read by the standard library."""

from __future__ import annotations

import io
import random
import zipfile
import zlib

from vellum.sinks import archive, exchange
from vellum.sources import word


def test_checksums_join():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.randbytes(rng.choice([0, 1, 2, 7, 100, 5000])) for _ in range(2))
        assert archive.joined_checksum(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_archives_of_chunks(spark):
    rng = random.Random(5)
    want, rows = {}, []
    for f in ("one.zip", "two.zip"):
        for m in range(5):
            chunks = [rng.randbytes(rng.choice([0, 10, 3000])) + b"text " * rng.randrange(400) for _ in range(rng.randrange(1, 6))]
            want.setdefault(f, {})[f"folder/münze{m}.bin"] = b"".join(chunks)
            rows += [(f, m, f"folder/münze{m}.bin", k, c) for k, c in enumerate(chunks)]
    rng.shuffle(rows)
    pieces = archive.zip_pieces(spark.createDataFrame(rows, "file string, member int, name string, nth int, content binary").repartition(4))
    got = {r.file: bytes(r.content) for r in archive.small_files(pieces).collect()}
    assert set(got) == set(want)
    for f, members in want.items():
        with zipfile.ZipFile(io.BytesIO(got[f])) as z:
            assert z.testzip() is None and z.namelist() == list(members)
            assert {n: z.read(n) for n in z.namelist()} == members


def test_large_archives(monkeypatch):
    """With the bound lowered, sizes and offsets go where those beyond 32 bits go."""
    monkeypatch.setattr(archive, "_LARGE", 50)
    data, entries = b"", []
    for k in range(3):
        content = b"x" * (40 + 30 * k)
        packer = zlib.compressobj(wbits=-15)
        packed = packer.compress(content) + packer.flush(zlib.Z_FULL_FLUSH) + archive._END_OF_STREAM
        name = f"m{k}".encode()
        # zipfile wants the plain mark where it looks for the long form
        entries.append(archive._entry(name, zlib.crc32(content), len(packed), len(content), len(data)).replace((50).to_bytes(4, "little"), b"\xff" * 4))
        data += archive._local(name, zlib.crc32(content), len(packed), len(content)) + packed
    directory = b"".join(entries)
    out = data + directory + archive._end(3, len(directory), len(data)).replace((50).to_bytes(4, "little"), b"\xff" * 4)
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert z.testzip() is None and [len(z.read(n)) for n in z.namelist()] == [40, 70, 100]


def test_word_files_in_chunks(spark):
    rows = [(f"book/MAT-{k % 2}.docx", f"K|{k}", 2 * k + j, 1 + k % 3, "4", "footnote", "f", role, f"{role} & <{k}>\r\nline") for k in range(90) for j, role in enumerate(("source", "target"))]
    items = spark.createDataFrame(rows, "book string, semantic_key string, sequence_no int, chapter int, verse string, content_type string, marker string, language_role string, current_text string")
    files = archive.small_files(exchange.docx_pieces(items, "book", rows=7))
    got = [(r.file, r.semantic_key, r.language_role, r.current_text) for r in word.parse_docx(files).collect()]
    assert sorted(got) == sorted((f, k, role, text.replace("\r\n", "\n")) for f, k, _, _, _, _, _, role, text in rows)
    parts = {r.file: zipfile.ZipFile(io.BytesIO(bytes(r.content))).namelist() for r in files.collect()}
    assert set(map(tuple, parts.values())) == {("[Content_Types].xml", "_rels/.rels", "word/document.xml")}
