"""ZIP archives of any size: chunks are deflated in parallel, and joined by block flushes.

A chunk is compressed on its own and ends at a byte, so that a member's chunks one after the other are one
stream.  The checksum of a member follows from those of its chunks (a checksum is a polynomial's remainder:
that of two strings is the first one's times a power of x, plus the second one's).  Headers and the
directory need only these and the sizes, which pass through one task for each archive as a sorted stream.
The result are pieces; written one after the other they are the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import scans

_POLYNOMIAL = 0xEDB88320  # bit 31 stands for 1, bit 30 for x ..
_LARGE = 0xFFFFFFFF
#: Behind a member's chunks: an empty last block.
_END_OF_STREAM = b"\x03\x00"
_LAST = 2**62


def _times(a: int, b: int) -> int:
    """The product of two polynomials, modulo the checksum's."""
    out = 0
    for k in range(32):
        if a >> (31 - k) & 1:
            out ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_checksum(first: int, second: int, length: int) -> int:
    """The CRC-32 of a string and another one of that many bytes after it, from their own."""
    power, base = 1 << 31, 1 << 23  # 1, and x to the 8th
    while length:
        if length & 1:
            power = _times(power, base)
        base, length = _times(base, base), length >> 1
    return _times(power, first) ^ second


def _local(name: bytes, crc: int, packed: int, size: int) -> bytes:
    large = max(packed, size) >= _LARGE
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if large else b""
    shown = (_LARGE, _LARGE) if large else (packed, size)
    return struct.pack("<4s5H3L2H", b"PK\3\4", 45 if large else 20, 0x800, 8, 0, 0x21, crc, *shown, len(name), len(extra)) + name + extra


def _entry(name: bytes, crc: int, packed: int, size: int, offset: int) -> bytes:
    beyond = [x for x in (size, packed, offset) if x >= _LARGE]
    extra = struct.pack(f"<HH{len(beyond)}Q", 1, 8 * len(beyond), *beyond) if beyond else b""
    version = 45 if beyond else 20
    return struct.pack("<4s6H3L5H2L", b"PK\1\2", version, version, 0x800, 8, 0, 0x21, crc, min(packed, _LARGE), min(size, _LARGE), len(name), len(extra), 0, 0, 0, 0, min(offset, _LARGE)) + name + extra


def _end(entries: int, size: int, offset: int) -> bytes:
    out = b""
    if entries >= 0xFFFF or max(size, offset) >= _LARGE:
        out = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, size, offset) + struct.pack("<4sLQL", b"PK\6\7", 0, offset + size, 1)
    shown = min(entries, 0xFFFF)
    return out + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, shown, shown, min(size, _LARGE), min(offset, _LARGE), 0)


def zip_pieces(chunks: DataFrame) -> DataFrame:
    """file, member, nth, data: the pieces of ZIP archives in order of (member, nth), from chunks (file, member, name, nth, content).

    member is the place of a member in its archive and nth that of a chunk in the member, both from 0; content is binary.
    """
    schema = pa.schema([("file", pa.string()), ("member", pa.int64()), ("name", pa.string()), ("nth", pa.int64()), ("data", pa.binary()), ("crc", pa.int64()), ("size", pa.int64())])

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, crc, size = [], [], []
            for i in range(batch.num_rows):
                content, packer = batch.column("content")[i].as_py() or b"", zlib.compressobj(wbits=-15)
                data.append(packer.compress(content) + packer.flush(zlib.Z_FULL_FLUSH))
                crc.append(zlib.crc32(content))
                size.append(len(content))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("file", "member", "name", "nth")), pa.array(data, pa.binary()), pa.array(crc, pa.int64()), pa.array(size, pa.int64())], schema=schema)

    def frame(stream: Iterator[dict]) -> Iterator[dict]:
        for file, of_file in groupby(stream, lambda r: r["file"]):
            offset, entries, length = 0, 0, 0
            for member, own in groupby(of_file, lambda r: (r["member"], r["name"])):
                crc = packed = size = 0
                for x in own:
                    crc = joined_checksum(crc, x["crc"], x["size"])
                    packed, size = packed + x["packed"], size + x["size"]
                name, packed = member[1].encode(), packed + len(_END_OF_STREAM)
                head, entry = _local(name, crc, packed, size), _entry(name, crc, packed, size, offset)
                for nth, data in ((-1, head), (_LAST, _END_OF_STREAM)):
                    yield {"file": file, "member": member[0], "nth": nth, "data": data}
                # the directory stands behind all members, an entry a piece
                yield {"file": file, "member": _LAST, "nth": entries, "data": entry}
                offset, entries, length = offset + len(head) + packed, entries + 1, length + len(entry)
            yield {"file": file, "member": _LAST, "nth": _LAST, "data": _end(entries, length, offset)}

    plain = chunks.select("file", F.col("member").cast("long").alias("member"), "name", F.col("nth").cast("long").alias("nth"), "content")
    packed = plain.mapInArrow(deflate, "file string, member long, name string, nth long, data binary, crc long, size long")
    packed = scans.kept(packed)
    sizes = packed.select("file", "member", "name", "nth", "crc", "size", F.octet_length("data").cast("long").alias("packed"))
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = scans.mapped(sizes.repartition(n, "file").sortWithinPartitions("file", "member", "nth"), frame, "file string, member long, nth long, data binary")
    return packed.select("file", "member", "nth", "data").union(frames)


def small_files(pieces: DataFrame) -> DataFrame:
    """file, content of archives that fit into a row."""

    def join(stream: Iterator[dict]) -> Iterator[dict]:
        for file, own in groupby(stream, lambda r: r["file"]):
            yield {"file": file, "content": b"".join([x["data"] for x in own])}

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scans.mapped(pieces.repartition(n, "file").sortWithinPartitions("file", "member", "nth"), join, "file string, content binary")
