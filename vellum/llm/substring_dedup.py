"""Removal of word windows that a document with a smaller doc_id holds, by fixed-block anchors.

A word is a run of bytes that are not ASCII white space; a window is `window` consecutive words of one
document.  Every window of 13 words holds one whole block of the seven words at places 0, 7, 14 .. of
its document, so these blocks are the reference index, and every rolling window of seven words probes it:

1. Equal texts are merged (one shuffle that merges copies before it) and dealt to units, sets of texts
   of bounded size.  A unit states each of its seven-word hashes once, whether it is a reference block
   and whether several of its documents have it.  The hashes meet in buckets; a hash that some document
   has as a block, and more than one document has at all, is a hit, and goes back to the units that hold it.
2. Each hit is extended to all windows that contain it.  A unit states the 128-bit digest of each window
   once, with the smallest doc_id that has it; the buckets send back the smallest doc_id over all units.
3. A window whose smallest doc_id is below its own is a repeat; overlapping repeats join to maximal runs.

As a unit asks once however many of its documents share a hash, a hash that a third of all documents hold
costs a bucket one entry a unit, and no task sees pairs of documents.  Hashes of step 1 may collide at no
harm, since step 2 compares digests.  Numbers of units and buckets follow the bytes of the texts.

Cases: null and blank texts have no words; a text shorter than a window keeps all; windows that repeat
within one document, or only in documents of the same doc_id, stay; of equal texts those with the smallest
doc_id are judged like any other and the rest lose all words, if they have a window at all; a null doc_id
counts as smaller than all others; repeated rows share one result; an empty table gives an empty one;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, fingerprint, shuffle_partitions, stored

WINDOW = 13
#: Text bytes of a unit, about; a longer text is a unit of its own.
UNIT_BYTES = 8 << 20
_FLAGS = np.uint64(3)  # the two lowest bits of a stated hash: it is a block; several documents have it
_BLOCK, _SEVERAL = np.uint64(1), np.uint64(2)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 22


def words_of(data: bytes | None) -> list[bytes]:
    """bytes.split cuts at the bytes 0x09 to 0x0D and 0x20, no others."""
    return data.split() if data else []


def word_hashes(data: bytes | None) -> np.ndarray:
    """A hash for each word; long texts are split piece by piece."""
    found, at = [], 0
    while data and at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        words = data[at:end].split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, with the flag bits clear."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _MULTIPLIER
        out ^= out >> np.uint64(29)
        out += hashes[j : j + n]
    out *= _MULTIPLIER
    out ^= out >> np.uint64(32)
    return out & ~_FLAGS


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours (of rows, if two-dimensional) starts."""
    change = ordered[1:] != ordered[:-1]
    return np.flatnonzero(np.append(True, change.any(axis=1) if change.ndim > 1 else change)) if len(ordered) else np.zeros(0, np.int64)


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def _by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The bucket of sorted keys, by their upper half, and the slice of each that occurs."""
    if not len(keys):
        return []
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = _runs(bucket)
    return [(int(bucket[s]), slice(s, e)) for s, e in zip(starts, np.append(starts[1:], len(keys)), strict=True)]


def _of_units(batch: pa.RecordBatch) -> dict[int, list[int]]:
    rows: dict[int, list[int]] = {}
    for i, u in enumerate(batch.column("unit").to_pylist()):
        rows.setdefault(u, []).append(i)
    return rows


def stated_grams(texts: list[bytes], block: int) -> np.ndarray:
    """Sorted distinct hashes of all rolling windows of `block` words of the texts, with the flags."""
    each = [rolling(word_hashes(t), block) for t in texts]
    keys = np.concatenate(each) if each else np.zeros(0, np.uint64)
    if not len(keys):
        return keys
    doc = np.repeat(np.arange(len(each)), list(map(len, each)))
    aligned = np.concatenate([np.arange(len(x)) % block == 0 for x in each])
    order = np.argsort(keys, kind="stable")
    keys, doc, aligned = keys[order], doc[order], aligned[order]
    starts = _runs(keys)
    several = doc[starts] != doc[np.append(starts[1:], len(keys)) - 1]
    return keys[starts] | (np.logical_or.reduceat(aligned, starts) * _BLOCK) | (several * _SEVERAL)


def hit_grams(stated: list[np.ndarray]) -> np.ndarray:
    """Sorted hashes that are a block of some document and that more than one document has."""
    entries = np.sort(np.concatenate(stated))
    keys, starts = entries & ~_FLAGS, _runs(entries & ~_FLAGS)
    often = (np.append(starts[1:], len(keys)) - starts > 1) | (np.bitwise_or.reduceat(entries & _SEVERAL, starts) > 0)
    return keys[starts[often & (np.bitwise_or.reduceat(entries & _BLOCK, starts) > 0)]]


def candidates(data: bytes, hits: np.ndarray, window: int) -> tuple[np.ndarray, bytes]:
    """Starts of the windows that contain a hit, and their digests of 16 bytes each."""
    block = (window + 1) // 2
    grams = rolling(word_hashes(data), block)
    found = np.append(0, np.cumsum(_member(hits, grams)))
    n = len(grams) - (window - block)
    if n <= 0 or not found[-1]:
        return np.zeros(0, np.int32), b""
    starts = np.flatnonzero(found[window - block + 1 :][:n] > found[:n])
    words = words_of(data)
    return starts.astype(np.int32), b"".join([hashlib.blake2b(b" ".join(words[q : q + window]), digest_size=16).digest() for q in starts.tolist()])


def _digests(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64).reshape(-1, 2)


def smallest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of keys in order, the least id of each, and the least id at each given place."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ranked = keys[order]
    starts = _runs(ranked)
    least = np.minimum.reduceat(ids[order], starts) if len(starts) else ids[:0]
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    return ranked[starts], least, least[place]


def merged(starts: np.ndarray, window: int) -> np.ndarray:
    """First word and end of each maximal run that the windows cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int32)
    first = np.append(True, starts[1:] > starts[:-1] + window)
    last = np.append(first[1:], True)
    return np.stack([starts[first], starts[last] + window], axis=1).astype(np.int32)


def _unit_texts(docs: DataFrame) -> DataFrame:
    """unit, a, b, id, text (as bytes) of every different text, with the smallest doc_id."""
    spark = docs.sparkSession
    rows = docs.select(fingerprint("text").alias("f"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = shuffle_partitions(spark)
    units = dealt * max(1, -(-total // (UNIT_BYTES * dealt)))
    texts = rows.groupBy(F.col("f.a").alias("a"), F.col("f.b").alias("b")).agg(F.min("id").alias("id"), F.first("text").alias("text"))
    # the number of units is a multiple of that of the shuffle's partitions, so a unit lies in one of them
    return stored(texts.select(F.pmod(F.hash("a", "b"), F.lit(units)).cast("long").alias("unit"), "a", "b", "id", "text"))


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """unit, a, b, id, text of every different text; a, b, runs: its removed runs (pairs of 32-bit numbers)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    block, texts = (window + 1) // 2, _unit_texts(docs)
    buckets = int(texts.agg(F.max("unit")).first()[0] or 0) + 1

    def state_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("text")
            for unit, rows in _of_units(batch).items():
                entries = stated_grams([data[i].as_py() for i in rows], block)
                cut = _by_bucket(entries, buckets)
                yield pa.RecordBatch.from_pydict({"bucket": [k for k, _ in cut], "unit": [unit] * len(cut), "keys": [entries[s].tobytes() for _, s in cut]}, stated_1)

    def find_hits(table: pa.Table) -> pa.Table:
        stated = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
        hits = hit_grams(stated)
        own = [k[_member(hits, k)] for k in (x & ~_FLAGS for x in stated)]
        return pa.table({"unit": table["unit"], "keys": pa.array([x.tobytes() for x in own], pa.binary())}).filter(pa.array([len(x) > 0 for x in own]))

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = np.unique(np.frombuffer(b"".join(right["keys"].to_pylist()), np.uint64))
        found = [candidates(t.as_py() or b"", hits, window) for t in left["text"]] if len(hits) else [(np.zeros(0, np.int32), b"")] * len(left)
        out = left.select(["unit", "a", "b", "id"]).append_column("starts", pa.array([s.tobytes() for s, _ in found], pa.binary()))
        return out.append_column("keys", pa.array([k for _, k in found], pa.binary())).filter(pa.array([len(s) > 0 for s, _ in found], pa.bool_()))

    def state_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = batch.column("id").to_numpy(), batch.column("keys")
            for unit, rows in _of_units(batch).items():
                keys = [_digests(blobs[i].as_py()) for i in rows]
                keys, least, _ = smallest(np.concatenate(keys), np.repeat(ids[rows], list(map(len, keys))))
                cut = _by_bucket(keys[:, 0], buckets)
                yield pa.RecordBatch.from_pydict({"bucket": [k for k, _ in cut], "unit": [unit] * len(cut), "keys": [keys[s].tobytes() for _, s in cut], "ids": [least[s].tobytes() for _, s in cut]}, stated_2)

    def find_earlier(table: pa.Table) -> pa.Table:
        keys, ids = [_digests(x) for x in table["keys"].to_pylist()], [np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()]
        least = smallest(np.concatenate(keys), np.concatenate(ids))[2]
        ends = np.cumsum(list(map(len, ids)))
        told = []
        for k, own, low in zip(keys, ids, np.split(least, ends[:-1]), strict=True):
            told.append((k[low < own].tobytes(), low[low < own].tobytes()))
        out = pa.table({"unit": table["unit"], "keys": pa.array([k for k, _ in told], pa.binary()), "ids": pa.array([i for _, i in told], pa.binary())})
        return out.filter(pa.array([len(i) > 0 for _, i in told]))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = [_digests(x) for x in left["keys"].to_pylist()]
        ends = np.cumsum([0, *map(len, keys)])
        ids = np.repeat(left["id"].to_numpy(), np.diff(ends))
        told = np.frombuffer(b"".join(right["ids"].to_pylist()), np.int64)
        every = np.concatenate([*keys, _digests(b"".join(right["keys"].to_pylist()))])
        gone = smallest(every, np.concatenate([ids, told]))[2][: len(ids)] < ids
        runs = [merged(np.frombuffer(s, np.int32)[gone[a:b]], window) for s, a, b in zip(left["starts"].to_pylist(), ends[:-1], ends[1:], strict=True)]
        return left.select(["a", "b"]).append_column("runs", pa.array([r.tobytes() for r in runs], pa.binary())).filter(pa.array([len(r) > 0 for r in runs], pa.bool_()))

    stated_1 = pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("keys", pa.binary())])
    stated_2 = stated_1.append(pa.field("ids", pa.binary()))
    grams = texts.select("unit", "text").mapInArrow(state_grams, "bucket long, unit long, keys binary")
    hits = stored(grams.groupBy("bucket").applyInArrow(find_hits, "unit long, keys binary"))
    found = texts.groupBy("unit").cogroup(hits.groupBy("unit")).applyInArrow(extend, "unit long, a long, b long, id long, starts binary, keys binary")
    windows = stored(found)
    earlier = windows.select("unit", "id", "keys").mapInArrow(state_windows, "bucket long, unit long, keys binary, ids binary").groupBy("bucket").applyInArrow(find_earlier, "unit long, keys binary, ids binary")
    runs = stored(windows.groupBy("unit").cogroup(earlier.groupBy("unit")).applyInArrow(judge, "a long, b long, runs binary"))
    discard(hits, windows)
    return texts, runs


def _kept(data: bytes | None, runs: bytes | None) -> tuple[list[bytes], int, list[tuple[int, int]]]:
    words = words_of(data)
    spans = [tuple(r) for r in np.frombuffer(runs or b"", np.int32).reshape(-1, 2).tolist()]
    kept, at = [], 0
    for s, e in spans:
        kept += words[at:s]
        at = e
    return kept + words[at:], len(words), spans


def _judged(docs: DataFrame, window: int, make, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """doc_id, copy (a smaller doc_id has the same text), n_words and what `make` gives for each different text."""
    texts, runs = repeated_runs(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(*_kept(t, r)) for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("a", "b", "id")), *columns], names=["a", "b", "id", *[n for n, _ in fields]])

    each = texts.select("a", "b", "id", "text").join(runs, ["a", "b"], "left").mapInArrow(run, f"a long, b long, id long, {schema}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("f")).select("doc_id", "f.a", "f.b")
    later = F.coalesce("doc_id", F.lit(-(2**63))) > F.col("id")
    return rows.join(each, ["a", "b"]).withColumn("copy", later & (F.col("n_words") >= window))


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for every row of docs."""

    def make(kept: list[bytes], n: int, spans: list) -> tuple:
        return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    out = _judged(docs, window, make, fields, "n_words long, n_removed long, kept_sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(F.col("copy"), nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (the kept words joined by one space) and the removed runs (first word, end) for every row of docs."""

    def make(kept: list[bytes], n: int, spans: list) -> tuple:
        return n, b" ".join(kept).decode(), [{"first": s, "end": e} for s, e in spans]

    run = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    out = _judged(docs, window, make, [("n_words", pa.int64()), ("text", pa.string()), ("runs", run)], "n_words long, text string, runs array<struct<first: long, end: long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))
    return out.select("doc_id", F.when(F.col("copy"), "").otherwise(F.col("text")).alias("text"), F.when(F.col("copy"), whole).otherwise(F.col("runs")).alias("runs"))
